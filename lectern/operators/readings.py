"""Readings of pages: units, lines and words, agreement of engines, accuracy of engines on a common cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import normalise_text, rate
from ..functions.fuzzy import ratio
from .classify import ocr_rank

# Points of an inch, and the resolution assumed, and the bounds of a measured one.
INCH, DPI, DPI_LEAST, DPI_MOST = 72.0, 300, 96, 600


def source_dpi(images: Column) -> Column:
    """Resolution of a page's sharpest image; images: array<struct<pixels, points>> (widths)."""
    sharp = F.array_max(F.transform(F.filter(images, lambda i: (i["points"] > 0) & (i["pixels"] > 0)), lambda i: i["pixels"] / (i["points"] / INCH)))
    return F.when(sharp.isNull(), F.lit(DPI)).otherwise(F.least(F.greatest(F.round(sharp).cast("int"), F.lit(DPI_LEAST)), F.lit(DPI_MOST)))


def words(boxes: Column, dpi: Column, least: float = 0.0) -> Column:
    """Pixel boxes struct<text, conf, left, top, width, height, ...> in points, blank ones dropped; no estimate counts as 0."""
    scale = F.lit(INCH) / dpi
    sure = lambda b: F.greatest(F.coalesce(b["conf"], F.lit(0.0)), F.lit(0.0))
    kept = F.filter(boxes, lambda b: (F.trim(b["text"]) != "") & (sure(b) >= least))
    return F.transform(kept, lambda b: F.struct(
        F.trim(b["text"]).alias("text"), (b["left"] * scale).alias("x0"), (b["top"] * scale).alias("y0"), ((b["left"] + b["width"]) * scale).alias("x1"),
        ((b["top"] + b["height"]) * scale).alias("y1"), (sure(b) / 100).alias("confidence"),
    ))


def lines(df: DataFrame, key: tuple[str, ...], least: float = 0.0) -> DataFrame:
    """Text of each page from words (key, block, par, line, n, text, conf): words by a space, lines by a newline."""
    kept = df.where((F.trim("text") != "") & (F.coalesce("conf", F.lit(-1.0)) >= (least if least > 0 else -1.0)))
    line = kept.groupBy(*key, "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("text").alias("t")))), lambda w: w["t"]), " ").alias("t"))
    return line.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "t"))), lambda w: w["t"]), "\n").alias("text"))


def marked(pages: DataFrame, key: str = "file") -> DataFrame:
    """One text a document from (key, page, text): pages with text, each under its marker."""
    body = F.concat(F.lit("--- page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text"))
    per = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("page", body.alias("t"))))).alias("p"), F.count("*").alias("pages"))
    return per.select(key, "pages", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def quad_box(corners: Column) -> Column:
    """The upright box around a quadrilateral array<struct<x, y>>."""
    xs, ys = F.transform(corners, lambda p: p["x"].cast("double")), F.transform(corners, lambda p: p["y"].cast("double"))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def split_line(text: Column, box: Column) -> Column:
    """A line's box divided among its words by their characters, spaces counted; array<struct<text, x0, y0, x1, y1>>."""
    tokens = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda t: t != "")
    size = F.transform(tokens, lambda t: F.length(t))
    total = F.aggregate(size, F.lit(0), lambda s, v: s + v) + F.size(tokens) - 1
    unit = (box["x1"] - box["x0"]) / total
    word = lambda t, x0, x1: F.struct(t.alias("text"), x0.alias("x0"), box["y0"].alias("y0"), x1.alias("x1"), box["y1"].alias("y1"))

    def one(t, i):
        x0 = box["x0"] + unit * (F.aggregate(F.slice(size, F.lit(1), i), F.lit(0), lambda s, v: s + v) + i)
        return word(t, x0, x0 + unit * F.length(t))

    return F.when(F.size(tokens) == 0, F.transform(tokens, lambda t: word(t, box["x0"], box["x1"]))).when(
        box["x1"] > box["x0"], F.transform(tokens, one)
    ).otherwise(F.array(word(text, box["x0"], box["x1"])))


def summarise(text: Column, confidence: Column, seconds: Column) -> Column:
    """`120ch/conf0.93/1.2s`, a dash where there is no confidence."""
    return F.concat(
        F.length(F.coalesce(text, F.lit(""))).cast("string"), F.lit("ch/conf"), F.when(confidence.isNull(), "-").otherwise(F.format_string("%.2f", confidence.cast("double"))),
        F.lit("/"), F.format_string("%.1f", seconds.cast("double")), F.lit("s"),
    )


def consensus(readings: DataFrame, key: str = "file") -> DataFrame:
    """The best ranked reading of each file and how far its engines agree.

    readings: (key, order, engine, text, layer, confidence), a few engines a file.  Agreement is the mean fuzzy ratio of
    pairs of texts that are not blank, in the engines' order; null for under two.  Equal texts need no ratio.
    """
    row = F.struct("engine", "text", "layer", "confidence")
    best = readings.groupBy(key).agg(F.max_by(row, F.struct(ocr_rank(F.col("text"), F.col("confidence"), 0), -F.col("order"))).alias("r"))
    form = readings.where(F.trim("text") != "").select(F.col(key).alias("_k"), F.col("order").alias("o"), normalise_text(F.col("text"), unicode=True).alias("t"))
    a, b = form.alias("a"), form.alias("b")
    pairs = a.join(b, (F.col("a._k") == F.col("b._k")) & (F.col("a.o") < F.col("b.o"))).select("a._k", F.col("a.t").alias("x"), F.col("b.t").alias("y"))
    same = pairs.where("x = y").select("_k", F.lit(1.0).alias("v"))
    other = pairs.where("x <> y").select("_k", ratio(F.col("x"), F.col("y")).alias("v"))
    agreed = same.union(other).groupBy("_k").agg(F.round(F.avg("v"), 6).alias("agreement"))
    return best.join(agreed, F.col(key) == F.col("_k"), "left").select(key, "r.*", "agreement")


def common_cohort(graded: DataFrame, engine: str = "engine", key: str = "file") -> tuple[DataFrame, DataFrame]:
    """The rows of files that every engine has, and how many others each engine has."""
    n = graded.select(engine).distinct().agg(F.count("*").alias("_engines"))  # one row
    files = graded.select(key, engine).distinct().groupBy(key).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(n)).where("_n = _engines").select(key)
    extra = graded.join(files, key, "left_anti").groupBy(engine).agg(F.countDistinct(key).alias("extra"))
    return graded.join(files, key, "left_semi"), extra


def engine_accuracy(graded: DataFrame, engine: str = "engine", profile: str = "profile", key: str = "file") -> DataFrame:
    """Field-weighted accuracy of each engine by profile and in all (profile null), over the common cohort; failures left out."""
    rows, _ = common_cohort(graded, engine, key)
    rows = rows.where(~F.coalesce(F.col("failed"), F.lit(False)) & (F.col("fields_graded") > 0))
    sets = rows.select(engine, "fields_correct", "fields_graded", F.explode(F.array(F.lit(None).cast("string"), F.col(profile))).alias(profile))
    return sets.groupBy(engine, profile).agg(F.count("*").alias("documents"), rate(F.sum("fields_correct"), F.sum("fields_graded")).alias("accuracy"))


def degrade(records: DataFrame, levels: tuple[str, ...], key: str = "file") -> DataFrame:
    """Each record once for each level, the level in its name and its degradation."""
    return records.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn(key, F.concat(F.col(key), F.lit("__"), "_level")).withColumn("degradation", F.struct(F.col("_level").alias("profile"))).drop("_level")
