"""Cutting bundles into documents, and scoring the cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import rate


def boundaries_by_type(pages: DataFrame, file: str = "file", page: str = "page", label: str = "label", confidence: str | None = None, split_below: float = 0.0) -> DataFrame:
    """pages with `boundary`: the label changed between two labelled pages, or the page is too unsure; never the first page."""
    w = Window.partitionBy(file).orderBy(page)
    before, first = F.lag(label).over(w), F.row_number().over(w) == 1
    cut = F.coalesce((F.col(label) != before) & (F.col(label) != "") & (before != ""), F.lit(False))
    if confidence:
        cut = cut | F.coalesce(F.col(confidence) < split_below, F.lit(False))
    return pages.withColumn("boundary", cut & ~first)


def spans(pages: DataFrame, file: str = "file", page: str = "page") -> DataFrame:
    """(file, first_page, last_page) of each piece, inclusive."""
    w = Window.partitionBy(file).orderBy(page)
    starts = pages.withColumn("last", F.max(page).over(Window.partitionBy(file))).withColumn("start", F.col("boundary") | (F.row_number().over(w) == 1)).where("start")
    return starts.select(file, F.col(page).alias("first_page"), F.coalesce(F.lead(page).over(w) - 1, F.col("last")).alias("last_page"))


def single() -> Column:
    return F.array().cast("array<int>")


def every_page(pages: Column) -> Column:
    return F.when(pages > 1, F.sequence(F.lit(1), pages - 1)).otherwise(single())


def match(pieces: DataFrame, documents: DataFrame, file: str = "file") -> DataFrame:
    """Each piece with the document that it overlaps most (the first one on a tie, null without overlap)."""
    p, d = pieces.alias("p"), documents.alias("d")
    n = F.when(F.col("d.first_page").isNotNull(), F.least("p.last_page", "d.last_page") - F.greatest("p.first_page", "d.first_page") + 1)
    hit = p.join(d, (F.col(f"p.{file}") == F.col(f"d.{file}")) & (F.col("d.first_page") <= F.col("p.last_page")) & (F.col("d.last_page") >= F.col("p.first_page")), "left")
    best = F.min(F.struct((-n).alias("minus"), F.col("d.first_page").alias("f"), F.col("d.last_page").alias("l")))
    out = hit.groupBy(f"p.{file}", "p.first_page", "p.last_page").agg(best.alias("b"))
    same = (F.col("b.f") == F.col("first_page")) & (F.col("b.l") == F.col("last_page"))
    return out.select(file, "first_page", "last_page", F.col("b.f").alias("truth_first"), F.coalesce(-F.col("b.minus"), F.lit(0)).alias("overlap"), F.coalesce(same, F.lit(False)).alias("exact"))


def score(cuts: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """Boundary precision, recall, F1, exact files, merged and spurious cuts over files with arrays of cuts."""
    hit = F.sum(F.size(F.array_intersect(predicted, truth)))
    missed, extra = F.sum(F.size(F.array_except(truth, predicted))), F.sum(F.size(F.array_except(predicted, truth)))
    return cuts.agg(
        F.count("*").alias("files"), hit.alias("hit"), missed.alias("merged"), extra.alias("spurious"),
        F.count_if(F.array_sort(predicted) == F.array_sort(truth)).alias("exact_files"),
        rate(hit, hit + extra).alias("precision"), rate(hit, hit + missed).alias("recall"), rate(2 * hit, 2 * hit + extra + missed).alias("f1"),
    )


def same_type_recall(cuts: DataFrame, predicted: str = "predicted", truth: str = "truth", types: str = "types") -> DataFrame:
    """Recall of cuts between two documents of one type, which a classifier of pages cannot see.

    The i-th cut of `truth`, in order, lies between the documents i and i + 1 of `types`.
    """
    order = F.array_sort(truth)
    alike = F.filter(F.transform(order, lambda c, i: F.struct(c.alias("cut"), (F.get(F.col(types), i) == F.get(F.col(types), i + 1)).alias("same"))), lambda x: x["same"])
    cut = F.transform(alike, lambda x: x["cut"])
    n, hit = F.sum(F.size(cut)), F.sum(F.size(F.array_intersect(cut, F.col(predicted))))
    return cuts.agg(n.alias("same_type_boundaries"), hit.alias("hit"), rate(hit, n).alias("same_type_recall"))


def summary(pieces: DataFrame, documents: DataFrame, file: str = "file") -> DataFrame:
    """Of matched pieces: exact ones, documents cut into several, documents that no piece is matched with."""
    own = pieces.groupBy(file, F.col("truth_first").alias("first_page")).agg(F.count("*").alias("k"))
    seen = documents.select(file, "first_page").join(own, [file, "first_page"], "left")
    a = pieces.agg(F.count("*").alias("pieces"), F.count_if("exact").alias("exact"), F.count_if(F.col("overlap") == 0).alias("unmatched"))
    return a.crossJoin(seen.agg(F.count("*").alias("documents"), F.count_if(F.col("k") > 1).alias("cut"), F.count_if(F.col("k").isNull()).alias("unseen")))  # one row each
