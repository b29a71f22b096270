"""Records as JSON arrays or JSON lines, caches, resumable prediction files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import TYPES

FORMAT = 1


def _records(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of all files, with the file of each as `_file`.

    The first line of a file that is not blank tells its kind: an array, one record over several lines (a brace that
    stands alone), or JSON lines.  Only names of files come to the driver, which lists them anyway.
    """
    file = F.col("_metadata.file_path")
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S") & (F.col("_metadata.file_block_start") == 0))
    lines = lines.select(file.alias("f"), F.trim(F.substring("value", 1, 64)).alias("head"), F.monotonically_increasing_id().alias("i"))
    first = lines.groupBy("f").agg(F.min_by("head", "i").alias("head"))
    kinds = {r.f: r.whole for r in first.select("f", F.col("head").rlike(r"^\s*(\[|\{\s*$)").alias("whole")).collect()}
    out = None
    for whole in (True, False):
        own = [unquote(f) for f, w in kinds.items() if w == whole]
        if own or (out is None and not whole):
            reader = spark.read.schema(schema).option("multiLine", whole).option("mode", "PERMISSIVE")
            rows = reader.json(own) if own else spark.createDataFrame([], schema).withColumn("_file", F.lit(""))
            rows = rows.select("*", file.alias("_file")) if own else rows
            out = rows if out is None else out.unionByName(rows)
    return out


def load_records(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON arrays, JSON lines and single records, told apart for each file; Spark reads the files, so any store will do."""
    return _records(spark, path, schema).drop("_file")


def load_corpus(spark: SparkSession, root: str, schema: T.StructType, only: tuple[str, ...] = ()) -> DataFrame:
    """labels/<stem>.json with the stem as a column, some stems only if named."""
    df = _records(spark, f"{root}/labels/*.json", schema)
    df = df.withColumn("stem", F.regexp_extract("_file", r"([^/]+)\.json$", 1)).drop("_file")
    return df.where(F.col("stem").isin(*only)) if only else df


def cohort(jobs: DataFrame, wanted: DataFrame, key: str = "file") -> DataFrame:
    """The wanted jobs; an unknown one is an error."""
    unknown = wanted.join(jobs, key, "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} files are not in the corpus")
    return jobs.join(wanted.select(key).distinct(), key, "left_semi")


def pending(jobs: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    return jobs.join(done, key, "left_anti")


def write_cache(df: DataFrame, path: str) -> None:
    """Readings by engine; the writer commits all files or none."""
    df.withColumn("format", F.lit(FORMAT)).write.mode("append").partitionBy("engine").parquet(path)


def read_cache(spark: SparkSession, path: str, engine: str, jobs: DataFrame, missing: str = "error") -> DataFrame:
    """The engine's readings of the jobs; a missing one is an error, or empty if so asked."""
    held = spark.read.parquet(path).where(F.col("engine") == engine)
    if held.where(F.col("format") != FORMAT).limit(1).count():
        raise ValueError("the cache has another format")
    if missing == "error":
        cohort(held, jobs)
        return held.join(jobs.select("file"), "file", "left_semi")
    return jobs.select("file").join(held, "file", "left")


def resume(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Predictions written so far: lines that parse and hold no error."""
    full = T.StructType([*schema.fields, T.StructField("_error", T.StringType()), T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    return rows.where("_corrupt is null and coalesce(_error, '') = ''").drop("_corrupt", "_error")


def jobs(labels: DataFrame) -> DataFrame:
    """(file, doc_type, variant) of labelled records with their stem; a stem that belongs to no type gives no job."""
    known = [(t.label_file, t.name, t.variant_key) for t in TYPES.values()]
    kind, variant = F.lit(None).cast("string"), F.lit("")
    for stem, name, key in known:
        kind = F.when(F.col("stem") == stem, name).otherwise(kind)
        if key and key in labels.columns:
            variant = F.when(F.col("stem") == stem, F.coalesce(F.col(key), F.lit(""))).otherwise(variant)
    return labels.select("file", kind.alias("doc_type"), variant.alias("variant")).where("doc_type is not null")


def from_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of a splitter's manifest: their files only, as the truth beside them must not be seen."""
    return spark.read.schema("file string").json(path).where("file is not null")


def manifest(pieces: DataFrame) -> DataFrame:
    """Rows of `split.match` with a name for each piece."""
    name = F.format_string("%s#%d-%d", F.col("file").cast("string"), F.col("first_page").cast("bigint"), F.col("last_page").cast("bigint"))
    return pieces.withColumn("source", F.col("file")).withColumn("file", name)


def write_report(df: DataFrame, path: str, kind: str, version: str = "1") -> None:
    """A report as JSON lines, each with its kind and version."""
    body = F.to_json(F.struct(F.lit(kind).alias("report"), F.lit(version).alias("version"), F.struct(*df.columns).alias("row")))
    df.select(body.alias("value")).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType, version: str = "1") -> DataFrame:
    """The rows of a report; one of another version is an error."""
    whole = T.StructType([T.StructField("report", T.StringType()), T.StructField("version", T.StringType()), T.StructField("row", schema)])
    rows = spark.read.schema(whole).json(path)
    if rows.where(~F.col("version").eqNullSafe(F.lit(version))).limit(1).count():
        raise ValueError("the report has another version")
    return rows.select("row.*")


def no_answers(truth: DataFrame, kind: str) -> DataFrame:
    """Predictions to test a score with: `none` (no rows), `empty` (keys only) or `self` (the truth)."""
    return {"none": truth.limit(0), "empty": truth.select("file"), "self": truth}[kind]
