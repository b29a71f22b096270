"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet in the shared folder and reads again for the next one.

All stages but the last return the columns of docs as they were, whatever their
names; null ids and texts, repeated rows and empty tables pass through all of
them.  The mixing stage repeats rows of smaller sources on purpose: about 1.66
rows come out for each that goes in on the check tables, the others none less.
The last one returns texts with their ids and their place in the mixture.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import jaccard, mixing, quality, spm, substring
from lectern.llm._common import durable

#: SQL can't express the fitted stages, the join and the tokenizer.
ORACLE_SQL = None


def same_columns(stage):
    """The columns that stages use keep their names; others go by number meanwhile, so that none clashes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in ("doc_id", "text", "source", "n_chars") else f"_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run


@same_columns
def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = quality.score(docs, quality.learn(spark, sf_dir, docs), keep=tuple(docs.columns))
    return scored.where("predicted = 1").select(*docs.columns)


@same_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets at 0.8 or more
    stays: the one with the least id.  Documents without words all stay."""
    found = durable(jaccard.join(docs, 5, 80, 100), spark)
    first = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "doc_id", "h", "class")
    alone = found.where("n_shingles = 0").select("doc_id", "h", F.lit(False).alias("once"))
    # A component is known by its id; rows without an id, which have no id to share, by their class.
    best = found.where("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("class"))).agg(F.min(first).alias("m"))
    keep = alone.distinct().union(best.select("m.doc_id", "m.h", F.lit(True))).select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"), "once")
    rows = docs.select(F.struct(*docs.columns).alias("own"), docs["doc_id"].alias("r_id"), F.xxhash64(docs["text"]).alias("r_h"))
    rows = rows.join(keep, (F.col("r_h") == F.col("k_h")) & F.col("r_id").eqNullSafe(F.col("k_id")))
    # Repeated rows share id and text; of those only one stays.
    many = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h")).agg(F.count("*").alias("m")).where("m > 1")
    rows = rows.join(many, (F.col("r_h") == F.col("m_h")) & F.col("r_id").eqNullSafe(F.col("m_id")), "left")
    single = rows.where("m is null or not once").select("own.*")
    return single.union(rows.where("m is not null and once").dropDuplicates(["r_id", "r_h"]).select("own.*"))


@same_columns
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur elsewhere are cut out; n_chars, if there is such a column, follows."""
    out = substring.remove(docs)
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@same_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in flattened shares, smaller ones starting over; files, and rows in them, are in the mixture's order."""
    return mixing.ordered(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, file and row (the place in the mixture that was read), text, ids and their digests."""
    try:
        file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
        docs = docs.select("doc_id", "text", file.cast("int").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # docs are no rows of Parquet files, so they have no place
        docs = docs.select("doc_id", "text", F.lit(None).cast("int").alias("file"), F.lit(None).cast("bigint").alias("row"))
    return spm.digest(docs, ids=True, keep=("file", "row", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), spark)
    return docs
