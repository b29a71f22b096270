"""Shared plumbing: durable intermediate results, batch sizes, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows per Arrow batch; with whole texts a batch stays at some megabytes.
BATCH_ROWS = 1024


def arrow(spark: SparkSession) -> None:
    """Batch limits for operators that hand whole texts to Python, and their workers' environment."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)


def release() -> None:
    """Give freed memory back to the system, since workers wait between tasks and go on to other operators."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A function over batches that releases what its task freed."""

    def then_release(batches):
        yield from run(batches)
        release()

    return then_release


def tidied(out):
    """What a function over one group returned, after what it freed is released."""
    release()
    return out


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as a table read back has them."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    return T.MapType(nullable(kind.keyType), nullable(kind.valueType)) if isinstance(kind, T.MapType) else kind


def schema(df: DataFrame, keep, more: str) -> T.StructType:
    """The columns `keep` of df, whatever their names, and more ones."""
    return T.StructType([*(T.StructField(c, nullable(df.schema[c].dataType)) for c in keep), *T.StructType.fromDDL(more).fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local") and sc._jsc.sc().getCheckpointDir().isEmpty():
        raise RuntimeError("executors share no folder: set spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), f"lectern-{uuid.uuid4().hex}"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame, spark: SparkSession, few: bool = False, level: int = 3) -> DataFrame:
    """Cut the lineage through a table in the shared folder, read back from there.

    `few`: narrow rows that need no file for each shuffle partition; `level`: of compression.
    """
    if few:
        df = df.repartition(max(1, partitions(spark) // 16))
    path = f"{shared_dir(spark).rstrip('/')}/lectern-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def discard(df: DataFrame, spark: SparkSession) -> None:
    """Delete a table of durable() that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df._lectern_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def components(spark: SparkSession, edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of edges (u, v): root is the least node reachable.

    Alternates large-star and small-star steps; each reads and writes rows in
    proportion to the edges, hubs included, and ends up on disk.
    """
    now = durable(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), spark, few=True
    )
    mark = None
    for _ in range(most):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        before, now = now, durable(small, spark, few=True)
        discard(before, spark)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
