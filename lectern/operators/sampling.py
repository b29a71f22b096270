"""Deterministic samples, holdouts and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, bucket: str, order: str, limit: int) -> DataFrame:
    """Round robin over buckets, those met first leading: the first of each, then the second, up to `limit`."""
    top = df.withColumn("_depth", F.row_number().over(Window.partitionBy(bucket).orderBy(order))).where(F.col("_depth") <= limit)
    first = top.groupBy(F.col(bucket).alias("_b")).agg(F.min(order).alias("_first"))
    rows = top.join(first, F.col(bucket).eqNullSafe(F.col("_b")))
    return rows.orderBy("_depth", "_first", order).limit(limit).drop("_b", "_first", "_depth")


def balance(df: DataFrame, groups: tuple[str, ...], order: str) -> DataFrame:
    """As many rows of each group as the rarest has."""
    rarest = df.groupBy(*groups).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_cap"))
    rows = df.withColumn("_k", F.row_number().over(Window.partitionBy(*groups).orderBy(order)))
    return rows.crossJoin(F.broadcast(rarest)).where("_k <= _cap").drop("_k", "_cap")  # one row


def held_out(df: DataFrame, label: str, key: str, k: int, seed: str = "di", design: str | None = None) -> DataFrame:
    """k rows of each label, the first by hash; with `design`, one of each design in turn, so that they spread over all."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    if not design:
        return df.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(by, key))).where(F.col("_k") <= k).drop("_k")
    # Only the first k of a design can be taken, so the second window sorts no more than these.
    depth = df.withColumn("_d", F.row_number().over(Window.partitionBy(label, design).orderBy(by, key))).where(F.col("_d") <= k)
    return depth.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy("_d", by, key))).where(F.col("_k") <= k).drop("_k", "_d")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    per = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return per.crossJoin(F.broadcast(whole)).select(label, "n", F.round(F.col("_all") / (F.col("_k") * F.greatest(F.lit(1), F.col("n"))), 4).alias("weight"))


def digest(*chunks: Column) -> Column:
    """First 16 hex digits of sha256 over chunks, each followed by a zero byte."""
    return F.substring(F.sha2(F.concat(*(F.concat(c, F.lit("\0")) for c in chunks)), 256), 1, 16)


def cohort_fingerprint(df: DataFrame, key: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint of a set of keys: order and repeats do not matter.

    Keys are first hashed to 256 partial fingerprints, so that no task holds all of them at full scale.
    """
    k = F.col(key).cast("string")
    rows = df.where(F.col(key).isNotNull()).select(*group, k.alias("_k")).distinct().withColumn("_p", F.substring(F.sha2("_k", 256), 1, 2))
    part = rows.groupBy(*group, "_p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_k")), "\0"), 256).alias("_h"), F.count("*").alias("_n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda s: F.concat(s["_p"], s["_h"])), "\0")
    return part.groupBy(*group).agg(F.sum("_n").alias("members"), F.substring(F.sha2(whole, 256), 1, 16).alias("fingerprint"))
