"""Operator 3: mixing sources to target weights by Pfair scheduling.

Weights are taken as they are, as exact fractions.  Block k of a source with
weight w (of a sum of 1) is released at floor(k / w) and due at
ceil((k + 1) / w); the earliest deadline first fills every slot and, as the
weights sum to 1, misses none, so after any number of slots each source is less
than one block from its target.  The schedule repeats after the weights' common
denominator.  The driver computes one period of it, or as many slots as the
mixture has if those are fewer, and never more than SLOTS: where both are
longer, the weights are first rounded to whole shares of SLOTS (by less than
one part in a million each, one share at least), so what is broadcast is
bounded.

A source's rows, in hash order of the key, form its blocks of `block` rows.
The mixture runs until every row has been placed once; smaller sources start
over meanwhile (a new epoch), so no row is lost.  Blocks of a source wrap
around its end, so that every block is full.

A null source is a source of its own, and null keys are as good as others.  A
source without weight (or with one of zero or less) has no place in the mixture:
its blocks follow after the last slot of the others, so that its rows are not
lost either.  An empty table gives an empty result.  Repeated rows are placed
separately; rows of a key that occurs more than RANK_ROWS times are spread by
their hash and the input partition that holds them, so that no task ranks all.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Mapping
from fractions import Fraction
from math import floor, gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import partitions

PERIOD = 1000
#: Slots that the driver computes and broadcasts at most.
SLOTS = 1 << 20
BLOCK = 64
#: Rows that one task ranks at a time.
RANK_ROWS = 4096
#: Copies of a row that one task makes, and heavily repeated keys that are broadcast.
COPIES = 1024
HOT = 100_000


def shares(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole shares, at least 1 each, that sum to the period (raised to the number of sources if need be)."""
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    period = max(period, len(names))
    good = {s: max(0.0, float(weights[s] or 0)) for s in names}
    total = sum(good.values())
    if not total:
        good, total = dict.fromkeys(names, 1.0), float(len(names))
    out = {s: max(1, floor(good[s] / total * period)) for s in names}
    # Largest remainders first; what the minimum of one took comes from the largest shares.
    order = sorted(names, key=lambda s: out[s] - good[s] / total * period)
    spare = period - sum(out.values())
    for i in range(max(0, spare)):
        out[order[i % len(order)]] += 1
    for _ in range(max(0, -spare)):
        out[max(names, key=lambda s: out[s])] -= 1
    return out


def exact(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """The weights above zero as whole numbers of the same ratios, without a common factor; equal ones if none is above zero."""
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    good = {s: Fraction(weights[s]) for s in names if weights[s] and weights[s] > 0} or dict.fromkeys(names, Fraction(1))
    common = lcm(*(w.denominator for w in good.values()))
    whole = {s: int(w * common) for s, w in good.items()}
    least = gcd(*whole.values())
    return {s: w // least for s, w in whole.items()}


def _slots(share: Mapping[str | None, int], need: Mapping[str | None, int] | None = None) -> tuple[array, array]:
    """Source (by its place in share) and block of each slot by earliest deadline among the released blocks, for
    one period or, if that is shorter, until each source has placed as many blocks as it needs."""
    period, names = sum(share.values()), list(share)
    q = [share[s] for s in names]
    left = [need[s] if need else q[i] for i, s in enumerate(names)]
    open_sources = sum(n > 0 for n in left)
    waiting = [(0, -(-period // w), i, 0) for i, w in enumerate(q)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    sources, blocks = array("i"), array("q")
    slot = 0
    while slot < period and open_sources:
        while waiting and waiting[0][0] <= slot:
            _, due, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, k))
        due, i, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        sources.append(i)
        blocks.append(k)
        left[i] -= 1
        open_sources -= left[i] == 0
        if k + 1 < q[i]:
            heapq.heappush(waiting, ((k + 1) * period // q[i], -(-(k + 2) * period // q[i]), i, k + 1))
        slot += 1
    return sources, blocks


def schedule(share: Mapping[str | None, int]) -> list[tuple[str | None, int]]:
    """(source, block) of each slot of one period."""
    names = list(share)
    return [(names[i], k) for i, k in zip(*_slots(share), strict=True)]


def flattened(counts: Mapping[str | None, int], power: float = 0.7) -> dict[str | None, float]:
    """Target weights between the sources' own shares (1) and equal ones (0)."""
    return {s: n**power for s, n in counts.items()}


def _plan(counts: Mapping[str | None, int], weights: Mapping[str | None, float] | None, block: int, period: int | None):
    """(slots by source and block, a row for each source, number of slots) of the mixture."""
    given = {s: (weights or {}).get(s, 0) for s in counts} if weights else flattened(counts)
    share = shares(given, period) if period else exact(given)
    need = {s: -(-n // block) for s, n in counts.items()}
    total = sum(share.values())
    # No source needs more slots than its blocks by its weight, and one period more for the last deadline.
    longest = max((-(-need[s] * total // w) for s, w in share.items()), default=0) + len(share)
    if min(total, longest) > SLOTS:
        share = shares({s: w / total for s, w in share.items()}, SLOTS)
    slots, table, first = [], [], 0
    # Sources that have no share come after the others, in equal ones.
    for share in (share, {s: 1 for s in counts if s not in share}):
        names, period = list(share), sum(share.values())
        sources, blocks = (np.asarray(x, np.int64) for x in _slots(share, need))
        ends = np.flatnonzero(blocks == np.asarray([(need[s] - 1) % share[s] for s in names], np.int64)[sources])
        # The slot after which every source has placed each of its rows.
        last = max(((need[s] - 1) // share[s] * period + int(at) + 1 for s, at in ((names[sources[at]], at) for at in ends)), default=0)
        many = np.bincount(sources[: last % period] if last else sources, minlength=len(names)) if names else ()
        placed = {s: last // period * share[s] + int(n) for s, n in zip(names, many, strict=True)}
        # A schedule that ends before its period never repeats.
        again = len(sources) == period
        slots.append((sources + len(table), blocks, np.arange(len(sources))))
        table += [(len(table) + i, s, counts[s], share[s] if again else placed[s], first, period if again else len(sources), placed[s] * block, max(1, -(-counts[s] // RANK_ROWS))) for i, s in enumerate(names)]
        first += last
    return [np.concatenate(x) for x in zip(*slots, strict=True)], table, first


def _spread(rows: DataFrame) -> DataFrame:
    """mix_h of keys that are repeated more often than one task should rank also tells their rows and input partitions apart."""
    hot = rows.groupBy(F.col("mix_s").alias("s1"), F.col("mix_h").alias("h1")).agg(F.count("*").alias("c1")).where(F.col("c1") > RANK_ROWS).drop("c1")
    n = hot.count()
    if not n:
        return rows
    # Few keys are repeated as often as that; if not, Spark chooses how to join them.
    hot = hot.withColumn("hot", F.lit(True))
    rows = rows.withColumn("mix_in", F.spark_partition_id()).join(F.broadcast(hot) if n <= HOT else hot, F.col("mix_s").eqNullSafe(F.col("s1")) & (F.col("mix_h") == F.col("h1")), "left")
    return rows.withColumn("mix_h", F.when(F.col("hot"), F.xxhash64("mix_h", "mix_r", "mix_in")).otherwise(F.col("mix_h"))).drop("s1", "h1", "hot", "mix_in")


def mix(df: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id",
        block: int = BLOCK, period: int | None = None) -> DataFrame:
    """The rows of df with mix_epoch, mix_block, mix_slot and mix_position.

    mix_position orders the mixture: slot by slot, and by place inside a block.
    Columns of df with these names are replaced.
    Sources are few (their counts and shares live on the driver); rows are not
    moved there.  With a `period`, the weights are rounded to shares() of it first.
    """
    return _mixed(df, weights, source, key, block, period)[0]


def ordered(df: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The rows of df alone, all columns as they were, in the mixture's order: partitions are
    consecutive ranges of positions, and rows are sorted inside them."""
    spark = df.sparkSession
    # One column, so that no name can clash.
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[source].alias("source"), df[key].alias("doc_id"))
    out, total = _mixed(rows, weights, "source", "doc_id", block, None)
    n = partitions(spark)
    part = F.floor(F.col("mix_position") * n / F.lit(max(total, 1))).cast("int")
    return out.repartitionById(n, part).sortWithinPartitions("mix_position").select("row.*")


def _mixed(df, weights, source, key, block, period) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.groupBy(df[source].cast("string").alias("s")).agg(F.count("*").alias("n")).collect()}
    added = ("mix_epoch", "mix_block", "mix_slot", "mix_position")
    own = [c for c in df.columns if c not in added]
    if not counts:
        return df.select(*own, *(F.lit(0).cast("bigint").alias(c) for c in added)), 0
    slots, table, last = _plan(counts, weights, block, period)
    many = any(t[6] > COPIES * t[2] for t in table)
    slots = spark.createDataFrame(pa.table(slots, ["t3", "k3", "mix_i"]))
    table = spark.createDataFrame(
        table, "mix_t bigint, t_s string, mix_n bigint, mix_q bigint, mix_first bigint, mix_period bigint, mix_rows bigint, mix_buckets bigint",
    )
    whole = F.struct(*[df[c] for c in own])
    # Maps have no hash; what else the rows hold tells them apart.
    hashed = [df[c] for c in own if "map<" not in df.schema[c].dataType.simpleString()]
    rows = df.select(whole.alias("mix_row"), df[source].cast("string").alias("mix_s"), df[key].cast("string").alias("mix_key"), F.xxhash64(df[key].cast("string")).alias("mix_h"), F.xxhash64(*hashed).alias("mix_r"))
    rows = _spread(rows)
    # Both tables are bounded: a row for each source, and SLOTS slots at most.
    rows = rows.join(F.broadcast(table), F.col("mix_s").eqNullSafe(F.col("t_s"))).drop("t_s")
    # A place by hash: the range of the hash cuts a source into buckets of about RANK_ROWS rows.
    unit = F.col("mix_h").cast("double") / F.lit(2.0**64) + 0.5
    rows = rows.withColumn("mix_b", F.least(F.floor(unit * F.col("mix_buckets")), F.col("mix_buckets") - 1).cast("bigint"))
    sizes = rows.groupBy("mix_s", "mix_b").agg(F.count("*").alias("mix_size"))
    before = F.sum("mix_size").over(Window.partitionBy("mix_s").orderBy("mix_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("mix_s").alias("s2"), F.col("mix_b").alias("b2"), F.coalesce(before, F.lit(0)).alias("mix_before"))
    rank = F.row_number().over(Window.partitionBy("mix_s", "mix_b").orderBy("mix_h", "mix_key", "mix_r"))
    rows = rows.withColumn("mix_rank", rank - 1)
    rows = rows.join(sizes, F.col("mix_s").eqNullSafe(F.col("s2")) & (F.col("mix_b") == F.col("b2"))).drop("s2", "b2")
    rows = rows.withColumn("mix_at", F.col("mix_before") + F.col("mix_rank"))
    # Times that this row comes up among the rows that its source places.
    rows = rows.withColumn("mix_times", F.floor((F.col("mix_rows") - 1 - F.col("mix_at")) / F.col("mix_n")).cast("int"))
    epochs = F.explode(F.sequence(F.lit(0), "mix_times"))
    if many:
        # Rows of sources that start over very often are copied by many tasks, a bounded number of times by each.
        often = F.col("mix_rows") > COPIES * F.col("mix_n")
        few, rows = rows.where(~often).withColumn("mix_epoch", epochs), rows.where(often)
        rows = rows.withColumn("mix_from", F.explode(F.sequence(F.lit(0), "mix_times", F.lit(COPIES)))).repartition("mix_s", "mix_at", "mix_from")
        rows = rows.withColumn("mix_epoch", F.explode(F.sequence("mix_from", F.least("mix_times", F.col("mix_from") + COPIES - 1)))).drop("mix_from")
        rows = rows.unionByName(few)
    else:
        rows = rows.withColumn("mix_epoch", epochs)
    rows = rows.withColumn("mix_epoch", F.col("mix_epoch").cast("bigint"))
    place = F.col("mix_epoch") * F.col("mix_n") + F.col("mix_at")
    rows = rows.withColumn("mix_block", F.floor(place / F.lit(block)).cast("bigint")).withColumn("mix_in", place % block)
    rows = rows.withColumn("mix_k", F.col("mix_block") % F.col("mix_q"))
    rows = rows.join(F.broadcast(slots), (F.col("mix_t") == F.col("t3")) & (F.col("mix_k") == F.col("k3"))).drop("t3", "k3")
    rows = rows.withColumn("mix_slot", F.col("mix_first") + F.floor(F.col("mix_block") / F.col("mix_q")).cast("bigint") * F.col("mix_period") + F.col("mix_i"))
    rows = rows.withColumn("mix_position", F.col("mix_slot") * block + F.col("mix_in"))
    return rows.select(*[F.col("mix_row")[c].alias(c) for c in own], *added), last * block


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)
