"""Paired statistics of repair arms."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import rate, wilson
from ..session import ship, workspace
from .measure import before, lookup

ROUNDS, SEED, EPSILON = 4000, 20260828, 1e-3
# Which moves of a field are damage, repair, or a wrong value made visible.
DAMAGING = (
    ("right", "wrong"), ("right", "missed"), ("right", "fabricated"), ("missed", "fabricated"), ("correctly_blank", "fabricated"), ("wrong", "fabricated"),
)
REPAIRING = (("wrong", "right"), ("missed", "right"), ("fabricated", "right"))
SAFER = (("wrong", "missed"), ("fabricated", "missed"))


def _band(sums: list[tuple[str, float, int]], rounds: int, seed: int) -> tuple[float, float] | None:
    if len(sums) < 3:
        return None
    sums = [(s, n) for _, s, n in sorted(sums)]
    pick = random.Random(seed)
    means = []
    for _ in range(rounds):
        some = [sums[pick.randrange(len(sums))] for _ in sums]
        means.append(sum(s for s, _ in some) / sum(n for _, n in some))
    means.sort()
    return round(means[int(0.025 * rounds)], 4), round(means[int(0.975 * rounds)], 4)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _bootstrap(rows: pd.Series) -> pd.DataFrame:
    out = [_band([(r["cluster"], r["total"], r["n"]) for r in x], ROUNDS, SEED) if x is not None else None for x in rows]
    return pd.DataFrame({"low": [o and o[0] for o in out], "high": [o and o[1] for o in out]}, dtype="float64")


def bootstrap(rows: Column) -> Column:
    """95% interval of the mean of array<struct<cluster, total, n>>, resampling clusters in key order; null for under three."""
    ship()
    return _bootstrap(rows)


def interval(df: DataFrame, value: Column, cluster: str = "source", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, clusters, low, high): the bootstrap interval of a mean over clusters.

    Clusters are summed before they are gathered, so an array has one entry for each of them.
    """
    per = df.where(value.isNotNull()).groupBy(*by, F.col(cluster).cast("string").alias("cluster")).agg(F.round(F.sum(value), 9).alias("total"), F.count("*").alias("n"))
    per = per.withColumn("cluster", F.coalesce("cluster", F.lit("")))
    rows = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cluster", "total", "n"))).alias("r"))
    return rows.select(*by, F.size("r").alias("clusters"), bootstrap(F.col("r")).alias("ci")).select(*by, "clusters", "ci.low", "ci.high")


def paired(a: DataFrame, b: DataFrame, key: str = "file", value: str = "value", cluster: str = "source") -> DataFrame:
    """Per-file difference of two arms: mean, better, worse, tied."""
    d = a.select(key, cluster, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).withColumn("d", F.col("x") - F.col("y"))
    return d.agg(*_sides(F.col("d")))


def _sides(d: Column) -> list[Column]:
    return [
        F.count("*").alias("files"), F.round(F.avg(d), 4).alias("mean_delta"), F.count_if(d > EPSILON).alias("better"),
        F.count_if(d < -EPSILON).alias("worse"), F.count_if(F.abs(d) <= EPSILON).alias("tied"),
    ]


def no_repair(outcomes: DataFrame) -> DataFrame:
    """The control arm: every document of the arms stays as it was."""
    kept = {"after": F.col("before"), "correct_after": F.col("correct_before"), "gates_after": F.col("gates_before"), "attempts": F.lit(0), "error": F.lit(None).cast("string")}
    same = outcomes.withColumns({c: v.cast(outcomes.schema[c].dataType) for c, v in kept.items() if c in outcomes.columns})
    return same.withColumn("arm", F.lit("no_repair")).dropDuplicates(["file"])


def effects(outcomes: DataFrame) -> DataFrame:
    """Outcomes with delta, improved, damaged and cleared.

    A gain in counted fields decides where both counts are known, else a change of the ratio beyond a thousandth;
    a document without a gate that fires has none to clear.
    """
    delta, gain = F.col("after") - F.col("before"), F.col("correct_after") - F.col("correct_before")
    return outcomes.withColumns({
        "delta": delta, "improved": F.coalesce(gain > 0, delta > EPSILON), "damaged": F.coalesce(gain < 0, delta < -EPSILON),
        "cleared": (F.col("gates_after") == 0) & (F.col("gates_before") > 0),
    })


def score_arms(outcomes: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """One row for each arm (or group `by`): cost, failures, net change by document and by field, gains, losses, tail, cleared gates.

    outcomes: (arm, file, source, before, after, correct_before, correct_after, fields, gates_before, gates_after, attempts, error).
    """
    e = effects(outcomes)
    n, ran = F.count("*"), F.coalesce(F.col("error"), F.lit("")) == ""
    up, down = F.count_if("improved"), F.count_if("damaged")
    counted = F.count_if(F.col("correct_before").isNotNull() & F.col("correct_after").isNotNull()) == n
    gained = F.sum(F.col("correct_after") - F.col("correct_before"))
    out = e.groupBy(*by).agg(
        n.alias("documents"), F.sum("attempts").alias("attempts"), F.count_if(~ran).alias("failed"), rate(F.count_if(~ran), n).alias("failure_rate"),
        F.round(F.avg("before"), 4).alias("accuracy_before"), F.round(F.avg("after"), 4).alias("accuracy_after"), F.round(F.avg("delta"), 4).alias("net_delta"),
        F.when(counted, rate(gained, F.sum("fields"))).alias("net_delta_field_weighted"), F.round(F.avg(F.when(ran, F.col("delta"))), 4).alias("net_delta_when_it_ran"),
        up.alias("improved"), down.alias("damaged"), (n - up - down).alias("unchanged"), rate(up, n).alias("improved_rate"), rate(down, n).alias("damaged_rate"),
        wilson(up, n).alias("improved_rate_ci"), wilson(down, n).alias("damaged_rate_ci"),
        F.round(F.avg(F.when(F.col("improved"), F.col("delta"))), 4).alias("gain_when_improved"), F.round(F.avg(F.when(F.col("damaged"), F.col("delta"))), 4).alias("loss_when_damaged"),
        F.count_if("cleared").alias("gates_clear"), rate(F.count_if("cleared"), n).alias("gates_clear_rate"), F.countDistinct("source").alias("sources"),
    )
    tail = ordered(e.withColumn("delta", F.round("delta", 9)), by, "delta")
    return lookup(out, tail.select(*by, *(F.round(c, 4).alias(f"{c}_delta") for c in ("median", "p10", "worst"))), by)


def against(outcomes: DataFrame) -> DataFrame:
    """Every arm beside the two controls, paired by file: doing nothing, and the blind arm of the same budget.

    (arm, control, files, mean_delta, better, worse, tied, clusters, low, high, resolvable); an arm `name@k` has the
    blind arm `rerun@k`.  Arms without that control have no row for it.
    """
    blind = F.col("arm").rlike("^rerun(@|$)")
    budget = F.regexp_extract("arm", "(@.*)$", 1)
    controls = F.when(F.col("arm") == "no_repair", F.array().cast("array<string>")).when(blind, F.array(F.lit("no_repair"))).otherwise(F.array(F.lit("no_repair"), F.concat(F.lit("rerun"), budget)))
    rows = outcomes.select("arm", "file", "source", (F.col("after") - F.col("before")).alias("x"), F.explode(controls).alias("control"))
    other = outcomes.select(F.col("arm").alias("_arm"), F.col("file").alias("_file"), (F.col("after") - F.col("before")).alias("y"))
    d = rows.join(other, (F.col("control") == F.col("_arm")) & (F.col("file") == F.col("_file"))).select("arm", "control", "source", (F.col("x") - F.col("y")).alias("d"))
    by = ("arm", "control")
    out = lookup(d.groupBy(*by).agg(*_sides(F.col("d"))), interval(d, F.col("d"), by=by), by)
    return out.withColumn("resolvable", (F.col("low") > 0) | (F.col("high") < 0))


def separated(a: Column, b: Column) -> Column:
    """Do two intervals struct<low, high> fail to overlap?  A missing one never does."""
    return F.coalesce((b["low"] > a["high"]) | (a["low"] > b["high"]), F.lit(False))


def ordered(df: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """(by, median, p10, worst): upper median, lower tenth and least of each group by position in its sorted values.

    Positions are found from counts of distinct values, so no group is gathered.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    n = per.groupBy(*by).agg(F.sum("k").alias("_n"))
    rows = lookup(before(per, by, value), n, by)
    at = {"median": F.floor(F.col("_n") / 2), "p10": F.greatest(F.lit(0), F.floor(F.col("_n") * 0.1) - 1), "worst": F.lit(0)}
    return rows.groupBy(*by).agg(*(F.min(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("k")), F.col(value))).alias(name) for name, p in at.items()))


def effect(was: Column, now: Column) -> Column:
    """What a field's move means; a wrong value that turns visibly empty is neither repaired nor damaged."""
    def moves(pairs):
        return F.concat_ws(">", was, now).isin(*(f"{a}>{b}" for a, b in pairs))

    return F.when(moves(DAMAGING), "damaging").when(moves(REPAIRING), "repairing").when(moves(SAFER), "safer").otherwise("neutral")


def transitions(df: DataFrame, before: str, after: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.where(F.col(after).isNotNull()).groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("n"), F.round(F.sum(w), 4).alias("weighted"))
    return rows.withColumn("effect", effect(F.col("before"), F.col("after")))


def transition_totals(moved: DataFrame) -> DataFrame:
    """Fields repaired, damaged, made visible and invented, plain and weighted, from the rows of `transitions`."""
    def total(kind, column):
        return F.coalesce(F.sum(F.when(F.col("effect") == kind, F.col(column))), F.lit(0))

    plain, weighted = ({k: total(k, c) for k in ("repairing", "damaging", "safer")} for c in ("n", "weighted"))
    invented = F.coalesce(F.sum(F.when((F.col("after") == "fabricated") & (F.col("before") != "fabricated"), F.col("n"))), F.lit(0))
    return moved.agg(
        plain["repairing"].alias("fields_repaired"), plain["damaging"].alias("fields_damaged"), plain["safer"].alias("fields_made_visible"),
        (plain["repairing"] - plain["damaging"]).alias("net_fields"), F.round(weighted["repairing"], 2).alias("fields_repaired_weighted"),
        F.round(weighted["damaging"], 2).alias("fields_damaged_weighted"), F.round(weighted["repairing"] - weighted["damaging"], 2).alias("net_fields_weighted"), invented.alias("invented"),
    )


def worst_fields(df: DataFrame, field: str, before: str, after: str, most: int = 10) -> DataFrame:
    """The fields that lost most: (field, damaged, repaired), ties by name."""
    kind = effect(F.col(before), F.col(after))
    rows = df.groupBy(F.col(field).alias("field")).agg(F.count_if(kind == "damaging").alias("damaged"), F.count_if(kind == "repairing").alias("repaired"), F.count_if(kind == "safer").alias("safer"))
    moved = rows.where(F.col("damaged") + F.col("repaired") + F.col("safer") > 0).drop("safer")
    return moved.orderBy((F.col("damaged") - F.col("repaired")).desc(), "field").limit(most)


def risk_ratio(df: DataFrame, clear: str, damaged: str) -> DataFrame:
    """Share of cleared gates among damaged and other documents, and their ratio with Katz's interval."""
    c, d = F.col(clear), F.col(damaged)
    a, n1, b, n0 = F.count_if(c & d), F.count_if(d), F.count_if(c & ~d), F.count_if(~d)
    got = df.agg(a.alias("a"), n1.alias("n1"), b.alias("b"), n0.alias("n0"))
    ratio = F.try_divide(F.col("a") / F.col("n1"), F.col("b") / F.col("n0"))
    se = F.sqrt(F.try_divide(F.lit(1.0), F.col("a")) - F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("b")) - F.try_divide(F.lit(1.0), F.col("n0")))
    return got.select(
        F.col("a").alias("cleared_damaged"), F.col("n1").alias("damaged"), F.col("b").alias("cleared_other"), F.col("n0").alias("other"), F.round(ratio, 4).alias("ratio"),
        F.round(ratio * F.exp(-1.96 * se), 4).alias("low"), F.round(ratio * F.exp(1.96 * se), 4).alias("high"),
    )


def documents_needed(value: Column, cluster: Column, smallest: float) -> Column:
    """Documents to resolve a difference, with the clustering's design effect."""
    n, k = F.count(value), F.countDistinct(cluster)
    return (F.floor(7.849 * F.var_samp(value) / (smallest * smallest) * (n / k)) + 1).cast("bigint")


def budget_curve(df: DataFrame, arm: str = "arm", step: str = "step", delta: str = "delta") -> DataFrame:
    return df.groupBy(arm, step).agg(F.count("*").alias("documents"), F.round(F.avg(delta), 4).alias("mean_delta"), rate(F.count_if(F.col(delta) > 0), F.count("*")).alias("improved_share"))


def run_arm(
    name: str, candidates: DataFrame, attempt: Callable[[DataFrame], DataFrame], review: Callable[[DataFrame], DataFrame], grade: Callable[[DataFrame], DataFrame],
    budget: int = 1, iterative: bool = False,
) -> DataFrame:
    """Outcomes of an arm after 1 to `budget` attempts, as `score_arms` reads them; the arm is `name@k` where the budget is larger than 1.

    candidates: (file, source, record, complaints, before, correct_before, fields, gates_before), one row a file.
    attempt: (file, record, complaints) -> (file, produced, error), no record or no row where it fails.
    review: (file, record) -> (file, complaints, gates).  grade: (file, record) -> (file, after, correct_after).
    An iterative arm goes on from its own last answer and complaints about that one; any other gets the first record each time.
    A failed attempt leaves the record as it was, and a document without a grade its score.  Each step is written, so no
    answer is asked for twice, whatever is lost.
    """
    spark = candidates.sparkSession
    folder, steps = workspace(spark), []
    first = candidates.select("file", "record", "complaints")
    now = first.withColumn("broke", F.lit(""))
    for k in range(1, budget + 1):
        tried = attempt(now.select("file", "record", "complaints")).select(F.col("file").alias("_f"), "produced", "error")
        why = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("declined"))
        made = now.join(tried, F.col("file") == F.col("_f"), "left").select(
            "file", F.coalesce("produced", "record").alias("record"), F.when(F.col("broke") != "", F.col("broke")).when(F.col("produced").isNull(), why).otherwise("").alias("broke"),
        )
        made.write.parquet(f"{folder}/made{k}")
        made = spark.read.parquet(f"{folder}/made{k}")
        told = made.join(review(made.select("file", "record")).select(F.col("file").alias("_f"), "complaints", "gates"), F.col("file") == F.col("_f"), "left").drop("_f")
        graded = grade(made.select("file", "record")).select(F.col("file").alias("_g"), "after", "correct_after")
        rows = candidates.drop("record", "complaints").join(told.select(F.col("file").alias("_f"), "gates", "broke"), F.col("file") == F.col("_f")).join(graded, F.col("file") == F.col("_g"), "left")
        lost = F.col("after").isNull()
        steps.append(rows.select(
            F.lit(f"{name}@{k}" if budget > 1 else name).alias("arm"), "file", "source", "before", F.coalesce("after", "before").alias("after"), "correct_before",
            F.when(lost, F.col("correct_before")).otherwise(F.col("correct_after")).alias("correct_after"), "fields", "gates_before", F.coalesce("gates", F.lit(0)).alias("gates_after"),
            F.lit(k).alias("attempts"), F.when(F.col("broke") != "", F.col("broke")).when(lost, "not gradable").otherwise("").alias("error"),
        ))
        now = told.select("file", "record", "complaints", "broke") if iterative else first.join(made.select("file", "broke"), "file")
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out
