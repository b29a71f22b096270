"""Review routing: gates, decisions, their score, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import hash_fraction, rate

# Signal, side, setting of each gate, and the default thresholds.
GATES = (
    ("classifier_confidence", "below", "classifier_floor"), ("ocr_confidence", "below", "ocr_confidence_floor"), ("words_per_page", "below", "words_floor"),
    ("blank_share", "above", "blank_share_ceiling"), ("validator_errors", "above", "validator_errors_ceiling"),
)
DEFAULTS = {"classifier_floor": 0.85, "blank_share_ceiling": 0.0, "ocr_confidence_floor": 0.0, "words_floor": 0.0, "validator_errors_ceiling": 0.0}


def enabled(setting: str, threshold: float | None) -> bool:
    """Zero switches a gate off, but for validator errors, where it means any error."""
    return threshold is not None and (threshold >= 0 if setting == "validator_errors_ceiling" else threshold > 0)


def reasons(signals: dict[str, Column], thresholds: dict[str, float] | None = None) -> Column:
    """array<struct<gate, value, threshold, direction>> of the gates that fire; a missing value never does."""
    limits = DEFAULTS | (thresholds or {})
    out = []
    for signal, side, setting in GATES:
        if signal in signals and enabled(setting, limits[setting]):
            v, limit = signals[signal].cast("double"), F.lit(float(limits[setting]))
            fired = v > limit if side == "above" else v < limit
            out.append(F.when(fired, F.struct(F.lit(signal).alias("gate"), v.alias("value"), limit.alias("threshold"), F.lit(side).alias("direction"))))
    kind = "array<struct<gate:string,value:double,threshold:double,direction:string>>"
    return F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast(kind)


def decide(df: DataFrame, signals: dict[str, Column], thresholds: dict[str, float] | None = None) -> DataFrame:
    df = df.withColumn("reasons", reasons(signals, thresholds))
    return df.withColumn("action", F.when(F.size("reasons") > 0, "review").otherwise("accept"))


def score(decided: DataFrame, outcome: str) -> DataFrame:
    ok, o = F.col("action") == "accept", F.col(outcome)
    n, acc = F.count("*"), F.count_if(ok)
    good, base = F.avg(F.when(ok, o)), F.avg(o)
    return decided.agg(
        n.alias("documents"), acc.alias("accepted"), (n - acc).alias("reviewed"), rate(acc, n).alias("coverage"), F.round(good, 4).alias("accepted_accuracy"),
        F.round(F.avg(F.when(~ok, o)), 4).alias("reviewed_accuracy"), F.round(base, 4).alias("baseline"), F.round(good - base, 4).alias("lift"),
        F.count_if(~ok & (o >= 1)).alias("reviewed_but_perfect"), F.count_if(ok & (o < 1)).alias("accepted_but_wrong"),
    )


def per_gate(decided: DataFrame, outcome: str) -> DataFrame:
    rows = decided.select(F.explode("reasons").alias("r"), F.size("reasons").alias("n"), F.col(outcome).alias("o"))
    return rows.groupBy(F.col("r.gate").alias("gate")).agg(F.count("*").alias("fired"), F.count_if(F.col("n") == 1).alias("only_reason"), F.round(F.avg("o"), 4).alias("mean_outcome"))


def explore(key: Column, share: float, seed: str = "di") -> Column:
    """An audit sample of accepted documents that every run draws alike."""
    return F.lit(False) if share <= 0 else F.lit(True) if share >= 1 else hash_fraction(key, seed) < share


def queue(decided: DataFrame, key: str, share: float, seed: str = "di") -> DataFrame:
    picked = F.when(F.col("action") == "review", "gate").when(explore(F.col(key).cast("string"), share, seed), "exploration")
    return decided.withColumn("selection", picked).where("selection is not null")


def what_if(df: DataFrame, grid: DataFrame, signal: str, side: str, outcome: str) -> DataFrame:
    """The score at each threshold of a small grid (column threshold)."""
    rows = df.crossJoin(F.broadcast(grid))
    fired = F.coalesce(F.col(signal) > F.col("threshold") if side == "above" else F.col(signal) < F.col("threshold"), F.lit(False))
    return rows.groupBy("threshold").agg(F.count_if(~fired).alias("accepted"), F.round(F.avg(F.when(~fired, F.col(outcome))), 4).alias("accepted_accuracy"))


def training_rows(queued: DataFrame, outcomes: DataFrame, key: str = "file") -> DataFrame:
    """A row for each reviewed field that the reviewer was sure of."""
    r = queued.join(outcomes, key).select(key, "selection", F.explode("fields").alias("f"))
    return r.where(F.col("f.action") != "unsure").select(key, "selection", F.col("f.field").alias("field"), (F.col("f.action") == "confirmed").alias("correct"), F.col("f.reason").alias("reason"))
