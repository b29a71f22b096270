"""Calibration, coverage curves and signal ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import rate


def bins(df: DataFrame, confidence: str, outcome: str, n: int = 10, error_below: float = 0.5) -> DataFrame:
    """Fixed bins, empty ones kept: count, mean confidence, mean outcome, errors."""
    of = F.least(F.floor(F.col(confidence) * n), F.lit(n - 1)).cast("int")
    got = df.where(F.col(confidence).isNotNull()).groupBy(of.alias("bin")).agg(
        F.count("*").alias("n"), F.round(F.avg(confidence), 4).alias("mean_confidence"), F.round(F.avg(outcome), 4).alias("mean_outcome"),
        F.count_if(F.col(outcome) < error_below).alias("errors"),
    )
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").na.fill(0, ["n", "errors"])


def errors(binned: DataFrame, df: DataFrame, confidence: str, outcome: str, least: int = 5) -> DataFrame:
    """ECE and MCE from the rounded bins, and the Brier score."""
    gap = F.abs(F.col("mean_outcome") - F.col("mean_confidence"))
    a = binned.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 4).alias("ece"), F.round(F.max(F.when(F.col("n") >= least, gap)), 4).alias("mce"))
    return a.crossJoin(df.agg(F.round(F.avg((F.col(confidence) - F.col(outcome)) * (F.col(confidence) - F.col(outcome))), 4).alias("brier")))  # one row each


def curve(df: DataFrame, score: str, outcome: str, steps: int = 20, error_below: float = 0.5) -> DataFrame:
    """For thresholds i/steps: answered, coverage, accuracy, errors, errors caught, random baseline.

    One pass: rows are counted by the last threshold they reach, then summed downwards over the steps.
    """
    reach = F.least(F.lit(steps), F.greatest(F.lit(-1), F.floor(F.col(score) * steps + F.lit(1e-9)))).cast("int")
    got = df.where(F.col(score).isNotNull()).groupBy(reach.alias("step")).agg(
        F.count("*").alias("n"), F.sum(outcome).alias("s"), F.count_if(F.col(outcome) < error_below).alias("e")
    )
    every = df.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    up = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)  # over steps + 2 rows
    out = every.join(got, "step", "left").na.fill(0, ["n", "s", "e"]).select("step", F.sum("n").over(up).alias("answered"), F.sum("s").over(up).alias("good"), F.sum("e").over(up).alias("errors"))
    total = F.max("answered").over(Window.partitionBy())
    all_good, all_bad = F.max(F.when(F.col("step") == -1, F.col("good"))).over(Window.partitionBy()), F.max(F.when(F.col("step") == -1, F.col("errors"))).over(Window.partitionBy())
    out = out.select(
        "step", (F.col("step") / steps).alias("threshold"), "answered", rate(F.col("answered"), total).alias("coverage"), rate(F.col("good"), F.col("answered")).alias("accuracy"),
        "errors", (all_bad - F.col("errors")).alias("errors_caught"), rate(all_good, total).alias("baseline_accuracy"),
    )
    return out.where("step >= 0")


def operating_point(points: DataFrame, target: float) -> DataFrame:
    """The point of most coverage that reaches the target accuracy; the lowest threshold on a tie."""
    return points.where(F.col("accuracy") >= target).orderBy(F.col("coverage").desc(), "threshold").limit(1)


def average_rank(value: str, partition: tuple[str, ...] = ()) -> Column:
    """Ranks where ties share their mean."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / F.lit(2.0)


def before(per: DataFrame, groups: tuple[str, ...], value: str, cells: int = 64) -> DataFrame:
    """`per` (one row for each group and distinct value, with its count `k`) with `before`: the group's rows of smaller values.

    Approximate quantiles cut each group's values into cells; running sums within cells and over the cells' totals
    add up to exact counts wherever the cuts lie, so that no task sorts a whole group.
    """
    cuts = per.groupBy(*groups).agg(F.percentile_approx(value, [i / cells for i in range(1, cells)], F.lit(1000)).alias("_cuts"))
    rows = lookup(per, cuts, groups).withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    w = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most `cells` rows
    sums = rows.groupBy(*groups, "_cell").agg(F.sum("k").alias("_t")).withColumn("_o", F.coalesce(F.sum("_t").over(w), F.lit(0))).drop("_t")
    own = Window.partitionBy(*groups, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return lookup(rows, sums, (*groups, "_cell")).withColumn("before", F.col("_o") + F.coalesce(F.sum("k").over(own), F.lit(0))).drop("_cell", "_o")


def lookup(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """left with the one row of right that has its keys, null ones included."""
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, on, how).drop(*(f"_r_{k}" for k in keys))


def mean_ranks(rows: DataFrame, groups: tuple[str, ...], value: str, name: str, *more: Column) -> DataFrame:
    """A row for each group and distinct value: its count `k`, its rank with ties at their mean, and `more` aggregates."""
    per = rows.groupBy(*groups, value).agg(F.count("*").alias("k"), *more)
    return before(per, groups, value).withColumn(name, F.col("before") + (F.col("k") + 1) / 2.0).drop("before")


def spearman(long: DataFrame, signal: str = "signal", value: str = "value", outcome: str = "outcome", by: tuple[str, ...] = ()) -> DataFrame:
    """Per signal: rank correlation with the outcome; null for under three rows or a constant.

    long: (signal, value, outcome), and columns `by` that cut it further.  Ranks come from counts of distinct values.
    """
    groups = (*by, signal)
    rows = long.where(F.col(value).isNotNull() & F.col(outcome).isNotNull()).select(*groups, value, outcome)
    a, b = (mean_ranks(rows, groups, c, name).drop("k") for c, name in ((value, "rx"), (outcome, "ry")))
    rows = lookup(lookup(rows, a, (*groups, value)), b, (*groups, outcome))
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))  # null for a constant
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(rho, 4)).alias("rho"))


def signal_lift(long: DataFrame, expected: dict[str, int], at: float = 0.8, steps: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """Each signal (signal, value, outcome) as a routing score of its own.

    Values become percentiles, turned so that a high one promises a good outcome by the signal's declared direction.
    At the threshold whose coverage is closest to `at` (the lowest on a tie): coverage, accuracy, and lift over the mean.
    Signals with under three values have no figures.
    """
    groups = (*by, "signal")
    way = F.coalesce(F.create_map(*(F.lit(x) for kv in (expected or {"": 0}).items() for x in kv))[F.col("signal")], F.lit(0))
    long = long.select(*groups, "value", "outcome")
    whole = long.groupBy(*groups).agg(F.count("*").alias("rows"), F.count("value").alias("available"))
    per = mean_ranks(long.where("value is not null"), groups, "value", "r", F.sum("outcome").alias("s"))
    per = lookup(per, whole, groups)
    share = (F.when(way < 0, F.col("available") + 1 - F.col("r")).otherwise(F.col("r")) - 0.5) / F.col("available")
    reach = F.least(F.lit(steps), F.floor(share * steps + F.lit(1e-9))).cast("int")
    got = per.groupBy(*groups, F.col("available"), reach.alias("step")).agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
    # A row counts at every threshold up to the one it reaches.
    down = got.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("step")))).groupBy(*groups, "available", "step").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
    # Every row reaches step 0; thresholds that none reaches have a coverage of 0 and no accuracy.
    cover, accuracy = F.round(F.col("k") / F.col("available"), 4), F.round(F.col("s") / F.col("k"), 4)
    point = F.struct(F.round(F.abs(cover - at), 6).alias("gap"), "step", cover.alias("coverage"), accuracy.alias("accuracy"))
    best = down.groupBy(*groups).agg(F.min(point).alias("p"), F.max(F.when(F.col("step") == 0, F.col("s") / F.col("k"))).alias("mean"))
    out = whole.transform(lambda d: lookup(d, best, groups, "left")).transform(lambda d: lookup(d, spearman(long, by=by).drop("n"), groups, "left"))
    enough = F.col("available") >= 3
    base = F.round("mean", 4)
    return out.select(
        *groups, "available", (F.col("rows") - F.col("available")).alias("missing"), way.alias("expected_direction"), "rho",
        F.when(way != 0, F.col("rho") * way > 0).alias("direction_agrees"), F.when(enough, F.col("p.coverage")).alias("coverage"),
        F.when(enough, F.col("p.accuracy")).alias("accuracy"), F.when(enough, base).alias("baseline"), F.when(enough, F.round(F.col("p.accuracy") - base, 4)).alias("lift"),
    )


def signal_report(wide: DataFrame, expected: dict[str, int], outcome: str, slices: tuple[str, ...] = (), at: float = 0.8, least: int = 8) -> DataFrame:
    """`signal_lift` of every column named in `expected`, pooled and by each slice of `least` rows or more, in one pass.

    `dimension` is pooled or the slice's column, `slice` its value.
    """
    values = F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("value")) for n in expected))
    dims = F.array(F.struct(F.lit("pooled").alias("dimension"), F.lit("").alias("slice")), *(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("unlabelled")).alias("slice")) for c in slices))
    long = wide.select(F.col(outcome).cast("double").alias("outcome"), values.alias("v"), F.explode(dims).alias("d")).select("outcome", "d.*", F.explode("v").alias("v")).select("outcome", "dimension", "slice", "v.*")
    out = signal_lift(long, expected, at, by=("dimension", "slice"))
    return out.where((F.col("dimension") == "pooled") | (F.col("available") + F.col("missing") >= least))
