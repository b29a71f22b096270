"""Keyword classification, cascades, and confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import rate

# The phrases of each type, the more specific types first.
SIGNALS: dict[str, tuple[str, ...]] = {
    "multi_bill_invoice": (r"\bservice\s+code\b", r"\bcost\s+cent(?:re|er)\b", r"\bmaster\s+account\b", r"\bservice\s+period\b", r"\bper[- ]service\b"),
    "purchase_order": (r"\bpurchase\s+order\b", r"\bp\.?o\.?\s*(?:number|#)\b", r"\bship\s+to\b", r"\bdeliver(?:y)?\s+date\b", r"\bbuyer\b"),
    "resume": (r"\bwork\s+(?:history|experience)\b", r"\bemployment\s+history\b", r"\bskills\b", r"\beducation\b", r"\bcurriculum\s+vitae\b"),
    "form": (
        r"\bform\s+w-?[49]\b", r"\bsocial\s+security\s+number\b", r"\bclaim\s+number\b", r"\bloan\s+amount\b", r"\bapplicant\b",
        r"\bemployee\s+onboarding\b", r"\btaxpayer\s+identification\b",
    ),
    "invoice": (r"\binvoice\b", r"\binvoice\s+number\b", r"\bbill\s+to\b", r"\bamount\s+due\b", r"\bremit\s+to\b"),
}


def keyword(text: Column, signals: dict[str, tuple[str, ...]] = SIGNALS, min_hits: int = 1, abstain_on_tie: bool = True) -> Column:
    """struct<doc_type, confidence, runner_up, withheld>: a point for each phrase that occurs; ties and too few points abstain."""
    low = F.lower(F.coalesce(text, F.lit("")))
    points = []
    for order, (name, patterns) in enumerate(signals.items()):
        hits = sum((low.rlike("(?U)" + p).cast("int") for p in patterns), F.lit(0))
        points.append(F.struct((-hits).alias("minus"), F.lit(order).alias("order"), F.lit(name).alias("name"), F.lit(len(patterns)).alias("of")))
    ranked = F.array_sort(F.array(*points))
    best, second = ranked[0], ranked[1] if len(points) > 1 else F.lit(None)
    enough = -best["minus"] >= min_hits
    tie = (best["minus"] == second["minus"]) if abstain_on_tie and len(points) > 1 else F.lit(False)
    runner = F.when(enough & (second["minus"] < 0), second["name"]) if len(points) > 1 else F.lit(None).cast("string")
    return F.struct(
        F.when(enough & ~tie, best["name"]).alias("doc_type"),
        F.when(enough & ~tie, F.round(-best["minus"] / best["of"], 3)).otherwise(0.0).alias("confidence"),
        runner.alias("runner_up"), F.when(enough & tie, best["name"]).alias("withheld"),
    )


def cascade(primary: Column, secondary: Column, pairs: tuple[tuple[str, str], ...] = (), floor: float = 0.0) -> Column:
    """A second opinion where the first abstained, lies under the floor, or is torn between the two of a pair;
    inside a pair it counts only if it names one of them.  What stays under the floor is withheld."""
    torn, named = F.lit(False), F.lit(False)
    for a, b in pairs:
        both = primary["doc_type"].isin(a, b) & primary["runner_up"].isin(a, b) & (primary["doc_type"] != primary["runner_up"])
        torn, named = torn | F.coalesce(both, F.lit(False)), named | F.coalesce(both & secondary["doc_type"].isin(a, b), F.lit(False))
    unsure = primary["doc_type"].isNull() | (primary["confidence"] < floor)
    second = (torn & named) | (~torn & unsure & secondary["doc_type"].isNotNull())
    kind, sure = F.when(second, secondary["doc_type"]).otherwise(primary["doc_type"]), F.when(second, secondary["confidence"]).otherwise(primary["confidence"])
    held = sure < floor
    return F.struct(F.when(~held, kind).alias("doc_type"), sure.alias("confidence"), F.when(held, kind).alias("withheld"), (torn | unsure).alias("escalated"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n); an abstention is `(abstained)`."""
    return df.groupBy(F.col(truth).alias("truth"), F.coalesce(F.col(predicted), F.lit("(abstained)")).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """Per class: support, recall, precision, abstained, worst confusion."""
    wrong = (F.col("truth") != F.col("predicted")) & (F.col("predicted") != "(abstained)")
    rows = matrix.groupBy("truth").agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("correct"),
        F.sum(F.when(F.col("predicted") == "(abstained)", F.col("n")).otherwise(0)).alias("abstained"),
        F.min(F.when(wrong, F.struct((-F.col("n")).alias("m"), F.col("predicted").alias("worst")))).alias("w"),
    )
    given = matrix.groupBy("predicted").agg(F.sum("n").alias("given"))
    out = rows.join(given, rows["truth"] == given["predicted"], "left")
    return out.select(
        F.col("truth").alias("label"), "support", "correct", "abstained", rate(F.col("correct"), F.col("support")).alias("recall"),
        rate(F.col("correct"), F.coalesce("given", F.lit(0))).alias("precision"), F.col("w.worst").alias("worst_confusion"),
    )


def totals(df: DataFrame, truth: str, predicted: str, runner_up: str | None = None) -> DataFrame:
    """One row: documents, answered, abstained, accuracy (abstentions count against it), precision of answers, right answers in second place."""
    t, p = F.col(truth), F.nullif(F.col(predicted), F.lit(""))
    second = F.count_if(p.isNotNull() & (p != t) & (F.col(runner_up) == t)) if runner_up else F.lit(0).cast("bigint")
    got = df.agg(F.count("*").alias("documents"), F.count(p).alias("answered"), F.count_if(p == t).alias("correct"), second.alias("right_answer_was_second"))
    n, a, ok = F.col("documents"), F.col("answered"), F.col("correct")
    return got.select("documents", "answered", (n - a).alias("abstained"), "correct", rate(ok, n).alias("accuracy"), rate(ok, a).alias("precision_answered"), "right_answer_was_second")


def ocr_good(text: Column, layer: Column, confidence: Column, min_chars: int = 40, least: float = 0.80) -> Column:
    return (F.length(F.trim(text)) >= min_chars) & ((layer == "native") | (confidence >= least))


def ocr_rank(text: Column, confidence: Column, min_chars: int = 40) -> Column:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.struct((n > 0).alias("some"), (n >= min_chars).alias("enough"), F.coalesce(confidence, F.lit(0.0)).alias("conf"), n.alias("n"))


def ocr_cascade(readings: DataFrame, key: str = "file") -> DataFrame:
    """The first good reading of each file, else the best ranked; readings: (key, order, engine, text, layer, confidence)."""
    row = F.struct("engine", "text", "layer", "confidence")
    good = ocr_good(F.col("text"), F.col("layer"), F.col("confidence"))
    picked = readings.groupBy(key).agg(F.min_by(row, F.when(good, F.col("order"))).alias("first"), F.max_by(row, F.struct(ocr_rank(F.col("text"), F.col("confidence")), -F.col("order"))).alias("best"))
    return picked.select(key, F.coalesce("first", "best").alias("r")).select(key, "r.*")
