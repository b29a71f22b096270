"""What is known of an extraction without asking the model: reading, answer, rules, findings, and its own report as a control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import engines, is_blank
from ..registry import TYPES

# The signals in the order of a report, and whether a higher value is expected to mean a better result.
EXPECTED = {
    "ocr_confidence": 1, "words_per_page": 1, "engine_agreement": 1, "engine_confidence_spread": -1, "is_ocr": -1, "blank_share": -1,
    "rows": 0, "rules_applied": -1, "validator_errors": -1, "validator_warnings": -1, "classifier_confidence": 1, "classifier_margin": 1,
}
NAMES = tuple(EXPECTED)

READING = "struct<layer:string,confidence:double,words:bigint,pages:bigint,tried:array<string>>"
CLASSIFIER = "struct<doc_type:string,variant:string,confidence:double,margin:double,runner_up:string,withheld:string,abstained:boolean,escalated:boolean>"


def reading(block: Column) -> dict[str, Column]:
    """Signals of a READING struct: how well the page was read, and whether two engines agree on how much it holds."""
    tried = engines(block["tried"])
    chars, sure = F.transform(tried, lambda e: e["chars"]), F.transform(tried, lambda e: e["conf"])
    two = F.size(tried) > 1
    return {
        "ocr_confidence": block["confidence"], "words_per_page": F.round(F.try_divide(block["words"].cast("double"), block["pages"]), 2),
        "engine_agreement": F.when(two, F.coalesce(F.round(F.try_divide(F.array_min(chars).cast("double"), F.array_max(chars)), 4), F.lit(0.0))),
        "engine_confidence_spread": F.when(two, F.round(F.array_max(sure) - F.array_min(sure), 4)),
        "is_ocr": F.when(block["layer"] == "ocr", 1.0).otherwise(0.0),
    }


def answer_shape(df: DataFrame, doc_type: str, variant: str = "") -> dict[str, Column]:
    """The share of declared fields that are blank, whether or not the answer has them as columns, and its rows of groups."""
    t = TYPES[doc_type]
    names = [f.name for f in t.graded_fields(variant)]
    blank = sum((is_blank(F.col(n)).cast("int") if n in df.columns else F.lit(1) for n in names), F.lit(0))
    groups = [F.col(g.name) for g in t.groups if g.name in df.columns]
    count = sum((F.coalesce(F.size(g), F.lit(0)) for g in (F.when(x.isNotNull(), x) for x in groups)), F.lit(0)).cast("double")
    some = F.coalesce(*groups).isNotNull() if len(groups) == 1 else F.array_contains(F.array(*(g.isNotNull() for g in groups)), True) if groups else F.lit(False)
    return {"blank_share": F.round(blank / F.lit(len(names)), 4) if names else F.lit(None).cast("double"), "rows": F.when(some, count)}


def rule_activity(applied: Column) -> dict[str, Column]:
    """Changes made by all cleaning rules; null where none ran."""
    return {"rules_applied": F.aggregate(F.map_values(applied), F.lit(0).cast("bigint"), lambda s, v: s + v).cast("double")}


def findings(found: Column) -> dict[str, Column]:
    """Errors and warnings, counted apart."""
    errors = F.size(F.filter(found, lambda x: x["severity"] == "error"))
    return {"validator_errors": F.when(found.isNotNull(), errors).cast("double"), "validator_warnings": F.when(found.isNotNull(), F.size(found) - errors).cast("double")}


def self_report(block: Column) -> dict[str, Column]:
    return {"classifier_confidence": block["confidence"], "classifier_margin": block["margin"]}


def extract(df: DataFrame, doc_type: str, variant: str = "", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """`keep` and all signals of predictions; blocks a run did not write (_normalizer, _rules_applied, findings, classifier) give nulls."""
    got = answer_shape(df, doc_type, variant)
    for column, make in (("_normalizer", reading), ("_rules_applied", rule_activity), ("findings", findings), ("classifier", self_report)):
        if column in df.columns:
            got |= make(F.col(column))
    return df.select(*keep, *(got.get(n, F.lit(None)).cast("double").alias(n) for n in NAMES))


def from_classification(df: DataFrame, evidence: str = "evidence") -> Column:
    """The sidecar's CLASSIFIER struct from a classifier's columns; a cascade that asked its second classifier says so in its evidence."""
    kinds = T._parse_datatype_string(CLASSIFIER)
    own = {"escalated": F.when(F.contains(F.col(evidence), F.lit("escalated")), True)} if evidence in df.columns else {}
    blank = lambda c, t: F.nullif(c, F.lit("")) if isinstance(t, T.StringType) else c
    return F.struct(*(
        own.get(k.name, blank(F.col(k.name), k.dataType) if k.name in df.columns else F.lit(None)).cast(k.dataType).alias(k.name) for k in kinds.fields
    ))


def observations(classified: DataFrame, graded: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """Rows for calibration, and the counts of those that have no grade.

    A withheld answer is what would have been said; failures and ungraded documents are counted, never taken as zeros.
    """
    answer = F.coalesce(F.nullif(F.col("withheld"), F.lit("")), F.concat_ws(":", F.nullif(F.col("doc_type"), F.lit("")), F.nullif(F.col("variant"), F.lit(""))))
    g = graded.select(key, F.col("accuracy"), F.coalesce("failed", F.lit(False)).alias("failed"), F.lit(True).alias("_graded"))
    rows = classified.withColumn("answer", answer).join(g, key, "left")
    state = F.when(F.col("_graded").isNull(), "ungraded").when(F.col("failed"), "failed").otherwise("used")
    rows = rows.withColumn("_state", state)
    return rows.where("_state = 'used'").drop("_state", "_graded", "failed"), rows.groupBy(F.col("_state").alias("state")).agg(F.count("*").alias("n"))
