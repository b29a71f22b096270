"""Model answers as columns: the JSON in them, what went wrong, what they cost, and repaired records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import TYPES
from ..session import ship
from .fields import collapse_optional


def find_object(text: str | None) -> str | None:
    """The JSON object of an answer that may be fenced or wrapped in prose; null where there is none that parses."""
    if not text:
        return None
    body = text.strip()
    if body.startswith("```"):
        body = body[3:].partition("```")[0].lstrip()
        body = (body[4:] if body[:4].lower() == "json" else body).strip()
    try:
        got = json.loads(body)
    except ValueError:
        start = body.find("{")
        if start < 0:
            return None
        try:
            got, _ = json.JSONDecoder().raw_decode(body, start)
        except ValueError:
            return None
    return json.dumps(got, ensure_ascii=False) if isinstance(got, dict) else None


@F.pandas_udf(T.StringType())
def _object(s: pd.Series) -> pd.Series:
    return s.map(find_object).astype(object)


def extract_json(text: Column) -> Column:
    """`find_object`; answers that are one plain object already never leave the engine."""
    ship()
    plain = text.rlike(r"^\s*\{") & F.try_parse_json(text).isNotNull()
    return F.when(plain, F.trim(text)).otherwise(_object(F.when(~F.coalesce(plain, F.lit(False)), text)))


def taxonomy(text: Column, body: Column, truncated: Column, error: Column) -> Column:
    """Why an answer cannot be used (null if it can): the call failed, it was cut off, or holds no object."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", error).when(F.coalesce(truncated, F.lit(False)), F.lit("truncated"))
        .when(blank, F.lit("empty")).when(body.isNull(), F.lit("unparseable"))
    )


def cause(error: Column) -> Column:
    """The head of an error: its first two parts between colons."""
    return F.trim(F.substring_index(error, ":", 2))


def error_causes(df: DataFrame, error: str = "_error") -> DataFrame:
    rows = df.where(F.coalesce(F.trim(error), F.lit("")) != "")
    return rows.groupBy(cause(F.col(error)).alias("cause")).agg(F.count("*").alias("n"))


def priced(df: DataFrame, prices: DataFrame) -> DataFrame:
    """df with `usd`; prices: (model, usd_in, usd_out) a million tokens, one row a model.  An unknown model costs nothing."""
    p = F.broadcast(prices.select(F.col("model").alias("_m"), "usd_in", "usd_out"))  # a price list: one row for each model
    usd = (F.col("tokens_in") * F.col("usd_in") + F.col("tokens_out") * F.col("usd_out")) / 1_000_000
    return df.join(p, F.col("model") == F.col("_m"), "left").withColumn("usd", F.coalesce(usd, F.lit(0.0))).drop("_m", "usd_in", "usd_out")


def usage(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("usd"), 4).alias("usd"), F.round(F.sum("seconds"), 1).alias("latency_s")
    )


def previous(df: DataFrame) -> Column:
    """The record as the model gave it, as JSON: bookkeeping and the file's name left out."""
    return F.to_json(F.struct(*(c for c in df.columns if not c.startswith("_") and c != "file")))


def collapsed(df: DataFrame, doc_type: str, variant: str = "") -> DataFrame:
    """Optional fields answered as struct<status, value> become plain values."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        f.name: collapse_optional(F.col(f.name)) for f in TYPES[doc_type].fields_for(variant) if f.optional and isinstance(kinds.get(f.name), T.StructType)
    })


def merged(original: DataFrame, produced: DataFrame, doc_type: str, variant: str = "") -> DataFrame:
    """A repaired record: the harness's columns and the file of the original, all else as produced, the variant as known."""
    keep = [c for c in original.columns if c.startswith("_") or c == "file"]
    new = collapsed(produced, doc_type, variant)
    new = new.select(F.col("file").alias("_key"), *(c for c in new.columns if c not in keep and c != "doc_type"))
    out = original.select(*keep).join(new, F.col("file") == F.col("_key")).drop("_key").withColumn("doc_type", F.lit(doc_type))
    key = TYPES[doc_type].variant_key
    return out.withColumn(key, F.lit(variant)) if key and variant else out


def complaints(found: Column, reasons: Column, most: int = 6) -> Column:
    """What to tell a repairer, array<struct<origin, code, field, text>>: errors (never warnings), then the gates that fired."""
    def row(origin, code, field, text):
        return F.struct(F.lit(origin).alias("origin"), code.alias("code"), field.cast("string").alias("field"), text.cast("string").alias("text"))

    errors = F.transform(F.filter(found, lambda x: x["severity"] == "error"), lambda x: row("validator", x["code"], x["field"], x["code"]))
    gates = F.transform(reasons, lambda r: row("router", r["gate"], F.lit(None), F.format_string("%s was %.4f, %s %.4f", r["gate"], r["value"], r["direction"], r["threshold"])))
    none = F.array().cast("array<struct<origin:string,code:string,field:string,text:string>>")
    return F.slice(F.concat(F.coalesce(errors, none), F.coalesce(gates, none)), 1, most)
