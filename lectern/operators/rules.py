"""Record cleaning: rewriters of nested arrays, each with a count of its changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import is_blank, parse_money
from ..registry import TYPES, DocType

# The fields that make a row worth keeping, and names of roll-up rows.
SUBSTANTIVE = ("description", "amount", "quantity", "unit_price", "company", "title")
ROLLUP_LABELS = (
    "subtotal", "sub total", "tax", "total", "due", "amount due", "balance", "balance due", "service total", "total due", "sum",
    "grand total", "subtotal / tax", "subtotal and tax",
)
ROLLUP_TOLERANCE = 0.01


def _names(df: DataFrame, column: str) -> list[str]:
    kind = df.schema[column].dataType
    return kind.elementType.names if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else []


def _row_test(keep, names, container):
    """A test of one argument: further ones would be taken for an index."""
    return lambda r: keep(r, names, container)


def _filtered(df: DataFrame, groups: tuple[str, ...], keep: Callable[[Column, list[str], Callable[[str], Column]], Column]) -> tuple[dict[str, Column], Column]:
    """The columns with the rows of each group, inside sections too, that `keep` keeps; and how many it dropped."""
    dropped, changed = F.lit(0), {}
    at_top = lambda n: F.col(n) if n in df.columns else F.lit(None)
    for g in groups:
        names = _names(df, g) if g in df.columns else []
        if names:
            kept = F.filter(F.col(g), _row_test(keep, names, at_top))
            dropped = dropped + F.coalesce(F.size(F.col(g)) - F.size(kept), F.lit(0))
            changed[g] = kept
    if "line_items" in (_names(df, "sections") if "sections" in df.columns else []):
        inner = df.schema["sections"].dataType.elementType["line_items"].dataType.elementType.names
        one = lambda s: F.filter(s["line_items"], _row_test(keep, inner, lambda n: s[n]))
        dropped = dropped + F.coalesce(F.aggregate(F.transform("sections", lambda s: F.coalesce(F.size(s["line_items"]) - F.size(one(s)), F.lit(0))), F.lit(0), lambda x, y: x + y), F.lit(0))
        changed["sections"] = F.transform("sections", lambda s: s.withField("line_items", one(s)))
    return changed, dropped


def drop_empty_rows(df: DataFrame, doc_type: DocType):
    def keep(r, names, _):
        some = [~is_blank(r[n]) for n in SUBSTANTIVE if n in names]
        out = some[0] if some else F.lit(True)
        for x in some[1:]:
            out = out | x
        return out

    return _filtered(df, ("line_items", "work_history"), keep)


def drop_rollup_rows(df: DataFrame, doc_type: DocType):
    """A row named like a roll-up that carries nothing, or one of its container's own figures."""

    def keep(r, names, container):
        if not {"description", "amount"} <= set(names):
            return F.lit(True)
        label = F.rtrim(F.lower(F.trim(F.coalesce(r["description"].cast("string"), F.lit("")))), F.lit(":"))
        amount = parse_money(r["amount"])
        equal = F.lit(False)
        for n in ("subtotal", "tax", "total"):
            equal = equal | F.coalesce(F.abs(amount - parse_money(container(n).cast("string"))) <= ROLLUP_TOLERANCE, F.lit(False))
        return ~(label.isin(*ROLLUP_LABELS) & (amount.isNull() | equal))

    return _filtered(df, ("line_items",), keep)


def stripped_identifier(c: Column) -> Column:
    """The last token, where all before it are words and it has a digit."""
    text = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(text.rlike(r"(?U)^(?:\p{L}+\s+)+\S*\d\S*$"), F.regexp_extract(text, r"(?U)(\S+)$", 1)).otherwise(text)


def _strippers(names: list[str]):
    """Of one row: the row with its identifiers stripped, and how many that changes."""

    def strip(r):
        for n in names:
            r = r.withField(n, stripped_identifier(r[n]))
        return r

    def hits(r):
        return sum((F.coalesce((stripped_identifier(r[n]) != r[n]).cast("int"), F.lit(0)) for n in names), F.lit(0))

    return strip, hits


def strip_identifier_labels(df: DataFrame, doc_type: DocType):
    own = {f.name for fs in [doc_type.fields, *doc_type.variants.values()] for f in fs if f.kind == "identifier"}
    changed, count = {}, F.lit(0)
    for n in df.columns:
        if n in own:
            new = stripped_identifier(F.col(n))
            changed[n], count = new, count + F.coalesce((new != F.col(n)).cast("int"), F.lit(0))
    for g in doc_type.groups:
        names = [f.name for f in g.fields if f.kind == "identifier" and f.name in (_names(df, g.name) if g.name in df.columns else [])]
        if names:
            strip, hits = _strippers(names)
            count = count + F.coalesce(F.aggregate(F.transform(F.col(g.name), hits), F.lit(0), lambda x, y: x + y), F.lit(0))
            changed[g.name] = F.transform(F.col(g.name), strip)
    return changed, count


RULES = {"drop_empty_rows": drop_empty_rows, "drop_rollup_rows": drop_rollup_rows, "strip_identifier_labels": strip_identifier_labels}


def apply(df: DataFrame, doc_type: str, disabled: tuple[str, ...] = ()) -> DataFrame:
    """The rules in name order; `_rules_applied` maps each rule that changed something to its count."""
    unknown = set(disabled) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    counts = []
    for name in sorted(set(RULES) - set(disabled)):
        changed, count = RULES[name](df, TYPES[doc_type])
        df = df.withColumns({**changed, f"_n_{name}": count})
        counts += [F.lit(name), F.col(f"_n_{name}")]
    made = F.map_filter(F.create_map(*counts), lambda _, n: n > 0) if counts else F.create_map().cast("map<string,int>")
    return df.withColumn("_rules_applied", made).drop(*(f"_n_{n}" for n in RULES))
