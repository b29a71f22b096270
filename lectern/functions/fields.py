"""Typed parsing, normalisation and comparison of one value, as column expressions."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fuzzy import nfkd, ratio

# Date formats in the order they are tried, legal suffixes, words for booleans.
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "M/d/yy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
LEGAL_SUFFIXES = (
    "incorporated", "inc", "llc", "l l c", "llp", "l l p", "ltd", "limited", "corporation", "corp", "co", "company", "plc", "pvt",
    "private", "gmbh", "sa", "nv",
)
TRUE_WORDS = ("true", "yes", "y", "1", "checked", "x", "☑")
FALSE_WORDS = ("false", "no", "n", "0", "unchecked", "☐")
MONEY_TOLERANCE, NAME_THRESHOLD, TEXT_THRESHOLD = 0.01, 0.90, 0.85


def is_blank(c: Column, ready: bool = False) -> Column:
    if ready:
        return c.isNull() | (c == "")
    return c.isNull() | c.cast("string").rlike(r"(?U)^\s*$")


def clean(c: Column, unicode: bool = False, ready: bool = False) -> Column:
    """White space collapsed; compatibility decomposition too, where the input may hold more than ASCII.

    `ready` tells that the column is clean already.
    """
    if ready:
        return c
    text = nfkd(c.cast("string")) if unicode else c.cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


@cache
def _layout(forms: tuple[str, ...]) -> tuple[str, str]:
    """One pattern of alternatives for all formats, and what turns a match into year-month-day."""
    parts = {"yyyy": r"\d{4}", "yy": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}", "MMM": "[A-Za-z]{3}", "MMMM": "[A-Za-z]{3,}"}
    groups = [m for form in forms for m in re.findall("[A-Za-z]+", form)]
    ways = "|".join(re.sub("[A-Za-z]+", lambda m: f"({parts[m[0]]})", form) for form in forms)
    return f"^(?:{ways})$", "-".join("".join(f"${i}" for i, g in enumerate(groups, 1) if g[0] == unit) for unit in "yMd")


def _dated(text: Column, forms: tuple[str, ...]) -> Column:
    """The date of a text in any of the formats; rewritten and cast, as a failed parse of each format would cost an exception."""
    pattern, order = _layout(forms)
    iso = F.regexp_replace(text, pattern, order)
    if "M/d/yy" in forms:  # two digits from 69 on are of the last century
        iso = F.regexp_replace(F.regexp_replace(iso, r"^(69|[7-9]\d)-", "19$1-"), r"^(\d\d)-", "20$1-")
    names = {n[:3]: i for i, n in enumerate(MONTHS, 1)} | ({n: i for i, n in enumerate(MONTHS, 1)} if any("MMMM" in form for form in forms) else {})
    named = F.regexp_extract(text, "[A-Za-z]+", 0)
    number = F.try_element_at(F.create_map(*(F.lit(str(x)) for pair in names.items() for x in pair)), F.lower(named))
    found = F.when(text.rlike(pattern) & ~text.contains("0000"), F.replace(iso, named, F.coalesce(number, F.lit("")))).try_cast("date")
    # What is in this form already needs no other pattern.
    plain = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z") & ~text.contains("0000")
    return F.when(plain, text.try_cast("date")).otherwise(found) if "yyyy-M-d" in forms else found


def parse_date(c: Column, ready: bool = False) -> Column:
    return _dated(clean(c, ready=ready), DATE_FORMATS)


def parse_money(c: Column, ready: bool = False) -> Column:
    text = clean(c, ready=ready)
    amount = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
    plain = text.rlike(r"^-?[0-9]+(?:\.[0-9]+)?\z")  # most are, and need no other pattern
    return F.when(plain, text.try_cast("double")).when(text.rlike(r"^\(.*\)$"), F.lit(0.0) - F.abs(amount)).otherwise(amount)


def parse_bool(c: Column, ready: bool = False) -> Column:
    word = F.lower(clean(c, ready=ready))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def digits_only(c: Column, ready: bool = False) -> Column:
    return F.regexp_replace(clean(c, ready=ready), r"(?U)\D", "")


def normalise_identifier(c: Column, unicode: bool = False, ready: bool = False) -> Column:
    return F.regexp_replace(F.lower(clean(c, unicode, ready)), "[^a-z0-9]+", "")


def normalise_text(c: Column, unicode: bool = False, ready: bool = False) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean(c, unicode, ready)), "[^a-z0-9]+", " "))


def normalise_name(c: Column, unicode: bool = False, ready: bool = False) -> Column:
    """Trailing legal suffixes removed, as often as they occur."""
    suffix = "|".join(sorted(LEGAL_SUFFIXES, key=len, reverse=True))
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), normalise_text(c, unicode, ready)), f"(?: (?:{suffix}))+$", ""))


def number(c: Column, kind: T.DataType | None = None) -> Column:
    """The validators' own reading of a number: only commas and dollar signs go; `kind`: the column's type, if known."""
    if isinstance(kind, T.DoubleType | T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        return c.cast("double")  # as its text would be read
    return F.regexp_replace(F.trim(c.cast("string")), "[,$]", "").try_cast("double")


def plain_date(c: Column) -> Column:
    """The validators' own reading of a date: four formats."""
    return _dated(F.trim(c.cast("string")), ("yyyy-M-d", "M/d/yyyy", "MMM d, yyyy", "d MMM yyyy"))


#: How a value of a kind is read before it is compared.
READ = {"date": parse_date, "money": parse_money, "number": parse_money, "bool": parse_bool}


def compare(kind: str, predicted: Column, truth: Column, tolerance: float | None = None, threshold: float | None = None, unicode: bool = False, ready: bool = False, values: tuple[Column, Column] | None = None) -> Column:
    """struct<exact, match, note> of a predicted value under the rules of its kind; `values`: both sides as `READ` gives them, if at hand.

    Only names and free text need the fuzzy ratio; every other kind stays in generated code.
    """
    p_blank, t_blank = is_blank(predicted, ready), is_blank(truth, ready)
    exact = clean(predicted, unicode, ready) == clean(truth, unicode, ready)

    def parsed(same, what, form):
        p, t = values or (READ[kind](predicted, ready), READ[kind](truth, ready))
        known = p.isNotNull() & t.isNotNull()
        return F.when(known, same(p, t)).otherwise(exact), F.when(exact, "").when(known, form).otherwise(f"unparseable {what}")

    if kind == "date":
        match, note = parsed(lambda p, t: p == t, "date", "date format")
    elif kind in ("money", "number"):
        tol = MONEY_TOLERANCE if tolerance is None else tolerance
        match, note = parsed(lambda p, t: F.abs(p - t) <= tol, "number", f"within {tol}")
    elif kind == "bool":
        match, note = parsed(lambda p, t: p == t, "boolean", "boolean form")
    elif kind in ("identifier", "enum"):
        match, note = normalise_identifier(predicted, unicode, ready) == normalise_identifier(truth, unicode, ready), F.when(exact, "").otherwise("case/separators")
    elif kind in ("ssn", "ein", "phone", "account"):
        match, note = digits_only(predicted, ready) == digits_only(truth, ready), F.when(exact, "").otherwise("formatting")
    elif kind == "email":
        match, note = F.lower(clean(predicted, unicode, ready)) == F.lower(clean(truth, unicode, ready)), F.when(exact, "").otherwise("case")
    else:
        name = kind == "name"
        least = threshold if threshold is not None else NAME_THRESHOLD if name else TEXT_THRESHOLD
        form = normalise_name if name else normalise_text
        r = ratio(form(predicted, unicode, ready), form(truth, unicode, ready))
        match, note = r >= least, F.when(exact, "").otherwise(F.format_string("fuzzy %.2f", r))

    def result(e, m, n):
        return F.struct(F.lit(e).alias("exact") if isinstance(e, bool) else e.alias("exact"), F.coalesce(F.lit(m) if isinstance(m, bool) else m, F.lit(False)).alias("match"), (F.lit(n) if isinstance(n, str) else n).alias("note"))

    return (
        F.when(p_blank & t_blank, result(True, True, "both blank"))
        .when(p_blank, result(False, False, "missing"))
        .when(t_blank, result(False, False, "spurious"))
        .otherwise(result(exact, match, note))
    )


def field_state(predicted: Column, truth: Column, match: Column, ready: bool = False) -> Column:
    p, t = is_blank(predicted, ready), is_blank(truth, ready)
    return F.when(p & t, "correctly_blank").when(p, "missed").when(t, "fabricated").when(match, "right").otherwise("wrong")


def profile_of(file: Column) -> Column:
    """The degradation in a name: what follows the first `__`, or clean."""
    stem = F.regexp_replace(F.substring_index(F.regexp_replace(file, r"\\", "/"), "/", -1), r"\.pdf$", "")
    return F.when(F.instr(stem, "__") > 0, F.regexp_extract(stem, "__(.*)$", 1)).otherwise("clean")


def source_of(file: Column) -> Column:
    return F.substring_index(file, "__", 1)


def rate(n: Column, d: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(n, d), digits)


def hash_fraction(key: Column, seed: str = "di") -> Column:
    """The first eight bytes of sha256(seed:key), as a fraction of their range."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def collapse_optional(c: Column) -> Column:
    """struct<status, value> to its value where it is present."""
    return F.when(c["status"] == "present", c["value"])


def engines(tried: Column) -> Column:
    """`engine=33ch/conf0.78/1.1s` entries to array<struct<engine, chars, conf>>."""
    shape = r"(\w+)=(\d+)ch/conf([\d.]+)"
    one = lambda x: F.struct(
        F.regexp_extract(x, shape, 1).alias("engine"), F.regexp_extract(x, shape, 2).try_cast("long").alias("chars"),
        F.regexp_extract(x, shape, 3).try_cast("double").alias("conf"),
    )
    return F.filter(F.transform(tried, one), lambda e: e["chars"].isNotNull())


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """struct<low, high>: 95% score interval of a share, null without observations."""
    p = F.try_divide(hits, n)
    denominator = F.lit(1.0) + z * z / n
    middle = (p + z * z / (2 * n)) / denominator
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n) + z * z / (4 * n * n)) / denominator
    low, high = F.round(F.greatest(F.lit(0.0), middle - spread), 4), F.round(F.least(F.lit(1.0), middle + spread), 4)
    return F.struct(F.when(n > 0, low).alias("low"), F.when(n > 0, high).alias("high"))
