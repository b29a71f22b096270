"""Constraint checks: a record to an array of findings, one expression for each check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import is_blank, number, plain_date
from ..registry import TYPES

TOLERANCE = 0.02
FINDING = "array<struct<code:string,field:string,expected:string,actual:string,severity:string,validator:string>>"

# Required fields and choices by type and variant, with the code each absence gets.
REQUIRED = {
    "invoice": {"invoice_number": "missing_invoice_number", "bill_to": "missing_bill_to"},
    "purchase_order": {"po_number": "missing_po_number", "vendor": "missing_vendor"},
    "resume": {"email": "missing_email", "phone": "missing_phone"},
}
REQUIRED_FORM = {
    "": {"signature": "missing_signature", "sign_date": "missing_sign_date"},
    "onboarding": {"bank_account": "missing_bank_account", "w4_filing_status": "no_filing_status_selected"},
    "claim": {"adjuster_name": "missing_adjuster"},
    "w4": {"filing_status": "no_filing_status_selected"},
    "w9": {"tax_classification": "no_tax_classification_selected", "tin_type": "no_tin_type_selected"},
}
SSN_PLACEHOLDERS = ("000-00-0000", "123-45-6789", "111-11-1111", "999-99-9999")


def _finding(when: Column, code, field, validator: str, expected=None, actual=None, severity: str = "error") -> Column:
    text = lambda x: F.lit(x) if x is None or isinstance(x, str) else x.cast("string")
    return F.when(when, F.struct(
        text(code).alias("code"), text(field).alias("field"), text(expected).alias("expected"), text(actual).alias("actual"),
        F.lit(severity).alias("severity"), F.lit(validator).alias("validator"),
    ))


def _kept(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _join(*arrays: Column) -> Column:
    return F.concat(*(F.coalesce(a, F.array().cast(FINDING)) for a in arrays)) if arrays else F.array().cast(FINDING)


def _money(x: Column) -> Column:
    return F.format_string("%.2f", x)


def _let(value: Column, body) -> Column:
    """body(value), with the value made once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _fields(kind) -> dict:
    """The types of the fields of an array of structs, by name."""
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}


def _read_lines(rows: Column, kinds: dict) -> Column:
    """Lines by their place: the amount, and what it should be."""
    n = lambda row, name: number(row[name], kinds.get(name))
    return F.transform(rows, lambda row, i: F.struct(i.alias("at"), n(row, "amount").alias("a"), F.round(n(row, "quantity") * n(row, "unit_price"), 2).alias("want")))


def _wrong(r: Column) -> Column:
    return F.abs(r["want"] - r["a"]) > TOLERANCE


def _line_checks(lines: Column, code: str, prefix: Column) -> Column:
    """lines: as _read_lines gives them; texts are made only for those at fault."""
    def one(r):
        field = F.concat(prefix, F.lit("line_items["), r["at"].cast("string"), F.lit("].amount"))
        return _kept(
            _finding(r["a"] < 0, "negative_line_amount", field, "arithmetic", actual=_money(r["a"])),
            _finding(_wrong(r), code, field, "arithmetic", _money(r["want"]), _money(r["a"])),
        )

    return F.flatten(F.transform(F.filter(lines, lambda r: (r["a"] < 0) | _wrong(r)), one))


def _total_checks(read, lines: Column, codes: tuple[str, str], prefix: Column) -> Column:
    """A consequence is reported only where its cause is not: wrong rows hide the totals, a wrong subtotal hides the total."""
    sub = read("subtotal")
    bad = F.coalesce(F.exists(lines, lambda r: F.coalesce(_wrong(r), F.lit(False))), F.lit(False))
    # Null if an amount is, or if there are no lines.
    summed = F.when(F.size(lines) > 0, F.round(F.aggregate(lines, F.lit(0.0), lambda x, r: x + r["a"]), 2))
    known = F.struct(bad.alias("bad"), summed.alias("summed"), sub.alias("sub"), F.round(sub + read("tax"), 2).alias("want"), read("total").alias("total"))

    def found(k):
        sub_bad = F.coalesce(~k["bad"] & (F.abs(k["summed"] - k["sub"]) > TOLERANCE), F.lit(False))
        return _kept(
            _finding(sub_bad, codes[0], F.concat(prefix, F.lit("subtotal")), "arithmetic", _money(k["summed"]), _money(k["sub"])),
            _finding(~k["bad"] & ~sub_bad & (F.abs(k["want"] - k["total"]) > TOLERANCE), codes[1], F.concat(prefix, F.lit("total")), "arithmetic", _money(k["want"]), _money(k["total"])),
        )

    return _let(known, found)


def _sums(read, rows: Column, kinds: dict, codes: tuple[str, str, str], prefix: Column) -> Column:
    return _let(_read_lines(rows, kinds), lambda lines: _join(_line_checks(lines, codes[0], prefix), _total_checks(read, lines, codes[1:], prefix)))


def arithmetic(columns: dict[str, Column], kinds: dict | None = None) -> Column:
    """kinds: the columns' types, as far as known; what is a number already is not read from its text."""
    none, kinds = F.lit(""), kinds or {}
    out = []
    read = lambda name: number(columns.get(name, F.lit(None)), kinds.get(name))
    if "line_items" in columns:
        out.append(_sums(read, columns["line_items"], _fields(kinds.get("line_items")), ("line_item_math_error", "subtotal_mismatch", "total_mismatch"), none))
    if "sections" in columns:
        sections, of = columns["sections"], _fields(kinds.get("sections"))

        def one(s, i):
            prefix = F.concat(F.lit("sections["), i.cast("string"), F.lit("]."))
            sums = _sums(lambda x: number(s[x], of.get(x)), s["line_items"], _fields(of.get("line_items")), ("section_line_item_math_error", *("section_total_mismatch",) * 2), prefix)
            account, total = F.trim(s["account_number"]), number(s["total"], of.get("total"))
            before = F.exists(F.slice(sections, F.lit(1), i), lambda x: F.trim(x["account_number"]) == account)
            return _join(sums, _kept(
                _finding(total < 0, "negative_section_total", F.concat(prefix, F.lit("total")), "arithmetic", actual=_money(total)),
                _finding((account != "") & before, "duplicate_section_account", F.concat(prefix, F.lit("account_number")), "arithmetic", actual=account),
            ))

        totals = F.transform(sections, lambda s: number(s["total"], of.get("total")))
        summed = F.round(F.aggregate(totals, F.lit(0.0), lambda x, y: x + y), 2)
        declared = read("section_count").cast("int")
        whole = (F.size(sections) > 0) & ~F.exists(totals, lambda t: t.isNull()) & read("subtotal").isNotNull()
        out += [F.flatten(F.transform(sections, one)), _kept(
            _finding(declared != F.size(sections), "section_count_mismatch", "section_count", "arithmetic", F.size(sections), declared),
            _finding(whole & (F.abs(summed - read("total")) > TOLERANCE), "invoice_total_not_sum_of_sections", "total", "arithmetic", _money(summed), _money(read("total"))),
        )]
    return _join(*out)


def formats(c: dict[str, Column]) -> Column:
    out = []
    if "ssn" in c:
        ssn = F.trim(c["ssn"])
        out.append(_finding((ssn != "") & (~ssn.rlike(r"^\d{3}-?\d{2}-?\d{4}$") | ssn.isin(*SSN_PLACEHOLDERS)), "invalid_ssn_format", "ssn", "format", actual=ssn))
    if "bank_routing" in c:
        routing = F.trim(c["bank_routing"])
        out.append(_finding((routing != "") & ~routing.rlike(r"^\d{9}$"), "invalid_routing_number", "bank_routing", "format", actual=routing))
    return _kept(*out) if out else F.array().cast(FINDING)


def ranges(c: dict[str, Column]) -> Column:
    out = []
    if "credit_score" in c:
        s = number(c["credit_score"])
        out.append(_finding(~s.between(300, 850), "credit_score_out_of_range", "credit_score", "range", "300-850", s))
    for name, code in (("annual_income", "negative_income"), ("claim_amount", "negative_claim_amount")):
        if name in c:
            out.append(_finding(number(c[name]) < 0, code, name, "range", actual=_money(number(c[name]))))
    if {"down_payment", "loan_amount"} <= set(c):
        down, loan = number(c["down_payment"]), number(c["loan_amount"])
        out.append(_finding(down > loan, "down_payment_exceeds_loan", "down_payment", "range", _money(loan), _money(down)))
    return _kept(*out) if out else F.array().cast(FINDING)


def temporal(c: dict[str, Column]) -> Column:
    out = []
    if {"date_of_loss", "date_reported"} <= set(c):
        loss, told = plain_date(c["date_of_loss"]), plain_date(c["date_reported"])
        out.append(_kept(_finding(told < loss, "date_reported_before_loss", "date_reported", "temporal", loss, told)))
    if "work_history" in c:
        def job(j, i):
            start, end = number(j["start_year"]), number(j["end_year"])
            at = F.concat(F.lit("work_history["), i.cast("string"), F.lit("]"))
            return _kept(
                _finding((start != 0) & (end != 0) & (end < start), "impossible_employment_dates", F.concat(at, F.lit(".end_year")), "temporal", start, end),
                _finding(is_blank(j["start_year"]) & is_blank(j["end_year"]), "missing_employment_dates", F.concat(at, F.lit(".start_year")), "temporal"),
            )

        out.append(F.flatten(F.transform(c["work_history"], job)))
    if "sections" in c:
        sections = c["sections"]

        def period(s, i):
            start, end = F.trim(s["service_period_start"]), F.trim(s["service_period_end"])
            same = F.exists(F.slice(sections, F.lit(1), i), lambda x: (F.trim(x["service_period_start"]) == start) & (F.trim(x["service_period_end"]) == end))
            at = F.concat(F.lit("sections["), i.cast("string"), F.lit("].service_period_start"))
            return _kept(_finding((start != "") & (end != "") & same, "overlapping_service_periods", at, "temporal", actual=F.concat(start, F.lit(".."), end), severity="warning"))

        out.append(F.flatten(F.transform(sections, period)))
    return _join(*out)


def required(c: dict[str, Column], doc_type: str, variant: str = "") -> Column:
    t = TYPES[doc_type]
    optional = {f.name for f in t.fields_for(variant) if f.optional}
    wanted = dict(REQUIRED.get(doc_type, {}))
    if doc_type == "form":
        wanted |= REQUIRED_FORM[""] | REQUIRED_FORM.get(variant, {})
    out = [_kept(*(_finding(is_blank(c[n]), code, n, "required", actual="") for n, code in sorted(wanted.items()) if n in c and n not in optional))] if set(wanted) & set(c) else []
    if doc_type == "form" and variant == "w9" and {"ssn", "ein"} <= set(c):
        out.append(_kept(_finding(is_blank(c["ssn"]) & is_blank(c["ein"]), "missing_tin", "ssn", "required")))
    if doc_type == "resume" and "skills" in c:
        out.append(_kept(_finding(F.size(c["skills"]) == 0, "no_skills_listed", "skills", "required")))
    if "sections" in c:
        def section(s, i):
            at = F.concat(F.lit("sections["), i.cast("string"), F.lit("]."))
            return _kept(
                _finding(is_blank(s["account_number"]), "missing_section_account", F.concat(at, F.lit("account_number")), "required"),
                _finding(is_blank(s["service_period_start"]) & is_blank(s["service_period_end"]), "missing_section_period", F.concat(at, F.lit("service_period_start")), "required"),
            )

        out.append(F.flatten(F.transform(c["sections"], section)))
    return _join(*out)


VALIDATORS = {"arithmetic": None, "format": ("form",), "range": ("form",), "required": None, "temporal": None}


def check(df: DataFrame, doc_type: str, variant: str = "", enabled: tuple[str, ...] = tuple(VALIDATORS)) -> DataFrame:
    """df with `findings`, the validators in name order."""
    c = {x: F.col(f"`{x}`") for x in df.columns}
    made = {"arithmetic": lambda: arithmetic(c, {f.name: f.dataType for f in df.schema}), "format": lambda: formats(c), "range": lambda: ranges(c), "required": lambda: required(c, doc_type, variant), "temporal": lambda: temporal(c)}
    unknown = set(enabled) - set(made)
    if unknown:
        raise ValueError(f"unknown validators: {sorted(unknown)}")
    use = [n for n in sorted(enabled) if VALIDATORS[n] is None or doc_type in VALIDATORS[n]]
    return df.withColumn("findings", _join(*(made[n]().cast(FINDING) for n in use)))


def findings(checked: DataFrame, *keep: str) -> DataFrame:
    return checked.select(*keep, F.explode("findings").alias("f")).select(*keep, "f.*")


def score(found: DataFrame, truth: DataFrame, codes: DataFrame) -> DataFrame:
    """Per code: hit, missed, spurious, precision, recall. found, truth: (file, code); codes: (code), zero rows kept."""
    f = found.select("file", "code").distinct().withColumn("f", F.lit(1))
    t = truth.select("file", "code").distinct().withColumn("t", F.lit(1))
    both = f.join(t, ["file", "code"], "full").groupBy("code").agg(
        F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("hit"), F.count_if(F.col("f").isNull()).alias("missed"), F.count_if(F.col("t").isNull()).alias("spurious")
    )
    out = codes.join(both, "code", "left").na.fill(0, ["hit", "missed", "spurious"])
    rate = lambda n, d: F.round(F.try_divide(n, d), 4)
    return out.withColumn("precision", rate(F.col("hit"), F.col("hit") + F.col("spurious"))).withColumn("recall", rate(F.col("hit"), F.col("hit") + F.col("missed")))
