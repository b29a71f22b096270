"""Declared document types: fields, groups, variants, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"
    weight: float = 1.0
    tolerance: float | None = None
    threshold: float | None = None
    key: bool = False
    optional: bool = False


@dataclass(frozen=True)
class Group:
    name: str
    fields: tuple[Field, ...]
    groups: tuple[Group, ...] = ()
    max_rows: int = 50


@dataclass(frozen=True)
class DocType:
    name: str
    label_file: str
    fields: tuple[Field, ...]
    groups: tuple[Group, ...] = ()
    variant_key: str = ""
    variants: dict[str, tuple[Field, ...]] = field(default_factory=dict)

    def fields_for(self, variant: str = "") -> tuple[Field, ...]:
        """The shared fields and a variant's own; an unknown variant gets those of all."""
        if variant in self.variants:
            own = self.variants[variant]
        else:
            own = tuple({f.name: f for fs in self.variants.values() for f in reversed(fs)}.values())
        return self.fields + own

    def graded_fields(self, variant: str = "") -> tuple[Field, ...]:
        return tuple(f for f in self.fields_for(variant) if f.name != self.variant_key)


def _fields(text: str) -> tuple[Field, ...]:
    """`name:kind`, then `*weight`, `~tolerance`, `!` for a key and `?` for an optional field."""
    out = []
    for part in text.split():
        name, _, rest = part.partition(":")
        kind = rest.rstrip("!?").partition("*")[0].partition("~")[0] or "text"
        weight = float(rest.partition("*")[2].partition("~")[0].rstrip("!?") or 1)
        tolerance = float(rest.partition("~")[2].rstrip("!?")) if "~" in rest else None
        out.append(Field(name, kind, weight, tolerance, key="!" in rest, optional="?" in rest))
    return tuple(out)


# The declared types, their fields, kinds, weights and tolerances.
_TOTALS = "subtotal:money*2 tax:money*2 total:money*3"
LINE_ITEMS = Group("line_items", _fields("description:text quantity:number~0.001 unit_price:money amount:money"))
SECTIONS = Group(
    "sections",
    _fields(
        "service_type:text service_code:identifier! account_number:identifier! reference_number:identifier "
        f"service_location:text? cost_center:text service_period_start:date service_period_end:date {_TOTALS}"
    ),
    (LINE_ITEMS,),
)
WORK_HISTORY = Group("work_history", _fields("company:name! title:text start_year:number~0 end_year:text"))
TYPES = {
    t.name: t
    for t in (
        DocType("invoice", "invoices", _fields(
            "invoice_number:identifier*3 invoice_date:date*2 due_date:date po_number:identifier*2 vendor_name:name*2 "
            f"bill_to:name terms:enum currency:enum {_TOTALS}"), (LINE_ITEMS,)),
        DocType("purchase_order", "purchase_orders", _fields(
            f"po_number:identifier*2 po_date:date delivery_date:date buyer:name vendor:name terms:enum currency:enum {_TOTALS}"), (LINE_ITEMS,)),
        DocType("multi_bill_invoice", "multi_bill_invoices", _fields(
            "invoice_number:identifier*3 invoice_date:date*2 due_date:date vendor_name:name*2 bill_to:name "
            f"master_account:identifier terms:enum currency:enum section_count:number~0 {_TOTALS}"), (SECTIONS,)),
        DocType("resume", "resumes", _fields(
            "name:name email:email phone:phone location:text target_role:text current_title:text years_experience:number~0"), (WORK_HISTORY,)),
        DocType("form", "forms", _fields("form_type:enum signature:name sign_date:date"), (), "form_type", {
            "onboarding": _fields(
                "employee_name:name ssn:ssn*3 date_of_birth:date home_address:text personal_email:email phone:phone job_title:text "
                "department:text manager:name start_date:date employment_type:enum pay_rate:money pay_frequency:enum bank_name:name "
                "bank_routing:account*3 bank_account:account*3 w4_filing_status:enum allowances:number~0 emergency_contact_name:name "
                "emergency_contact_phone:phone i9_verified:bool handbook_acknowledged:bool"),
            "claim": _fields(
                "claim_number:identifier policy_number:identifier claimant_name:name claim_type:enum date_of_loss:date date_reported:date "
                "incident_location:text loss_description:text claim_amount:money deductible:money adjuster_name:name status:enum contact_phone:phone"),
            "w9": _fields(
                "name:name business_name:name? tax_classification:enum address:text city_state_zip:text tin_type:enum ssn:ssn*3 ein:ein*3 requester:name"),
            "w4": _fields(
                "name:name ssn:ssn*3 address:text filing_status:enum multiple_jobs:bool dependents_amount:money other_income:money "
                "deductions:money extra_withholding:money"),
            "loan": _fields(
                "application_number:identifier applicant_name:name ssn:ssn*3 date_of_birth:date address:text phone:phone email:email "
                "employer:name job_title:text years_employed:number~0 annual_income:money loan_type:enum loan_amount:money "
                "loan_term_months:number~0 loan_purpose:text down_payment:money monthly_debt:money credit_score:number~0 co_applicant_name:name?"),
        }),
    )
}


def labels() -> list[str]:
    """Class labels: a type, or type:variant for each variant."""
    return [label for t in TYPES.values() for label in ([f"{t.name}:{v}" for v in t.variants] or [t.name])]


def struct(fields: tuple[Field, ...], groups: tuple[Group, ...] = ()) -> T.StructType:
    """Values stay as printed: strings, with repeating groups as arrays of structs."""
    out = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    for g in groups:
        out.add(g.name, T.ArrayType(struct(g.fields, g.groups)))
    return out


def schema(name: str) -> T.StructType:
    t = TYPES[name]
    return struct(t.fields_for(), t.groups).add("file", T.StringType())


def field_spec(spark: SparkSession) -> DataFrame:
    """(doc_type, variant, path, field, kind, weight, tolerance, is_key, optional), a row for each declared field."""
    rows = []
    for t in TYPES.values():
        for variant in t.variants or ("",):
            rows += [(t.name, variant, "", f) for f in t.graded_fields(variant)]
        todo = [("", g) for g in t.groups]
        while todo:
            path, g = todo.pop()
            here = f"{path}.{g.name}".lstrip(".")
            rows += [(t.name, "", here, f) for f in g.fields]
            todo += [(here, x) for x in g.groups]
    return spark.createDataFrame(
        [(t, v, p, f.name, f.kind, f.weight, f.tolerance, f.key, f.optional) for t, v, p, f in rows],
        "doc_type string, variant string, path string, field string, kind string, weight double, tolerance double, is_key boolean, optional boolean",
    )


# Kinds whose values are numbers or truth values in JSON; all others are strings.
JSON_KINDS = {"money": "number", "number": "number", "bool": "boolean"}


def json_schema(name: str, variant: str = "") -> dict:
    """JSON Schema of a type's answer: nullable values, optional fields as a status with a value, groups with a row limit.

    The variant's key is not asked for, as it chose the schema.
    """

    def value(f: Field) -> dict:
        plain = {"type": [JSON_KINDS.get(f.kind, "string"), "null"]}
        return closed({"status": {"type": "string", "enum": ["present", "absent", "unclear"]}, "value": plain}) if f.optional else plain

    def closed(properties: dict) -> dict:
        return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}

    def body(fields: tuple[Field, ...], groups: tuple[Group, ...]) -> dict:
        rows = {g.name: {"type": "array", "maxItems": g.max_rows, "items": body(g.fields, g.groups)} for g in groups}
        return closed({f.name: value(f) for f in fields} | rows)

    t = TYPES[name]
    return body(t.graded_fields(variant), t.groups)


def type_of_stem(stem: str) -> DocType | None:
    """The type whose label file has that stem."""
    return next((t for t in TYPES.values() if t.label_file == stem), None)
