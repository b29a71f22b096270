"""Made-up records with known defects, and plans of bundles: what the validators and splitters are tested on."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

VENDORS = ("Northfield Supply Inc", "Harbor Paper Co", "Lakeview Tools LLC", "Orchard Print Ltd")
ITEMS = ("paper", "toner", "labels", "shelving", "cable", "lamps")


def _draw(seed: int, salt: str, n: int, *more: Column) -> Column:
    """A number from 0 to n - 1, the same for the same record, seed and salt."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}:{salt}"), *more), F.lit(n))


def _one_of(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))


def line(description: Column, quantity: Column, price: Column) -> Column:
    """A line whose amount is the rounded product."""
    return F.struct(description.alias("description"), quantity.alias("quantity"), price.alias("unit_price"), F.round(quantity * price, 2).alias("amount"))


def totalled(df: DataFrame, tax_rate: float) -> DataFrame:
    """df with subtotal, tax and total of its line_items."""
    df = df.withColumn("subtotal", F.round(F.aggregate("line_items", F.lit(0.0), lambda a, r: a + r["amount"]), 2))
    df = df.withColumn("tax", F.round(F.col("subtotal") * tax_rate, 2))
    return df.withColumn("total", F.round(F.col("subtotal") + F.col("tax"), 2))


def invoices(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n clean invoices, from their numbers and the seed alone, so any number of tasks makes the same ones."""
    day = F.date_add(F.lit("2026-01-01").cast("date"), _draw(seed, "day", 300).cast("int"))
    lines = F.transform(
        F.sequence(F.lit(1), (_draw(seed, "lines", 5) + 1).cast("int")),
        lambda i: line(_one_of(ITEMS, _draw(seed, "item", len(ITEMS), i)), (_draw(seed, "quantity", 9, i) + 1).cast("double"), F.round((_draw(seed, "price", 20000, i) + 100) / 100, 2)),
    )
    rows = spark.range(n).select(
        "id", F.format_string("invoice-%09d.pdf", "id").alias("file"), F.lit("invoice").alias("doc_type"), (_draw(seed, "layout", 4) + 1).cast("int").alias("layout"),
        _one_of(VENDORS, _draw(seed, "vendor", len(VENDORS))).alias("vendor_name"), F.format_string("INV-%09d", "id").alias("invoice_number"),
        F.date_format(day, "yyyy-MM-dd").alias("invoice_date"), F.date_format(F.date_add(day, 30), "yyyy-MM-dd").alias("due_date"),
        F.format_string("PO-%d", _draw(seed, "po", 90000) + 10000).alias("po_number"), F.lit("Accounts Payable, 1 Main Street").alias("bill_to"),
        F.lit("Net 30").alias("terms"), F.lit("USD").alias("currency"), lines.alias("line_items"),
    )
    return totalled(rows, 0.08).withColumn("irregularities", F.array().cast("array<string>")).drop("id")


def _first_line(df: DataFrame) -> dict[str, Column]:
    return {"line_items": F.transform("line_items", lambda r, i: F.when(i == 0, r.withField("amount", F.round(r["amount"] + 10, 2))).otherwise(r))}


#: What goes wrong: a code, and the columns that it changes.  Of the first group a record gets one, as each hides the others.
DISAGREEMENTS = {
    "line_item_math_error": _first_line,
    "subtotal_mismatch": lambda df: {"subtotal": F.round(F.col("subtotal") + 7, 2)},
    "total_mismatch": lambda df: {"total": F.round(F.col("total") + 5, 2)},
}
ABSENCES = {"missing_invoice_number": lambda df: {"invoice_number": F.lit(None).cast("string")}, "missing_bill_to": lambda df: {"bill_to": F.lit("")}}


def inject(df: DataFrame, share: float = 1.0, seed: int = 42) -> DataFrame:
    """Invoices of which a share has one or two defects, named in `irregularities`; who gets which follows from the file's hash."""
    def draw(salt, n):
        return F.pmod(F.xxhash64(F.col("file"), F.lit(f"{seed}:{salt}")), F.lit(n))

    hit = draw("hit", 1_000_000) < int(share * 1_000_000)
    picked = draw("kinds", 3)  # a disagreement, an absence, or both
    chosen = {}
    for table, kinds in ((ABSENCES, (1, 2)), (DISAGREEMENTS, (0, 2))):
        which = draw("+".join(table), len(table))
        for i, code in enumerate(table):
            chosen[code] = (table[code], hit & picked.isin(*kinds) & (which == i))
    tags = F.filter(F.array(*(F.when(on, F.lit(code)) for code, (_, on) in chosen.items())), lambda x: x.isNotNull())
    df = df.withColumn("irregularities", tags)
    for make, on in chosen.values():
        df = df.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, v in make(df).items()})
    return df


def bundles(pool: DataFrame, each: int = 100, seed: int = 42, same_type: float = 0.5, single: float = 0.15) -> DataFrame:
    """(bundle, file, doc_type, first_page, last_page): documents packed into bundles of one to four, pages from 0.

    pool: (file, doc_type, pages).  Documents are dealt by hash to parts of about `each`, which are planned apart; of the joins
    `same_type` at least repeat the type, while the part has more of it.  Every document is in one bundle.
    """
    parts = max(1, pool.count() // each)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        pick, left, out, number = random.Random(f"{seed}:{part}"), {}, [], 0
        for row in pdf.sort_values("file").itertuples():
            left.setdefault(row.doc_type, []).append((row.file, row.doc_type, int(row.pages)))
        for rows in left.values():
            pick.shuffle(rows)

        while any(left.values()):
            length, at, kind = 1 if pick.random() < single else pick.randint(2, 4), 0, None
            for _ in range(length):
                if not (kind is not None and left[kind] and pick.random() < same_type):
                    # The type with most documents left, so that none piles up at the end.
                    kind = max(sorted(left), key=lambda t: len(left[t]))
                if not left[kind]:
                    break
                file, doc_type, pages = left[kind].pop()
                out.append((f"bundle-{part:06d}-{number:05d}", file, doc_type, at, at + pages - 1))
                at += pages
            number += 1
        return pd.DataFrame(out, columns=["bundle", "file", "doc_type", "first_page", "last_page"])

    ship()
    rows = pool.select("file", F.coalesce("doc_type", F.lit("")).alias("doc_type"), "pages", F.pmod(F.xxhash64("file"), F.lit(parts)).alias("part"))
    return rows.groupBy("part").applyInPandas(plan, "bundle string, file string, doc_type string, first_page long, last_page long")
