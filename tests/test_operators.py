import random

import pytest
from pyspark.sql import functions as F

from lectern import registry
from lectern.functions import fields as f
from lectern.operators import measure, repair, route, rules, sampling, scoring, split, validate
from lectern.registry import TYPES, Field


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("text", ["03/29/2026", "3/29/2026", "03/29/26", "Mar 29, 2026", "March 29, 2026", "29 Mar 2026", "29 March 2026", "2026-03-29", "2026/03/29", " 2026-03-29 "])
def test_dates(spark, text):
    assert str(one(spark, text, f.parse_date)) == "2026-03-29"


@pytest.mark.parametrize("text", ["not a date", "", None, "13/45/2026"])
def test_no_dates(spark, text):
    assert one(spark, text, f.parse_date) is None


def test_century(spark):
    assert str(one(spark, "01/02/69", f.parse_date)) == "1969-01-02" and str(one(spark, "01/02/68", f.parse_date)) == "2068-01-02"


@pytest.mark.parametrize(("text", "want"), [("$4,102.50", 4102.5), ("INR 1,676,976.00", 1676976.0), ("(45.00)", -45.0), ("n/a", None), ("-", None), ("", None), (None, None)])
def test_money(spark, text, want):
    assert one(spark, text, f.parse_money) == want


@pytest.mark.parametrize(("text", "want"), [("Yes", True), ("checked", True), ("No", False), ("☐", False), ("maybe", None)])
def test_bool(spark, text, want):
    assert one(spark, text, f.parse_bool) is want


def test_names(spark):
    assert one(spark, "Acme, Inc. L.L.C.", f.normalise_name) == "acme" and one(spark, "Inc", f.normalise_name) == ""


@pytest.mark.parametrize(("kind", "p", "t", "exact", "match"), [
    ("money", "4103.00", "4102.50", False, False), ("money", "$4,102.50", "4102.5", False, True), ("identifier", "A471", "4471", False, False),
    ("phone", "(555) 010-2000", "555-010-2000", False, True), ("text", "", None, True, True), ("text", None, "x", False, False),
    ("name", "Acme Inc", "Acme, Incorporated", False, True), ("date", "Mar 29, 2026", "2026-03-29", False, True), ("date", "x", "x", True, True),
])
def test_compare(spark, kind, p, t, exact, match):
    row = spark.createDataFrame([(p, t)], "p string, t string").select(f.compare(kind, F.col("p"), F.col("t")).alias("c")).first().c
    assert (row.exact, row.match) == (exact, match)


def test_fuzzy_is_not_symmetric(spark):
    from lectern.functions.fuzzy import ratio

    row = spark.createDataFrame([("tide", "diet")], "a string, b string").select(ratio(F.col("a"), F.col("b")).alias("x"), ratio(F.col("b"), F.col("a")).alias("y")).first()
    assert (row.x, row.y) == (0.25, 0.5)


def test_wilson_stays_in_range(spark):
    rows = spark.createDataFrame([(0, 5), (5, 5), (1, 3), (8, 40), (0, 1), (0, 0)], "h int, n int").select(f.wilson(F.col("h"), F.col("n")).alias("w")).collect()
    assert all(0 <= r.w.low <= r.w.high <= 1 for r in rows[:-1]) and rows[-1].w.low is None


def test_registry(spark):
    assert len(registry.labels()) == 9
    assert len(TYPES["form"].fields_for("w9")) == 12 and len(TYPES["invoice"].fields) == 11
    spec = registry.field_spec(spark)
    assert spec.where("doc_type = 'multi_bill_invoice' and path = 'sections' and is_key").count() == 2
    assert {x.name for x in registry.schema("resume").fields} >= {"work_history", "file"}


LINES = "array<struct<description:string,quantity:string,unit_price:string,amount:string>>"


def invoice(spark, amount="50", total="107", subtotal="100"):
    row = ("INV-1", "Acme", subtotal, "7", total, [("a", "2", "25", amount), ("b", "1", "50", "50")])
    return spark.createDataFrame([row], f"invoice_number string, bill_to string, subtotal string, tax string, total string, line_items {LINES}")


def codes(df, *a, **k):
    return [r.code for r in validate.findings(validate.check(df, *a, **k)).collect()]


def test_clean_invoice_has_no_finding(spark):
    assert codes(invoice(spark), "invoice") == []


def test_cause_hides_consequence(spark):
    assert codes(invoice(spark, amount="61"), "invoice") == ["line_item_math_error"]
    assert codes(invoice(spark, subtotal="90"), "invoice") == ["subtotal_mismatch"]
    assert codes(invoice(spark, total="117"), "invoice") == ["total_mismatch"]
    assert codes(invoice(spark, total=None), "invoice") == []


def test_form_and_resume_codes(spark):
    form = spark.createDataFrame([("", "", "", "", "0", "", "")], "signature string, sign_date string, ssn string, ein string, x string, tax_classification string, tin_type string")
    assert set(codes(form, "form", "w9")) == {"missing_signature", "missing_sign_date", "missing_tin", "no_tax_classification_selected", "no_tin_type_selected"}
    resume = spark.createDataFrame([("", "1", [("x", "2020", "2010"), ("y", "", "")], [])], "email string, phone string, work_history array<struct<company:string,start_year:string,end_year:string>>, skills array<string>")
    assert set(codes(resume, "resume")) == {"missing_email", "no_skills_listed", "impossible_employment_dates", "missing_employment_dates"}


def test_sections(spark):
    s = [("A", "1", "2", "5", "1", "6", []), ("A", "1", "2", "5", "1", "9", []), ("", None, None, "1", "1", "-2", [])]
    df = spark.createDataFrame([("2", "1", "0", "1", s)], "section_count string, subtotal string, tax string, total string, "
                               f"sections array<struct<account_number:string,service_period_start:string,service_period_end:string,subtotal:string,tax:string,total:string,line_items:{LINES}>>")  # fmt: skip
    assert set(codes(df, "multi_bill_invoice")) == {
        "section_total_mismatch", "duplicate_section_account", "overlapping_service_periods", "negative_section_total",
        "section_count_mismatch", "invoice_total_not_sum_of_sections", "missing_section_account", "missing_section_period",
    }


def test_rules(spark):
    rows = [("a", "1", "5", "5"), (None, " ", None, ""), ("Total:", None, None, "107"), ("Tax", None, None, "42.75"), ("Subtotal", None, None, None)]
    df = spark.createDataFrame([("INVOICE NO 77A", "100", "7", "107", rows)], f"invoice_number string, subtotal string, tax string, total string, line_items {LINES}")
    out = rules.apply(df, "invoice").first()
    assert [r.description for r in out.line_items] == ["a", "Tax"] and out.invoice_number == "77A"
    assert out._rules_applied == {"drop_empty_rows": 1, "drop_rollup_rows": 2, "strip_identifier_labels": 1}
    with pytest.raises(ValueError, match="unknown rules"):
        rules.apply(df, "invoice", disabled=("no_such",))


def test_row_matching(spark):
    t = spark.createDataFrame([("f", [("A1", "x"), ("B2", "y")])], "file string, g array<struct<k:string,v:string>>")
    p = spark.createDataFrame([("f", [("B2", "y"), ("A1", "z"), ("junk", "q")])], "file string, g array<struct<k:string,v:string>>")
    got = scoring.match_rows(t, p, (Field("k", "identifier", key=True), Field("v", "enum")), group="g")
    assert sorted((r.t, r.p, round(r.score, 2)) for r in got.collect()) == [(0, 1, 0.75), (1, 0, 1.0)]


def test_truth_against_itself_and_nothing(spark):
    fields = (Field("a", "identifier"), Field("b", "money"))
    t = spark.createDataFrame([("x", "q", "1"), ("y", "", "2")], "file string, a string, b string")
    full = scoring.long_pairs(scoring.pair(t, t), fields).agg(*scoring.summary()).first()
    none = scoring.long_pairs(scoring.pair(t.limit(0), t), fields).agg(*scoring.summary()).first()
    assert full.accuracy == 1.0 and none.accuracy_nonblank == 0.0


def test_ranks_and_constants(spark):
    long = spark.createDataFrame([("s", v, o) for v, o in ((1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 4.0))] + [("c", 1.0, float(i)) for i in range(4)], "signal string, value double, outcome double")
    got = {r.signal: r.rho for r in measure.spearman(long).collect()}
    assert got["c"] is None and got["s"] == pytest.approx(0.9487, abs=1e-4)


def test_split(spark):
    pages = spark.createDataFrame([("f", i, x) for i, x in enumerate(["a", "a", "b", "", "b", "c"])], "file string, page int, label string")
    cut = split.boundaries_by_type(pages)
    assert [r.page for r in cut.where("boundary").orderBy("page").collect()] == [2, 5]
    assert [(r.first_page, r.last_page) for r in split.spans(cut).orderBy("first_page").collect()] == [(0, 1), (2, 4), (5, 5)]


def test_gates(spark):
    df = spark.createDataFrame([(0.9, 0), (0.5, 0), (None, 1)], "c double, e int")
    got = route.decide(df, {"classifier_confidence": F.col("c"), "validator_errors": F.col("e")}).select("action", F.col("reasons.gate").alias("g")).collect()
    assert [(r.action, r.g) for r in got] == [("accept", []), ("review", ["classifier_confidence"]), ("review", ["validator_errors"])]
    assert not route.enabled("classifier_floor", 0) and route.enabled("validator_errors_ceiling", 0) and not route.enabled("validator_errors_ceiling", -1)


def test_exploration_share(spark):
    n = spark.range(4000).where(route.explore(F.col("id").cast("string"), 0.2)).count()
    assert 0.17 < n / 4000 < 0.23


def arms(spark, seed=1):
    r = random.Random(seed)
    rows = [(f"d{i}", f"s{i // 2}", r.choice([0.0, 0.25, 0.5, 0.75, 1.0]), r.choice([0.0, 0.25, 0.5, 0.75, 1.0])) for i in range(40)]
    df = spark.createDataFrame(rows, "file string, source string, a double, b double")
    return df.select("file", "source", F.col("a").alias("value")), df.select("file", "source", F.col("b").alias("value"))


def test_swap_negates_and_self_is_zero(spark):
    a, b = arms(spark)
    x, y, z = repair.paired(a, b).first(), repair.paired(b, a).first(), repair.paired(a, a).first()
    assert x.mean_delta == -y.mean_delta and (x.better, x.worse) == (y.worse, y.better) and z.mean_delta == 0 and z.tied == 40


def test_bootstrap_repeats_and_needs_three_clusters(spark):
    a, _ = arms(spark)
    x, y = (repair.interval(d, F.col("value")).first() for d in (a, a.orderBy(F.rand(3))))
    assert x == y and x.low < x.high and x.clusters == 20
    assert repair.interval(a.where("source in ('s0', 's1')"), F.col("value")).first().low is None


def test_stratified(spark):
    df = spark.createDataFrame([(i, b) for b, n in (("a", 40), ("b", 40), ("c", 20)) for i in range(n)], "i int, b string").withColumn("o", F.hash("i", "b"))
    got = [r.b for r in sampling.stratified(df, "b", "o", 12).collect()]
    assert all(got.count(x) == 4 for x in "abc")


def test_records_and_resume(spark, tmp_path):
    from lectern.sources import records
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("x", T.LongType())])
    (tmp_path / "a.json").write_text('[{"file": "a", "x": 1}, {"file": "b", "x": 2}]')
    (tmp_path / "l.json").write_text('{"file": "a", "x": 1}\n{"file": "b", "_error": "no"}\n{"file": "c", "x"')
    assert records.load_records(spark, str(tmp_path / "a.json"), schema).count() == 2
    done = records.resume(spark, str(tmp_path / "l.json"), schema)
    assert [r.file for r in done.collect()] == ["a"]
    jobs = spark.createDataFrame([("a",), ("b",)], "file string")
    assert [r.file for r in records.pending(jobs, done).collect()] == ["b"]
    with pytest.raises(ValueError, match="not in the corpus"):
        records.cohort(jobs, spark.createDataFrame([("z",)], "file string"))


def test_records_of_a_mixed_folder(spark, tmp_path):
    """Each file is read as what it is; blank and empty files hold nothing."""
    from lectern.sources import records
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.LongType())])
    labels = tmp_path / "labels"
    labels.mkdir()
    files = {"array": '\n [{"x":1},\n{"x":2}]', "lines": '{"x":3}\n\n{"x":4}\n', "one": '{\n "x": 5\n}\n', "a b": '{"x":6}', "blank": "\n \n", "empty": ""}
    for name, text in files.items():
        (labels / f"{name}.json").write_text(text)
    assert sorted(r.x for r in records.load_records(spark, str(labels), schema).collect()) == [1, 2, 3, 4, 5, 6]
    got = sorted((r.stem, r.x) for r in records.load_corpus(spark, str(tmp_path), schema).collect())
    assert got == [("a b", 6), ("array", 1), ("array", 2), ("lines", 3), ("lines", 4), ("one", 5)] or got == [("a%20b", 6), *got[1:]]
    assert records.load_corpus(spark, str(tmp_path), schema, ("one", "lines")).count() == 3
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.json").write_text("")
    assert records.load_records(spark, str(tmp_path / "none"), schema).count() == 0


def test_stream_appends_once(spark, tmp_path):
    from lectern.streaming.ingest import append_once

    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        (src / f"{i}.json").write_text(f'{{"file": "f{i}"}}\n')
        append_once(spark, str(src), "file string", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
