from pyspark.sql import functions as F

from lectern.functions import fields as f
from lectern.operators import classify, repair, sampling, scoring, validate
from lectern.registry import Field
from lectern.sources import fixtures


def test_clean_invoices_have_no_findings(spark):
    made = fixtures.invoices(spark, 300)
    assert validate.findings(validate.check(made, "invoice"), "file").count() == 0
    again = fixtures.invoices(spark, 300).repartition(5)
    assert made.exceptAll(again).count() == 0 and made.select("file").distinct().count() == 300


def test_planted_defects_are_found_and_no_others(spark):
    made = fixtures.inject(fixtures.invoices(spark, 600), share=0.5).cache()
    found = {(r.file, r.code) for r in validate.findings(validate.check(made, "invoice"), "file").select("file", "code").collect()}
    planted = {(r.file, r.code) for r in made.select("file", F.explode("irregularities").alias("code")).collect()}
    assert found == planted and {c for _, c in planted} == {*fixtures.DISAGREEMENTS, *fixtures.ABSENCES}
    spoilt = made.where(F.size("irregularities") > 0).count()
    assert 230 < spoilt < 370 and fixtures.inject(fixtures.invoices(spark, 50), share=0.0).where(F.size("irregularities") > 0).count() == 0


def test_bundles_hold_every_document_once(spark):
    pool = spark.range(500).select(F.format_string("d%d", "id").alias("file"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("doc_type"), (F.col("id") % 4 + 1).alias("pages"))
    rows = fixtures.bundles(pool).collect()
    pages = {r.file: r.pages for r in pool.collect()}
    assert sorted(r.file for r in rows) == sorted(pages)
    by = {}
    for r in rows:
        assert r.last_page - r.first_page + 1 == pages[r.file]
        by.setdefault(r.bundle, []).append(r)
    joins = same = 0
    for members in by.values():
        members.sort(key=lambda r: r.first_page)
        assert len(members) <= 4 and members[0].first_page == 0
        for a, b in zip(members, members[1:], strict=False):
            assert b.first_page == a.last_page + 1
            joins, same = joins + 1, same + (a.doc_type == b.doc_type)
    assert joins and same / joins > 0.4
    assert fixtures.bundles(pool.limit(0)).count() == 0


def test_dates_of_odd_shapes(spark):
    texts = ["2026", "2026-03", "2026-03-09 10:00", "+2026-03-09", "0000-01-01", "2026-02-30", "Foo 1, 2026", "13/01/2026", "Marchy 1, 2026", "02/29/00", "MAY 1, 2026", "9 march 2026", "2026-3/9"]
    got = [r.d and str(r.d) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f.parse_date(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [None] * 9 + ["2000-02-29", "2026-05-01", "2026-03-09", None]


def test_money_in_parentheses(spark):
    texts = ["(45.00)", "(0)", "(-3)", "-2", "()", "USD (1,234.50)", "1-2", None]
    got = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f.parse_money(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [-45.0, 0.0, -3.0, -2.0, None, 1234.5, None, None] and str(got[1]) == "0.0"


def test_field_scores_of_nothing_and_of_blanks(spark):
    fields = (Field("a", "text"), Field("b", "money"))
    t = spark.createDataFrame([("f1", "x", "1"), ("f2", "", None)], "file string, a string, b string")
    p = spark.createDataFrame([("f1", "x", "1.0"), ("f2", "y", None)], "file string, a string, b string")
    rows = scoring.long_pairs(scoring.pair(p, t), fields)
    got = {r.field: r for r in scoring.field_scores(rows).collect()}
    assert (got["a"].n, got["a"].spurious, got["a"].false_positive_rate, got["a"].presence_accuracy) == (2, 1, 1.0, 0.5)
    assert (got["b"].blank, got["b"].recovered_by_normalisation, [tuple(x) for x in got["b"].notes]) == (1, 1, [("within", 1)])
    assert [r.field for r in scoring.abstention(scoring.field_scores(rows)).collect()] == ["a", "b"]
    assert scoring.field_scores(rows.limit(0)).count() == 0


def test_group_scores_with_missing_rows(spark):
    line = "array<struct<description: string>>"
    t = spark.createDataFrame([("f1", [("a",), ("b",)]), ("f2", None)], f"file string, line_items {line}")
    p = spark.createDataFrame([("f1", [("a",)])], f"file string, line_items {line}")
    m = spark.createDataFrame([("f1", 0, 0, 1.0)], "file string, t int, p int, score double")
    assert tuple(scoring.group_scores(t, p, m).first()) == (2, 1, 1, 1.0, 0.5, 0.6667)


def test_declared_weights(spark):
    w = scoring.weights((Field("ssn", weight=3.0), Field("name")), F.col("n"))
    assert [r.w for r in spark.createDataFrame([("ssn",), ("name",), ("other",)], "n string").select(w.alias("w")).collect()] == [3.0, 1.0, 1.0]


def test_totals_count_abstentions_against_accuracy(spark):
    df = spark.createDataFrame([("a", "a", "b"), ("a", "b", "a"), ("a", None, None), ("b", "", None)], "t string, p string, second string")
    assert tuple(classify.totals(df, "t", "p", "second").first()) == (4, 2, 2, 1, 0.25, 0.5, 1)
    assert tuple(classify.totals(df.limit(0), "t", "p").first()) == (0, 0, 0, 0, None, None, 0)


def test_held_out_takes_each_design_in_turn(spark):
    df = spark.createDataFrame([("a", "x", i) for i in range(20)] + [("a", "y", 20), ("a", "z", 21)], "label string, design string, id int")
    got = sampling.held_out(df, "label", "id", 4, design="design").collect()
    assert len(got) == 4 and {r.design for r in got} == {"x", "y", "z"}


def test_arm_keeps_what_a_failed_attempt_left(spark):
    c = spark.createDataFrame([("f1", "s", "bad", ["c"], 0.5, 1, 2, 1), ("f2", "s", "bad", ["c"], 0.5, 1, 2, 1)], "file string, source string, record string, complaints array<string>, before double, correct_before int, fields int, gates_before int")
    attempt = lambda df: df.where("file = 'f1'").select("file", F.lit("good").alias("produced"), F.lit(None).cast("string").alias("error"))
    review = lambda df: df.select("file", F.array(F.lit("c")).alias("complaints"), F.when(F.col("record") == "good", 0).otherwise(1).alias("gates"))
    grade = lambda df: df.where("record = 'good'").select("file", F.lit(1.0).alias("after"), F.lit(2).alias("correct_after"))
    rows = {r.file: r for r in repair.run_arm("once", c, attempt, review, grade).collect()}
    assert (rows["f1"].arm, rows["f1"].after, rows["f1"].gates_after, rows["f1"].error) == ("once", 1.0, 0, "")
    assert (rows["f2"].after, rows["f2"].correct_after, rows["f2"].gates_after, rows["f2"].error) == (0.5, 1, 1, "declined")
