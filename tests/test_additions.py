"""Signals, readings, answers, plugins, provenance, sources and streams on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern import plugins, registry
from lectern.functions import answers
from lectern.functions.fields import compare
from lectern.operators import measure, provenance, readings, repair, route, scoring, signals, split
from lectern.registry import Field
from lectern.sources import records
from lectern.streaming import ingest


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('Sure: {"a": "}"} ok', {"a": "}"}), ("```\n{}```", {}), ("[1]", None), ("", None), (None, None), ('{"a"', None), ("no", None),
    ],
)
def test_find_object(text, want):
    got = answers.find_object(text)
    assert (json.loads(got) if got else None) == want


def test_extract_json_column(spark):
    df = spark.createDataFrame([("{\"a\":1}",), ("x {\"a\":2} y",), (None,), ("{",)], "t string")
    assert [r.k for r in df.select(F.get_json_object(answers.extract_json(F.col("t")), "$.a").alias("k")).collect()] == ["1", "2", None, None]


def test_merge_keeps_the_harness_columns_and_collapses_optional_fields(spark):
    a = spark.createDataFrame([("f1", 3, "old")], "file string, _seconds int, name string")
    b = spark.createDataFrame([("f1", "new", ("unclear", "made up"))], "file string, name string, business_name struct<status:string,value:string>")
    r = answers.merged(a, b, "form", "w9").first()
    assert (r.file, r._seconds, r.name, r.business_name, r.doc_type, r.form_type) == ("f1", 3, "new", None, "form", "w9")
    assert json.loads(a.select(answers.previous(a).alias("p")).first().p) == {"name": "old"}


def test_complaints_leave_warnings_out(spark):
    df = spark.sql("select array(struct('a' code, 'x' field, 'error' severity), struct('b' code, 'y' field, 'warning' severity)) f")
    df = route.decide(df.withColumn("c", F.lit(0.2)), {"classifier_confidence": F.col("c")})
    got = df.select(answers.complaints(F.col("f"), F.col("reasons")).alias("c")).first().c
    assert [(x.origin, x.code) for x in got] == [("validator", "a"), ("router", "classifier_confidence")]


def test_ordered_equals_positions_in_the_sorted_values(spark):
    r = random.Random(7)
    rows = [(g, r.choice([1.0, 2.0, 2.5, 9.0]) + r.randrange(40)) for g, n in (("a", 1), ("b", 2), ("c", 57), ("d", 1000)) for _ in range(n)]
    got = {x.g: (x.median, x.p10, x.worst) for x in repair.ordered(spark.createDataFrame(rows, "g string, v double"), ("g",), "v").collect()}
    for g in "abcd":
        d = sorted(v for k, v in rows if k == g)
        assert got[g] == (d[len(d) // 2], d[max(0, int(0.1 * len(d)) - 1)], d[0])


def test_before_is_exact_for_skewed_values_and_null_groups(spark):
    r = random.Random(3)
    rows = [(None if i % 3 == 0 else "g", float(int(r.paretovariate(0.5)))) for i in range(3000)]
    per = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("k"))
    for x in measure.before(per, ("g",), "v").collect():
        assert x.before == sum(1 for g, v in rows if g == x.g and v < x.v)


def test_signals_of_too_few_rows_or_a_constant(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (1.0, 2.0, 1.0), (1.0, None, 1.0)], "a double, b double, o double")
    got = {r.signal: r for r in measure.signal_report(df, {"a": 1, "b": 1}, "o").collect()}
    assert got["a"].rho is None and got["a"].direction_agrees is None and got["a"].available == 3 and got["a"].lift is not None
    assert (got["b"].available, got["b"].missing, got["b"].rho, got["b"].lift) == (1, 2, None, None)
    assert measure.signal_report(df.limit(0), {"a": 1}, "o").count() == 0


def test_missing_blocks_are_null_signals(spark):
    df = spark.createDataFrame([("f", " ", [("x",)])], "file string, invoice_number string, line_items array<struct<description:string>>")
    r = signals.extract(df, "invoice").first()
    assert r.blank_share == 1.0 and r.rows == 1.0 and r.ocr_confidence is None and r.classifier_margin is None and r.validator_errors is None


def test_one_reader_has_no_agreement_and_an_empty_one_agrees_with_none(spark):
    df = spark.createDataFrame([(["a=3ch/conf0.5/1s"],), (["a=0ch/conf0.5/1s", "b=9ch/conf0.75/1s"],), (["a=0ch/conf0.5/1s", "b=0ch/conf0.5/1s"],)], "tried array<string>")
    df = df.select(F.struct(F.lit("ocr").alias("layer"), F.lit(0.5).alias("confidence"), F.lit(10).alias("words"), F.lit(0).alias("pages"), "tried").cast(signals.READING).alias("b"))
    got = df.select(*(v.alias(k) for k, v in signals.reading(F.col("b")).items())).collect()
    assert [r.engine_agreement for r in got] == [None, 0.0, 0.0] and [r.engine_confidence_spread for r in got] == [None, 0.25, 0.0] and got[0].words_per_page is None


def test_readings(spark):
    dpi = spark.sql("select array(struct(1700 pixels, 612.0 points), struct(10 pixels, 0.0 points)) a, array(struct(10 pixels, 612.0 points)) b, cast(array() as array<struct<pixels:int,points:double>>) c")
    assert tuple(dpi.select(*(readings.source_dpi(F.col(c)) for c in "abc")).first()) == (200, 96, 300)
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(5.0).alias("y1"))
    w = spark.sql("select ' ab  cde\tf ' t, '  ' e").select(readings.split_line(F.col("t"), box).alias("w"), readings.split_line(F.col("e"), box).alias("e")).first()
    assert [(x.text, round(x.x0, 3), round(x.x1, 3)) for x in w.w] == [("ab", 0, 25), ("cde", 37.5, 75), ("f", 87.5, 100)] and w.e == []
    q = spark.sql("select array(struct(3 x, 9 y), struct(1 x, 2 y), struct(5 x, 4 y)) q").select(readings.quad_box(F.col("q")).alias("b")).first().b
    assert tuple(q) == (1, 2, 5, 9)
    assert spark.sql("select 'abc' t, cast(null as double) c, 1.25d s").select(readings.summarise(F.col("t"), F.col("c"), F.col("s"))).first()[0].startswith("3ch/conf-/1.")


def test_lines_keep_the_order_of_the_page(spark):
    rows = [("p", 1, 1, 2, 1, "total", 90.0), ("p", 1, 1, 1, 2, "world", 90.0), ("p", 1, 1, 1, 1, "hello", -1.0), ("p", 1, 1, 1, 3, " ", 90.0)]
    df = spark.createDataFrame(rows, "file string, block int, par int, line int, n int, text string, conf double")
    assert readings.lines(df, ("file",)).first().text == "hello world\ntotal" and readings.lines(df, ("file",), 50.0).first().text == "world\ntotal"
    pages = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("f", 3, " ")], "file string, page int, text string")
    assert readings.marked(pages).first().text == "--- page 1 ---\na\n\n--- page 2 ---\nb"


def test_consensus_of_different_and_single_texts(spark):
    rows = [("a", 1, "x", "tide", "ocr", 0.9), ("a", 2, "y", "diet", "ocr", 0.8), ("b", 1, "x", "", "ocr", 0.9), ("b", 2, "y", "text", "ocr", 0.1)]
    got = {r.file: r for r in readings.consensus(spark.createDataFrame(rows, "file string, order int, engine string, text string, layer string, confidence double")).collect()}
    assert (got["a"].engine, got["a"].agreement) == ("x", 0.25) and (got["b"].engine, got["b"].agreement) == ("y", None)


def test_common_cohort(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "3"), ("b", "1")], "engine string, file string")
    rows, extra = readings.common_cohort(df)
    assert {r.file for r in rows.collect()} == {"1"} and {r.engine: r.extra for r in extra.collect()} == {"a": 1, "b": 1}


def test_effects_table(spark):
    states = ("right", "correctly_blank", "missed", "fabricated", "wrong")
    df = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    got = {(r.before, r.after): r.effect for r in repair.transitions(df, "a", "b").collect()}
    assert {k for k, v in got.items() if v == "damaging"} == set(repair.DAMAGING) and {k for k, v in got.items() if v == "safer"} == set(repair.SAFER)
    assert got["wrong", "wrong"] == "neutral" and got["missed", "right"] == "repairing"


def test_control_has_no_effect(spark):
    rows = [("rerun@2", "f", "s", 0.5, 0.75, 2, 3, 4, 1, 0, 2, None), ("rerun@2", "g", "s", 0.5, 0.5, None, None, 4, 0, 0, 1, "x: y")]
    o = spark.createDataFrame(rows, "arm string, file string, source string, before double, after double, correct_before int, correct_after int, fields int, gates_before int, gates_after int, attempts int, error string")
    both = o.unionByName(repair.no_repair(o))
    got = {r.arm: r for r in repair.score_arms(both).collect()}
    n, x = got["no_repair"], got["rerun@2"]
    assert (n.net_delta, n.improved, n.damaged, n.attempts, n.failed) == (0.0, 0, 0, 0, 0)
    assert (x.improved, x.damaged, x.failed, x.gates_clear, x.net_delta, x.net_delta_field_weighted, x.net_delta_when_it_ran) == (1, 0, 1, 1, 0.125, None, 0.25)
    a = repair.against(both).collect()
    assert [(r.arm, r.control, r.files, r.better, r.low) for r in a] == [("rerun@2", "no_repair", 2, 1, None)]


def test_separated(spark):
    df = spark.sql("select struct(0.1d low, 0.2d high) a, struct(0.3d low, 0.4d high) b, cast(null as struct<low:double,high:double>) c")
    r = df.select(repair.separated(F.col("a"), F.col("b")), repair.separated(F.col("a"), F.col("a")), repair.separated(F.col("a"), F.col("c"))).first()
    assert tuple(r) == (True, False, False)


def test_split_summary(spark):
    docs = spark.createDataFrame([("f", 0, 3), ("f", 4, 5), ("f", 9, 9)], "file string, first_page int, last_page int")
    pieces = spark.createDataFrame([("f", 0, 1), ("f", 2, 3), ("f", 4, 5), ("f", 6, 7)], "file string, first_page int, last_page int")
    r = split.summary(split.match(pieces, docs), docs).first()
    assert (r.pieces, r.exact, r.unmatched, r.documents, r.cut, r.unseen) == (4, 1, 1, 3, 1, 1)
    assert records.manifest(pieces).first().file == "f#0-1"


def test_registry_of_plugins():
    rules = plugins.Registry("rule")
    rules.register("drop_empty", applies_to=("invoice",))(lambda: 1)
    rules.register("always")(lambda: 2)
    with pytest.raises(plugins.SettingsError):
        rules.register("always")
    with pytest.raises(plugins.SettingsError, match="drop_empty"):
        rules.enabled({"drop_emty": False})
    assert list(rules.enabled()) == ["always", "drop_empty"] and list(rules.enabled({"drop_empty": False})) == ["always"] == list(rules.enabled(doc_type="form"))


def test_settings_precedence():
    specs = (plugins.Setting("model"), plugins.Setting("tries", int, 3), plugins.Setting("key", secret=True), plugins.Setting("on", bool, False))
    env = {"DI_OPEN_AI_MODEL": "from-env", "SECRET": "s", "DI_OPEN_AI_TRIES": ""}
    got = plugins.bind("open-ai", specs, {"model": "block", "key": "${SECRET}", "on": "yes"}, env, {"tries": 5})
    assert got == {"model": "from-env", "tries": 5, "key": "s", "on": True} and plugins.redact(got, specs)["key"] == plugins.HIDDEN
    for block in ({"modle": 1}, {"tries": "many"}, {"on": "perhaps"}):
        with pytest.raises(plugins.SettingsError):
            plugins.bind("open-ai", specs, block, {})
    with pytest.raises(plugins.SettingsError, match="DI_X_K"):
        plugins.bind("x", (plugins.Setting("k", required=True),), {"k": "${NONE}"}, {})


def test_comparable_fails_closed():
    a = provenance.stamp("l", "c", "i", 3, {"model": 1})
    assert provenance.comparable(a, a) == (True, "", "") and not provenance.comparable(a, None)[0] and "not comparable" in provenance.describe({})
    assert not provenance.comparable(a, provenance.stamp("m", "c", "i", 3))[0] and not provenance.comparable(a, provenance.stamp("l", "d", "i", 3))[0]
    ok, _, note = provenance.comparable(a, provenance.stamp("l", "c", "j", 3))
    assert ok and note and provenance.fingerprint(["ab", "c"]) != provenance.fingerprint(["a", "bc"])


def test_content_fingerprint_of_order_content_and_nothing(spark):
    rows = [("a", "1"), ("b", "2"), ("c", None)]
    one, two, other = (provenance.content_fingerprint(spark.createDataFrame(x, "n string, c string"), "n", "c").first() for x in (rows, rows[::-1], [("a", "2"), ("b", "2"), ("c", None)]))
    assert one == two and one.fingerprint != other.fingerprint and (one.members, one.bytes, one.missing) == (3, 2, 1)
    none = provenance.content_fingerprint(spark.createDataFrame([], "n string, c string"), "n", "c").first()
    assert (none.members, none.bytes, none.missing) == (0, 0, 0)


def test_json_schema():
    s = registry.json_schema("form", "w9")
    assert "form_type" not in s["properties"] and set(s["properties"]["business_name"]["properties"]) == {"status", "value"} and s["required"] == list(s["properties"])
    rows = registry.json_schema("multi_bill_invoice")["properties"]["sections"]
    assert rows["maxItems"] == 50 and rows["items"]["properties"]["line_items"]["items"]["properties"]["amount"] == {"type": ["number", "null"]}
    assert registry.type_of_stem("forms").name == "form" and registry.type_of_stem("x") is None


def test_reports_jobs_and_synthetic_answers(spark, tmp_path):
    df = spark.createDataFrame([("f", 1.5)], "file string, v double")
    records.write_report(df, f"{tmp_path}/r", "score")
    assert records.read_report(spark, f"{tmp_path}/r", df.schema).first() == df.first()
    with pytest.raises(ValueError):
        records.read_report(spark, f"{tmp_path}/r", df.schema, "2")
    labels = spark.createDataFrame([("a", "forms", "w9"), ("b", "invoices", None), ("c", "other", None)], "file string, stem string, form_type string")
    assert {tuple(r) for r in records.jobs(labels).collect()} == {("a", "form", "w9"), ("b", "invoice", "")}
    assert [records.no_answers(df, k).count() for k in ("none", "empty", "self")] == [0, 1, 1]


def test_stream_of_outcomes_and_windows(spark, tmp_path):
    spark.sql("select 'f' file, array(struct('x' field, 'confirmed' action), struct('y' field, 'unsure' action)) fields, timestamp'2024-01-01 00:00:30' at, 2.0d v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    queue = spark.createDataFrame([("f", "gate"), ("g", "gate")], "file string, selection string")
    for _ in range(2):
        ingest.sink_once(ingest.reviewed(stream, queue), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("f", "gate", "x", True)]
    q = ingest.windowed(stream, "at", "1 minute", "1 minute", ("file",), "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.file, r.n, r.total) for r in spark.table("w").collect()] == [("f", 1, 2.0)]


def test_observations_count_what_has_no_grade(spark):
    c = spark.createDataFrame([("a", "form", "w9", None, 0.9), ("b", None, None, "invoice", 0.2), ("c", "form", "", None, 0.5), ("d", "form", "", None, 0.5)], "file string, doc_type string, variant string, withheld string, confidence double")
    g = spark.createDataFrame([("a", 1.0, False), ("b", 0.5, None), ("c", 0.0, True)], "file string, accuracy double, failed boolean")
    rows, counts = signals.observations(c, g)
    assert {(r.file, r.answer, r.accuracy) for r in rows.collect()} == {("a", "form:w9", 1.0), ("b", "invoice", 0.5)}
    assert {r.state: r.n for r in counts.collect()} == {"used": 2, "failed": 1, "ungraded": 1}


def test_sidecar_of_a_classification(spark):
    df = spark.createDataFrame([("form", "", 0.5, "escalated: torn"), ("form", "w9", 0.9, "")], "doc_type string, variant string, confidence double, evidence string")
    a, b = (r.s for r in df.select(signals.from_classification(df).alias("s")).collect())
    assert (a.variant, a.escalated, a.margin) == (None, True, None) and (b.variant, b.escalated) == ("w9", None)


def test_nearest_of_all_rows_equals_brute_force(spark, sf_dir):
    """The neighbour is searched among all rows, not the first 200; blocks do not change it."""
    import numpy as np

    from lectern.operators import geometry
    from lectern.plans.queries import QUERIES

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = sorted((r.vec_id, r.label, r.embedding) for r in e.collect())
    v = np.asarray([r[2] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    score = np.round(v @ v.T, 6)
    np.fill_diagonal(score, -2)
    want = [(r[0], r[1], rows[j][0], rows[j][1]) for r, j in zip(rows, score.argmax(axis=1), strict=True)]
    got = sorted((r.vec_id, r.label, r.nearest, r.nearest_label) for r in QUERIES["nn_cosine_type"](spark, sf_dir).collect())
    assert got == want and any(r[2] >= 200 for r in got)
    assert sorted(map(tuple, geometry.nearest_of_all(e, "vec_id", "embedding", "label", 70).collect())) == got
    odd = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [2.0, 0.1], 6), (3, [0.0, 0.0], 7), (4, None, 8), (5, [1.0], 9)], "vec_id long, embedding array<double>, label int")
    odd_got = {r.vec_id: r.nearest for r in geometry.nearest_of_all(odd, "vec_id", "embedding", "label", 2).collect()}
    assert odd_got == {r.vec_id: r.nearest for r in geometry.nearest(odd, odd, "vec_id", "embedding", "label").collect()}


def test_ocr_cascade_of_all_documents_reaches_the_ranking(spark, tmp_path):
    """Short, empty and unknown lengths get a reading, too."""
    from lectern.plans.queries import QUERIES

    rows = [(1, 500), (3, 500), (3000, 60), (6, 20), (7, 20), (9, 1), (12, 0), (13, 0), (15, None), (16, None)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.engine for r in QUERIES["ocr_cascade"](spark, str(tmp_path)).collect()}
    assert got == {1: "first", 3: "second", 3000: "first", 6: "second", 7: "first", 9: "first", 12: "second", 13: "first", 15: "second", 16: "first"}


def test_row_matching_equals_pairs_compared_one_by_one(spark):
    kinds = ("identifier", "enum", "ssn", "email", "date", "money", "number", "bool", "name", "text")
    words = [
        None, "", " \t", "\u00a0", "A-1", "a1", "a 1", "--", "$1,000.00", "1000", "1000.005", "(5)", "-5", " 7 ", "7.", "007", "1e5", "-", "2024-01-02", "01/02/2024", "Jan 2, 2024", "yes", "X", "no",
        "Acme Inc", "acme  llc", "Acme Corporatoin", "paper, white", "paper white a4", "papers white", "a@B.c", "A@b.C ", "123-45-6789", "123456789", "NaN", "(x", "12\n",
    ]
    pick = random.Random(3)
    row = lambda: tuple(pick.choice(words) for _ in kinds)
    some = [(f"d{i % 28}", [row() for _ in range(pick.randrange(7))] if i % 9 else None) for i in range(30)] + [(None, [row()])]
    near = [(k, [tuple(v if pick.random() < 0.7 else pick.choice(words) for v in r) for r in reversed(rows or ())]) for k, rows in some]
    schema = "file string, g array<struct<" + ",".join(f"{k}:string" for k in kinds) + ">>"
    t, p = spark.createDataFrame(some, schema), spark.createDataFrame(near, schema)
    fields = tuple(Field(k, k, key=k == "identifier", tolerance=0.5 if k == "number" else None) for k in kinds)
    pairs = t.selectExpr("file", "posexplode(g) as (t, x)").join(p.selectExpr("file", "posexplode(g) as (p, y)"), "file")
    score = sum((F.when(compare(f.kind, F.col(f"y.{f.name}"), F.col(f"x.{f.name}"), f.tolerance)["match"], 3.0 if f.key else 1.0).otherwise(0.0) for f in fields), F.lit(0.0)) / 12.0
    want, used = [], set()
    for r in sorted(pairs.select("file", "t", "p", score.alias("s")).where("s >= 0.34").collect(), key=lambda r: (r.file, -r.s, r.t, r.p)):
        if not {(r.file, "t", r.t), (r.file, "p", r.p)} & used:
            used |= {(r.file, "t", r.t), (r.file, "p", r.p)}
            want.append(tuple(r))
    got = sorted(map(tuple, scoring.match_rows(t, p, fields, group="g").collect()), key=lambda r: (r[0], -r[3], r[1], r[2]))
    assert len(want) > 30 and got == want


def test_row_matching_reads_each_row_once_and_joins_none(spark, sf_dir):
    from lectern.plans import queries

    for name in ("row_match_greedy", "group_scores"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Generate posexplode" not in plan


def test_numbers_are_read_as_their_text_is(spark):
    from lectern.functions.fields import number

    df = spark.sql("select explode(array(1.5d, -0.0d, 1e-7d, 123456789012.345d, double('NaN'), double('Infinity'), null)) d").withColumn("l", F.lit(2**53 + 1))
    got = df.select(*(number(F.col(c), kind).cast("string").alias(f"{c}{i}") for c in ("d", "l") for i, kind in enumerate((None, df.schema[c].dataType))))
    assert got.where("not (d0 <=> d1) or not (l0 <=> l1)").count() == 0


def test_numeric_bills_are_checked_without_texts_and_lines_read_once(spark, sf_dir):
    from lectern.operators import validate
    from lectern.plans import queries

    bills = queries.bills(spark, sf_dir)
    plan = validate.check(bills, "invoice", enabled=("arithmetic",))._jdf.queryExecution().analyzed().toString()
    assert "[,$]" not in plan and plan.count("unit_price") < 8
    # The same findings from texts as from numbers.
    texts = bills.withColumn("line_items", F.transform("line_items", lambda r: F.struct(*(r[c].cast("string").alias(c) for c in ("quantity", "unit_price", "amount"))))).withColumns({c: F.col(c).cast("string") for c in ("subtotal", "tax", "total")})
    rows = [sorted(map(tuple, validate.findings(validate.check(b, "invoice"), "k").collect())) for b in (bills, texts)]
    assert rows[0] == rows[1] and len(rows[0]) > 100


def test_nearest_of_all_rows_ties_and_many_near(spark):
    """Scores that single precision can't tell apart, hundreds of equal vectors, and as many tasks as a small table allows."""
    import numpy as np

    from lectern.operators import geometry

    pick = np.random.default_rng(5)
    base = pick.normal(size=(40, 64))
    v = np.concatenate([base[i % 40] + pick.normal(size=64) * 10.0 ** -(2 + i % 6) for i in range(400)] + [base[0]] * 150).reshape(-1, 64)
    rows = [(int(k), x.tolist(), int(k) % 7) for k, x in zip(pick.permutation(len(v)), v, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, geometry.nearest_of_all(df, "vec_id", "embedding", "label").collect()))
    v = np.asarray([r[1] for r in sorted(rows)])
    v /= np.linalg.norm(v, axis=1)[:, None]
    score = np.round(v @ v.T, 6)
    np.fill_diagonal(score, -2)
    assert got == [(k, k % 7, int(j), int(j) % 7) for k, j in enumerate(score.argmax(axis=1))]
    assert sorted(map(tuple, geometry.nearest_of_all(df, "vec_id", "embedding", "label", 64, 16).collect())) == got
    assert len({r.b for r in geometry._blocked(df, "vec_id", "embedding", "label", 4096).select(F.spark_partition_id().alias("b")).collect()}) > 1


def test_kinds_are_counted_before_they_are_rows(spark, sf_dir, tmp_path):
    from lectern.plans import queries

    plan = queries.compare_kinds(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")
    # As the SQL: a row for each kind where there are no orders.
    spark.read.parquet(f"{sf_dir}/orders.parquet").limit(0).write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, queries.compare_kinds(spark, str(tmp_path)).collect())) == [(k, 0, 0, 0) for k in ("date", "identifier", "money")]
