"""Each stage on awkward rows: nulls, empty and long texts, repeats, an empty table, columns of clashing names."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

CLASH = ["predicted", "score", "n_removed", "rest", "row", "own", "mix_position", "component_id", "c0", "file"]


@pytest.fixture(scope="module")
def awkward(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    base = docs.first().asDict()
    odd = [base | {"doc_id": i, "text": t, "source": s} for i, t, s in ((90001, None, None), (90002, "", "x"), (90003, "word " * 60_000, "x"), (None, base["text"], None), (None, None, None), (base["doc_id"], base["text"], base["source"]))]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).select("*", *(F.lit(f"_{c}").alias(c) for c in CLASH), F.lit(1).alias("an odd: `name`")).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, sf_dir, awkward, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, awkward, sf_dir)
    rows, given = out.collect(), awkward.collect()
    ids = collections.Counter(r.doc_id for r in given)
    assert {r.doc_id for r in rows} <= set(ids)
    if name == "sentencepiece":
        assert collections.Counter(r.doc_id for r in rows) == ids and all(r.n_tokens == len(r.ids) for r in rows)
    else:
        assert out.columns == awkward.columns and [f.dataType for f in out.schema] == [f.dataType for f in awkward.schema]
        assert all(r[c] == f"_{c}" for r in rows for c in CLASH)
    if name == "repeated_passages":
        assert collections.Counter(r.doc_id for r in rows) == ids
        assert {r.doc_id: r.text for r in rows}[90001] is None
    if name == "mixing":
        assert set(ids) == {r.doc_id for r in rows}
    if name == "quality":
        kept = {(r.doc_id, r.text) for r in given}
        assert all((r.doc_id, r.text) in kept for r in rows)
    empty = stage(spark, awkward.limit(0), sf_dir)
    assert empty.columns == out.columns and empty.count() == 0


def test_output_is_the_mixture_in_order(spark, sf_dir):
    from lectern.llm import mixing, spm
    from lectern.llm._common import durable

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = durable(corpus_pipeline.mix_sources(spark, docs, sf_dir), spark)
    out = sorted(corpus_pipeline.tokenize(spark, mixed, sf_dir).collect(), key=lambda r: (r.file, r.row))
    want = sorted(mixing.mix(docs).collect(), key=lambda r: r.mix_position)
    assert [(r.doc_id, r.text) for r in out] == [(r.doc_id, r.text) for r in want]
    model = spm.encoder(spm.default_model())
    assert all(model.decode(r.ids) == (r.text or "") for r in out[:200])
