"""Operator 5 by brute force, for several orders, with small blocks and pieces."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import _pack, lm


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, train, order, mu):
    """(n_tokens, n_known, train_tokens, base_score, score) of each text by the recursive formula."""
    count = [collections.Counter() for _ in range(order + 1)]
    for i, t in rows:
        if train(i):
            s = ["<s>", *split(t), "</s>"]
            for k in range(1, order + 1):
                count[k].update(tuple(s[j : j + k]) for j in range(len(s) - k + 1))
    starts = count[1].pop(("<s>",), 0)
    n, v = sum(count[1].values()), len(count[1])
    count[1][("<s>",)] = starts

    def p(h, w):
        if not h:
            return ((count[1][(w,)] if w != "<s>" else 0) + 0.1) / (n + 0.1 * (v + 1))
        c = count[len(h)][h]
        if not c or (len(h) > 1 and c < lm.LEAST):
            return p(h[1:], w)
        m = mu[min(len(h), len(mu)) - 1]
        return (count[len(h) + 1][*h, w] + m * p(h[1:], w)) / (c + m)

    out = []
    for i, t in rows:
        s = ["<s>", *split(t), "</s>"]
        said = s[1:]
        score = sum(np.log10(p(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s)))
        out.append((i, len(said), sum(count[1][(w,)] > 0 for w in said), n, sum(np.log10(p((), w)) for w in said), score))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    some = lambda n: " ".join(r.choice("a b c d e É ff Gg hh".split()) for _ in range(n))
    made = [(i, some(r.randint(0, 40))) for i in range(80)] + [(100, None), (101, ""), (102, some(900)), (103, "never seen words only"), (None, "a b c"), (None, None), (3, "a a a"), (3, "a a a")]
    return made


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_brute_force(spark, monkeypatch, rows, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lm, "PART_BYTES", 150)
    monkeypatch.setattr(lm, "PIECE", 7)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, `own n` string").repartition(3)
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    got = lm.score(df, lm.remainder(F.col("doc_id"), 10) != 0, order, (8.0, 2.0), keep=("own n",)).collect()
    assert {r["own n"] for r in got} == {"x"}
    key = lambda x: (x[0] is None, x[0], x[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(brute(rows, train, order, (8.0, 2.0)), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [x for g in got for x in g[4:]] == pytest.approx([x for w in want for x in w[4:]])


def test_nothing_to_learn_from(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lm.score(df, F.lit(None).cast("boolean")).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.score == pytest.approx(r.base_score) for r in got) and len(got) == len(rows)
    assert lm.score(df.limit(0), F.lit(True)).count() == 0


def test_longer_histories_help_on_held_out_texts(spark, sf_dir):
    out = lm.query(spark, sf_dir).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert out.s > out.b


def test_deltas_come_back():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 1000, dtype=np.uint64))
    for some in (x, x[:0], x[:1], np.array([0, (1 << 64) - 1], np.uint64)):
        assert np.array_equal(_pack.from_deltas(_pack.deltas(some)), some)
