"""Operator 3 and the order of the mixture."""

import collections

from pyspark.sql import functions as F

from lectern.llm import mixing


def brute(rows, block, weights=None):
    """Positions of sources, slot by slot: of the released blocks the one with the earliest deadline, by a plain search."""
    from fractions import Fraction
    from math import ceil, floor

    n = collections.Counter(s for _, s in rows)
    share = mixing.exact({s: (weights or {}).get(s, 0) for s in n} if weights else mixing.flattened(n))
    names, total = list(share), sum(share.values())
    need = {s: -(-n[s] // block) for s in names}
    done, out = dict.fromkeys(names, 0), []
    while any(done[s] < need[s] for s in names):
        t = len(out)
        ready = [(ceil(Fraction((done[s] + 1) * total, share[s])), i, s) for i, s in enumerate(names) if floor(Fraction(done[s] * total, share[s])) <= t]
        due, _, s = min(ready)
        assert due > t
        out.append((s, done[s]))
        done[s] += 1
    return out


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()]
    got = sorted((r.mix_position, r.source, r.mix_block, r.mix_epoch, r.doc_id) for r in mixing.query(spark, sf_dir).collect())
    assert [g[0] for g in got] == list(range(len(got)))
    want = [(s, k) for s, k in brute(rows, mixing.BLOCK) for _ in range(mixing.BLOCK)]
    assert [(g[1], g[2]) for g in got] == want
    # Each epoch of a source but the last one holds each of its rows once.
    per = collections.defaultdict(list)
    for _, s, _, e, d in got:
        per[s, e].append(d)
    own = collections.defaultdict(set)
    for d, s in rows:
        own[s].add(d)
    for (s, e), ids in per.items():
        assert len(ids) == len(set(ids)) and (set(ids) == own[s] or (s, e + 1) not in per)


def test_repeated_rows_and_tiny_sources(spark, monkeypatch):
    """Null keys that a third of all rows share, repeated rows, a source of one row beside a large one."""
    monkeypatch.setattr(mixing, "RANK_ROWS", 16)
    monkeypatch.setattr(mixing, "COPIES", 8)
    rows = [(None, "a")] * 300 + [(7, "a")] * 100 + [(i, "a") for i in range(500)] + [(1, "b"), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").repartition(7)
    for hot in (mixing.HOT, 0):
        monkeypatch.setattr(mixing, "HOT", hot)
        got = mixing.mix(df, {"a": 1, "b": 1, None: 1}, block=4).collect()
        assert sorted(r.mix_position for r in got) == list(range(len(got)))
        first = collections.Counter((r.doc_id, r.source) for r in got if r.mix_epoch == 0)
        assert first == collections.Counter(rows)
        assert [s for _, s in sorted((r.mix_slot, r.source or "") for r in got)] == [s or "" for s, _ in brute(rows, 4, {"a": 1, "b": 1, None: 1}) for _ in range(4)]


def test_long_periods_are_bounded(monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 1000)
    counts = {"a": 64 * 100_000, "b": 64 * 1_000_003, "c": 5}
    slots, table, last = mixing._plan(counts, None, 64, None)
    assert len(slots[0]) <= 1000 and sum(t[3] for t in table) == 1000 and all(t[6] >= t[2] for t in table) and last > 1_100_000
    exact = mixing.exact(mixing.flattened(counts))
    assert all(abs(t[3] / 1000 - exact[t[1]] / sum(exact.values())) <= 0.002 for t in table)
    slots, _, _ = mixing._plan({"a": 6400, "b": 640}, None, 64, None)
    assert len(slots[0]) < 1000


def test_rows_read_by_file_are_in_order(spark, tmp_path):
    """With coalescing off: file by file, row by row, the schedule; columns of the results' names stay as they were."""
    rows = [(i, s, f"p{i}") for s, n in (("a", 900), ("b", 120), (None, 33)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, mix_position string")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixing.ordered(df, block=8).write.parquet(str(tmp_path / "o"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    back = spark.read.parquet(str(tmp_path / "o")).select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    got = [(r.doc_id, r.source, r.mix_position) for r in sorted(back, key=lambda r: (r.f, r.i))]
    want = [(r.doc_id, r.source) for r in sorted(mixing.mix(df, block=8).collect(), key=lambda r: r.mix_position)]
    assert len({r.f for r in back}) == 8 and len(got) == len(want)
    assert [g[:2] for g in got] == want and all(p == f"p{i}" for i, _, p in got)
    assert mixing.ordered(df.limit(0)).count() == 0
