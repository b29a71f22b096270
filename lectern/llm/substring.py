"""Operator 9: substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one text.  Consecutive windows whose
least hash of `gram` words (the minimiser) is the same travel as one packed
string to the bucket of that minimiser; equal windows have equal minimisers, so
sorting a bucket's windows counts them exactly over the whole input.

Hot minimisers (a first pass sums their loads) would fill one bucket.  Their
windows travel alone, by their own fingerprint: windows that differ spread
out, and equal ones are merged in each task before the shuffle, as are equal
super-k-mers.  Windows are told apart by 128 bits of hash over whole words.

A word is removed if any window that covers it occurs anywhere else.  Rows are
known by (doc_id, hash of the text): repeated rows count as occurrences and get
the same result.  Null or empty text has no words; texts shorter than a window
keep everything; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import arrow, durable, nullable, partitions, schema, tidied, tidy
from ._pack import gather, groups, pack, runs, unpack
from ._text import buffers, chunks, mix, words

WINDOW = 35
GRAM = 4
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2^64 and of its inverse."""
    if which not in _powers or len(_powers[which][0]) < n:
        base = int(_BASES[which])
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[which] = (both[0], both[1])
    up, down = _powers[which]
    return up[:n], down[:n]


def span_hashes(h: np.ndarray, starts: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the word hashes in each span."""
    out = []
    for which in (0, 1):
        up, down = _power(which, len(h) + 1)
        x = mix(h + _BASES[which])
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(x * up[:-1], out=total[1:])
        out.append(mix((total[starts + length] - total[starts]) * down[starts]))
    return out[0], out[1]


def superkmers(h: np.ndarray, per_doc: np.ndarray, window: int, gram: int):
    """(first window's word, number of windows, minimiser) of each run of windows with one minimiser."""
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64)
    least = h[: len(h) - gram + 1].copy()
    for j in range(1, gram):
        least = mix(least * _BASES[0] + h[j : len(h) - gram + 1 + j])
    width, have = window - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    inside = np.arange(n) <= np.repeat(per_doc[1:] - window, np.diff(per_doc))[:n]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, np.zeros(0, np.uint64)
    low = least[at]
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) != 1) | (low[1:] != low[:-1])
    first = np.flatnonzero(cut)
    return at[first], np.diff(first, append=len(at)), low[first]


def _fine(minimiser: np.ndarray, bits: int) -> np.ndarray:
    return (mix(minimiser) >> np.uint64(64 - bits)).astype(np.int64)


def ranges(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, first, last): words first..last-1 of the row (doc_id, xxhash64(text)) are covered by repeated windows.

    df has the columns doc_id (bigint) and text.
    """
    spark = df.sparkSession
    arrow(spark)
    rows = df.select(df["doc_id"], F.xxhash64(df["text"]).alias("h"), df["text"])
    buckets = 4 * partitions(spark)
    bits = max(16, int(np.ceil(np.log2(buckets))) + 6)

    def load(batches):
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            data, off = buffers(b.column(2))
            for lo, hi in chunks(off):
                w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                _, n, low = superkmers(w.hashes(), w.per_doc, window, gram)
                total += np.bincount(_fine(low, bits), n + window - 1, 1 << bits).astype(np.int64)
        # Loads far above this task's mean can be hot; the rest only counts in the sum.
        at = np.flatnonzero(total > 8 * total.mean() + 8 * window)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], total.sum()), pa.int64())], ["fine", "n"])

    loads = durable(rows.mapInArrow(tidy(load), "fine bigint, n bigint").groupBy("fine").agg(F.sum("n").alias("n")), spark, few=True)
    whole = (loads.where("fine = -1").first() or {"n": 0})["n"]
    # At most `buckets` of them can each have more than a bucket's mean share.
    hot = np.array(sorted(r["fine"] for r in loads.where((F.col("fine") >= 0) & (F.col("n") > whole / buckets)).collect()), np.int64)

    def send(batches):
        for k, table in enumerate(gather(batches)):
            data, off = buffers(table.column(2))
            ids = table.column(0).combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            keys = table.column(1).to_numpy()
            for lo, hi in chunks(off, 8 << 20):
                yield from _send(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ids[lo:hi], known[lo:hi], keys[lo:hi], k)

    def _send(data, off, ids, known, keys, k):
        w = words(data, off)
        h = w.hashes()
        start, n, low = superkmers(h, w.per_doc, window, gram)
        if not len(start):
            return
        fine = _fine(low, bits)
        doc = np.searchsorted(w.per_doc, start, side="right") - 1
        place = start - w.per_doc[doc]
        is_hot = np.isin(fine, hot)
        done = []  # (text, first, last) known to be repeated within this chunk
        out = {}

        # Whole super-k-mers, equal ones once.
        at = np.flatnonzero(~is_hot)
        a, b = span_hashes(h, start[at], n[at] + window - 1)
        keep, twice, more = _merge(a ^ mix(n[at].astype(np.uint64)), b)
        done.append((doc[at[more]], place[at[more]], place[at[more]] + n[at[more]] + window - 1))
        at, twice = at[keep], twice
        order, cut = groups(fine[at] % buckets, buckets)
        view = memoryview(np.ascontiguousarray(data))
        begin, end = w.starts[start], w.ends[start + n + window - 2]
        for bucket in np.flatnonzero(np.diff(cut)):
            own = at[order[cut[bucket] : cut[bucket + 1]]]
            text = b"".join([view[x:y] for x, y in zip(begin[own].tolist(), end[own].tolist(), strict=True)])
            texts, which = np.unique(doc[own], return_inverse=True)
            out[int(bucket)] = [text, (end[own] - begin[own]).astype(np.int32), twice[order[cut[bucket] : cut[bucket + 1]]], which.astype(np.int32), place[own].astype(np.int32), texts]

        # Windows of hot minimisers, alone.
        alone = {}
        at = np.flatnonzero(is_hot)
        if len(at):
            one = np.repeat(start[at], n[at]) + (np.arange(n[at].sum()) - np.repeat(np.cumsum(n[at]) - n[at], n[at]))
            owner = np.repeat(doc[at], n[at])
            a, b = span_hashes(h, one, window)
            keep, twice, more = _merge(a, b)
            done.append((owner[more], one[more] - w.per_doc[owner[more]], one[more] - w.per_doc[owner[more]] + window))
            order, cut = groups((a[keep] % np.uint64(buckets)).astype(np.int64), buckets)
            for bucket in np.flatnonzero(np.diff(cut)):
                own = keep[order[cut[bucket] : cut[bucket + 1]]]
                texts, which = np.unique(owner[own], return_inverse=True)
                alone[int(bucket)] = [a[own], b[own], twice[order[cut[bucket] : cut[bucket + 1]]], which.astype(np.int32), (one[own] - w.per_doc[owner[own]]).astype(np.int32), texts]

        found = [np.concatenate(x) for x in zip(*done, strict=True)]
        spread = int(keys[0]) % buckets
        blobs = []
        names = lambda texts: (ids[texts], known[texts], keys[texts])
        for bucket in {*out, *alone, *([spread] if len(found[0]) else [])}:
            packed, single, ready = out.get(bucket), alone.get(bucket), None
            if packed:
                packed[5] = names(packed[5])
            if single:
                single[5] = names(single[5])
            if bucket == spread and len(found[0]):
                texts, which = np.unique(found[0], return_inverse=True)
                ready = (which.astype(np.int32), found[1].astype(np.int32), found[2].astype(np.int32), names(texts))
            blobs.append((bucket, pack(packed, single, ready, level=6)))  # mostly text
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in blobs], pa.int32()), pa.array([x[1] for x in blobs], pa.binary())], ["bucket", "blob"])

    def count(table):
        ids, known, keys, base = [], [], [], 0
        a, b, twice, owner, place = [], [], [], [], []
        ready = []
        for blob in table.column("blob"):
            packed, single, own = unpack(blob.as_py())
            for part in (packed, single, own):
                if part is None:
                    continue
                i, kn, ke = part[-1]
                ids.append(i)
                known.append(kn)
                keys.append(ke)
                if part is own:
                    ready.append((part[0] + base, part[1], part[2]))
                elif part is single:
                    a.append(part[0])
                    b.append(part[1])
                    twice.append(part[2])
                    owner.append(part[3] + base)
                    place.append(part[4])
                else:
                    text, size, two, which, first, _ = part
                    off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                    w = words(np.frombuffer(text, np.uint8), off)
                    n = w.counts - window + 1
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    x, y = span_hashes(w.hashes(), np.repeat(w.per_doc[:-1], n) + step, window)
                    a.append(x)
                    b.append(y)
                    twice.append(np.repeat(two, n))
                    owner.append(np.repeat(which + base, n))
                    place.append(np.repeat(first, n) + step)
                base += len(i)
        ids, known, keys = (np.concatenate(x) for x in (ids, known, keys))
        out = [(np.concatenate([r[0] for r in ready]), np.concatenate([r[1] for r in ready]), np.concatenate([r[2] for r in ready]))] if ready else []
        if a:
            a, b, twice, owner, place = (np.concatenate(x) for x in (a, b, twice, owner, place))
            order = np.lexsort((b, a))
            cut = runs(a[order], b[order])
            size = np.diff(cut, append=len(a))
            hit = order[np.repeat((size > 1) | np.maximum.reduceat(twice[order], cut), size)]
            out.append((owner[hit], place[hit], place[hit] + window))
        if not out:
            return _ranges(*(np.zeros(0, np.int64),) * 3, ids, known, keys)
        return _ranges(*(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)), ids, known, keys)

    return rows.mapInArrow(tidy(send), "bucket int, blob binary").groupBy("bucket").applyInArrow(lambda table: tidied(count(table)), "doc_id bigint, h bigint, first int, last int")


def _merge(a: np.ndarray, b: np.ndarray):
    """(firsts of equal pairs, whether each was met again, all members of repeated ones)."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.lexsort((b, a))
    cut = runs(a[order], b[order])
    size = np.diff(cut, append=len(a))
    return order[cut], size > 1, order[np.repeat(size > 1, size)]


def _ranges(owner, first, last, ids, known, keys) -> pa.Table:
    """Overlapping ranges of a row joined."""
    order = np.lexsort((first, owner))
    owner, first, last = owner[order], first[order], last[order]
    if len(owner):
        new = np.ones(len(owner), bool)
        # The furthest end so far within the row: rows are set apart by an offset above any end.
        apart = owner * (int(last.max()) + 1)
        reach = np.maximum.accumulate(last + apart)
        new[1:] = (owner[1:] != owner[:-1]) | (first[1:] + apart[1:] > reach[:-1])
        at = np.flatnonzero(new)
        last = np.maximum.reduceat(last, at)
        owner, first = owner[at], first[at]
    return pa.table({
        "doc_id": pa.array(ids[owner], pa.int64(), mask=~known[owner]), "h": pa.array(keys[owner], pa.int64()),
        "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32()),
    })


def _with_ranges(df: DataFrame, window: int, gram: int, keep: list[str]) -> DataFrame:
    found = ranges(df.select("doc_id", "text"), window, gram)
    found = found.groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).agg(F.collect_set(F.struct("first", "last")).alias("covered"))
    rows = df.select(F.struct(*[df[c] for c in keep]).alias("own"), df["doc_id"].alias("d1"), F.xxhash64(df["text"]).alias("h1"), df["text"].alias("t1"))
    both = rows.join(found, (F.col("h1") == F.col("h2")) & F.col("d1").eqNullSafe(F.col("d2")), "left")
    return both.select("own", F.col("t1").alias("text"), "covered")


def _kept(data: np.ndarray, off: np.ndarray, covered: pa.Array):
    """(words, removed words, bytes of the kept words joined by spaces, their offsets) of each text."""
    w = words(data, off)
    n = len(off) - 1
    lists = covered.fill_null([]) if covered.null_count else covered
    flat = lists.flatten()
    first = flat.field("first").to_numpy().astype(np.int64)
    last = flat.field("last").to_numpy().astype(np.int64)
    base = np.repeat(w.per_doc[:-1], pa.compute.list_value_length(lists).to_numpy())
    size = len(w)
    move = np.bincount(base + first, minlength=size + 1)[: size + 1] - np.bincount(base + last, minlength=size + 1)[: size + 1]
    gone = np.cumsum(move)[:size] > 0
    text = np.repeat(np.arange(n), w.counts)
    removed = np.bincount(text[gone], minlength=n)
    starts, ends, text = w.starts[~gone], w.ends[~gone], text[~gone]
    # Each kept word and one space, then without the last space of each text.
    length = ends - starts + 1
    out_at = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(starts - out_at[:-1], length) + np.arange(out_at[-1])
    body = np.append(data, np.uint8(32))[np.minimum(take, len(data))]
    body[out_at[1:] - 1] = 32
    lo = out_at[np.searchsorted(text, np.arange(n))]
    hi = out_at[np.searchsorted(text, np.arange(n), side="right")]
    return w.counts, removed, body, lo, np.maximum(hi - 1, lo)


def remove(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """df with its repeated passages removed from text: a text that loses words
    becomes its kept words joined by spaces, another stays as it is; n_removed is added."""
    own = [c for c in df.columns if c != "n_removed"]
    joined = _with_ranges(df, window, gram, own)
    plain = to_arrow_type(nullable(joined.schema["own"].dataType))

    def run(batches):
        for b in batches:
            held = b.column(0).cast(plain)
            data, off = buffers(b.column(1))
            for lo, hi in chunks(off):
                _, removed, body, x, y = _kept(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], b.column(2)[lo:hi])
                new = [body[i:j].tobytes().decode() if r else None for r, i, j in zip(removed, x.tolist(), y.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([held[lo:hi], pa.array(new, pa.string()), pa.array(removed, pa.int64())], ["own", "new", "n_removed"])

    out = joined.mapInArrow(tidy(run), schema(joined, ["own"], "new string, n_removed bigint"))
    pick = {c: F.col("own")[c] for c in own} | {"text": F.when(F.col("n_removed") > 0, F.col("new")).otherwise(F.col("own")["text"])}
    return out.select(*[pick[c].alias(c) for c in own], "n_removed")


def digest(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of (doc_id, text)."""
    joined = _with_ranges(df, window, gram, ["doc_id"])

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            for lo, hi in chunks(off):
                n, removed, body, x, y = _kept(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], b.column(2)[lo:hi])
                sha = [hashlib.sha256(body[i:j]).hexdigest() for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).field("doc_id")[lo:hi], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
