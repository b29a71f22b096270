import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, jaccard, langid, lm, media, mixing, neardup, quality, spm, substring
from lectern.llm import queries as registered

DOCS = "doc_id bigint, text string, label string, h string, own string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows, columns with awkward names."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), text(200)
    rows = [text(r.randint(1, 120)) for _ in range(60)]
    rows += [text(20) + "\n" + passage + "  " + text(15) for _ in range(12)]
    rows += [base] * 8 + [" ".join(w if r.random() > 0.01 else word() for w in base.split()) for _ in range(25)]
    rows += [None, "", " \t\n", "one", "One two", "ONE two", text(6000), "x" * 5000, "Ünïcode  straße 中文 😀 " * 3, passage + " " + passage]
    made = [(i, t, "l", "h", "o") for i, t in enumerate(rows)] + [(3, rows[3], "l", "h", "o"), (None, "no id here at all", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(made, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def components(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(docs, k, num):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    root = components(rows, pairs)
    least = {}
    for r, c in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, 1 << 60), r.doc_id)
    links = collections.Counter(x for p in pairs for x in p)
    want = sorted(((r.doc_id, len(s), links[i], least.get(root[i])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)
    got = jaccard.join(docs, k, num, 100)
    assert sorted(((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in got.collect()), key=repr) == want


def test_jaccard_blocks_agree(docs, monkeypatch, spark):
    whole = sorted(map(tuple, jaccard.join(docs, 3, 90, 100).collect()), key=repr)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    assert sorted(map(tuple, jaccard.join(docs, 3, 90, 100).collect()), key=repr) == whole


@pytest.mark.parametrize("window", [5, 35])
def test_substring_equals_brute_force(docs, window):
    rows = docs.collect()
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()) for r in rows]
    count = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    want = []
    for r, w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        want.append((r.doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in substring.digest(docs, window).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_substring_keeps_other_columns(docs):
    out = substring.remove(docs)
    assert out.columns == [*docs.columns, "n_removed"] and out.count() == docs.count()
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert all((r.doc_id, r.text) in kept for r in out.where("n_removed = 0").collect())


def test_sentencepiece_equals_library(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    want = sorted(((r.doc_id, len(i := lib.encode(r.text or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((lib.decode(i) if i else "").encode()).hexdigest()) for r in docs.collect()), key=repr)
    assert sorted((tuple(r)[:4] for r in spm.digest(docs).collect()), key=repr) == want


def test_sentencepiece_spans(docs):
    rows = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    model = spm.encoder(spm.default_model())
    out = spm.encode(docs.where("doc_id is not null"))
    for r in out.collect():
        data, at = rows[r.doc_id].encode(), 0
        for i, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            assert at == a <= b
            piece = model.pieces[i].replace(spm.SPACE, " ").encode()
            if i not in model.byte:
                assert data[a:b] in (piece, piece[1:])
            at = b
        assert at == len(data)
    back = {r.doc_id: r.text for r in spm.decode(out).collect()}
    assert back == rows


def test_sentencepiece_query_has_the_spans_of_every_document(spark, sf_dir):
    """Spans by characters of the text, found without the alignment."""
    model = spm.encoder(spm.default_model())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registered.queries()["op7_sentencepiece"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)

    def slow(text):
        # The first byte of the character at or before each byte of the normalised text.
        source = [0] * (3 * model.prefix if text else 0)
        at = 0
        for c in text:
            source += [at] * (3 if c == " " else len(c.encode()))
            at += len(c.encode())
        source.append(at)
        place, out = 0, []
        for i in model.encode(text):
            n = 1 if i in model.byte else len(model.pieces[i].encode())
            out.append((source[place], source[place + n]))
            place += n
        return hashlib.sha256(b"".join(struct.pack(f"<{len(out)}q", *(x[j] for x in out)) for j in (0, 1))).hexdigest()

    assert all(r.spans_sha256 == slow(texts[r.doc_id]) for r in rows)
    for text in ("", " ", "a  b ", " ä▁ 中文 😀\n", "\t x"):
        (a, x), (b, y) = model._aligned(text), model._walk(text)
        assert a == b and x.tolist() == y.tolist()


def test_character_map_takes_the_longest_prefix():
    """A trie of two keys, built by hand: `a` to `1`, `ab` to `2`."""
    units = np.zeros(512, np.uint32)
    label = lambda c, offset, leaf=False: c | (int(leaf) << 8) | (offset << 10)
    units[0] = label(0, 1)
    a = 1 ^ ord("a")
    units[a] = label(ord("a"), 200 ^ a, leaf=True)
    units[200] = 0x80000000 | 0
    ab = 200 ^ ord("b")
    units[ab] = label(ord("b"), 300 ^ ab, leaf=True)
    units[300] = 0x80000000 | 2
    m = spm.CharacterMap(struct.pack("<I", units.nbytes) + units.tobytes() + b"1\x002\x00")
    assert [m.longest(x, 0) for x in (b"abc", b"ac", b"c")] == [(2, 2), (1, 0), (0, -1)]
    assert m.replacement(2) == b"2"


def vectors(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 16))
    rows, k = [], 0
    for i in range(220):
        v = base[i % 12] + r.normal(size=16) * r.choice([0, 0.03, 0.08])
        rows.append((k, [float(np.float32(x)) for x in v], int(r.integers(0, 3))))
        k += 1
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [1e200] * 16, 2), (3, rows[3][1], rows[3][2])]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


@pytest.mark.parametrize("block", [4, 1024])
def test_near_dup_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    df = vectors(spark)
    rows = df.collect()
    good = lambda r: r.embedding is not None and r.label is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)
    cos = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.98
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if good(rows[i]) and good(rows[j]) and rows[i].label == rows[j].label and cos(np.array(rows[i].embedding), np.array(rows[j].embedding))]
    root, links = components(rows, pairs), collections.Counter(x for p in pairs for x in p)
    least = {}
    for r, c in zip(rows, root, strict=True):
        least[c] = min(least.get(c, 1 << 60), r.vec_id)
    want = sorted((r.vec_id, links[i], least[root[i]], r.vec_id == least[root[i]]) for i, r in enumerate(rows))
    assert len(pairs) > 100
    assert sorted(tuple(r) for r in neardup.link(df).collect()) == want


def test_multi_sequence_order():
    a, b = np.array([0.3, 0.1, 0.9]), np.array([0.2, 0.0])
    got = list(neardup.multi_sequence(a, b))
    assert [round(x[2], 6) for x in got] == sorted(round(x + y, 6) for x in a for y in b) and len({x[:2] for x in got}) == 6


def test_language_codes_and_accuracy(spark):
    for n in (2, 3, 4, 7, 20):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n
    r = random.Random(2)
    parts = {"aa": "lo mi sa tu", "bb": "krz szt prz wn", "cc": "the ing ion and"}
    rows = [(i, " ".join("".join(r.choice(parts[k].split()) for _ in range(3)) for _ in range(r.randint(5, 30))), k) for i in range(300) for k in [r.choice(list(parts))]]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "aa"), (902, "123 !!", None)], "doc_id bigint, text string, lang string")
    model = langid.train(df.where("doc_id % 3 <> 0"), per_language=80)
    out = {x.doc_id: x for x in langid.predict(df, model).collect()}
    assert np.mean([out[i].lang_pred == k for i, _, k in rows if i % 3 == 0]) > 0.97
    assert all(0 <= x.score <= 1 for x in out.values()) and [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3


def test_language_without_labels(docs):
    model = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}


def test_quality_rules(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        bad = r.random() < 0.3
        rows.append((i, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + ("$$$" if bad else "") for _ in range(40)), int(not bad)))
    docs = spark.createDataFrame([x[:2] for x in rows] + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    out = {x.doc_id: x for x in quality.score(docs, model).collect()}
    assert model.rules and np.mean([out[i].predicted == q for i, _, q in rows]) > 0.97
    assert out[900].score == out[901].score and all(0 <= x.score <= 1 for x in out.values())
    assert quality.score(docs, quality.train(docs, labels.limit(0))).where("score = 0.5").count() == docs.count()


def test_statistics_do_not_depend_on_the_batch():
    texts = ["a b c", "", "XX yy!! 12\nzz", "é " * 40]
    whole = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    alone = [quality.statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts]
    assert np.array_equal(quality.statistics(whole, off), np.stack(alone))


def test_media_round_trip(docs, spark):
    for r in media.digest(docs).collect():
        assert r.payload_bytes >= 576 and r.payload_bytes % 576 == 0
    rows = {x.doc_id: x.text for x in docs.collect()}
    for r in media.store(docs.where("doc_id is not null"), "adpcm").collect():
        assert bytes(media.parts(bytes(r.media))[3]) == media.pad((rows[r.doc_id] or "").encode())
    files = spark.createDataFrame([(1, media.wav(b"\xff\x00\x80", "mulaw")), (2, b"junk"), (3, None), (4, media.wav(b"", "alaw"))], "doc_id bigint, media binary")
    got = {r.doc_id: (r.codec, r.samples) for r in media.decode(files).collect()}
    assert got == {1: ("mulaw", 3), 2: (None, None), 3: (None, None), 4: ("alaw", 0)}


def test_codec_tables():
    assert media.mulaw_table()[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert media.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    block = np.zeros((3, 8), np.uint8)
    block[:, 4:] = [[0x07, 0, 0, 0], [0x70, 0, 0, 0], [0x8F, 0, 0, 0]]

    def slow(b):
        s, i, out = struct.unpack("<h", bytes(b[:2]))[0], int(b[2]), []
        out.append(s)
        for byte in b[4:]:
            for n in (byte & 15, byte >> 4):
                step = int(media.step_table()[i])
                d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
                s = max(-32768, min(32767, s - d if n & 8 else s + d))
                i = max(0, min(88, i + (-1 if n & 7 < 4 else 2 * ((n & 7) - 3))))
                out.append(s)
        return out

    assert media.adpcm(block).tolist() == [slow(b.tolist()) for b in block]


def test_mixing(docs, spark):
    rows = spark.createDataFrame([(i, s, "x") for s, n in (("a", 700), ("b", 90), (None, 33), ("c", 1)) for i in range(n)], "doc_id bigint, source string, mix_slot string")
    out = mixing.mix(rows, {"a": 5, "b": 3, None: 1}, block=8, period=50)
    got = out.collect()
    assert len({r.mix_position for r in got}) == len(got) == max(r.mix_position for r in got) + 1
    assert {(r.doc_id, r.source) for r in got} == {(r.doc_id, r.source) for r in rows.collect()}
    share = mixing.shares({"a": 5, "b": 3, None: 1, "c": 0}, 50)
    for done in range(1, 51):
        seen = collections.Counter(s for s, _ in mixing.schedule(share)[:done])
        assert all(abs(seen[s] - done * q / 50) < 1 for s, q in share.items())
    assert mixing.mix(rows.limit(0)).count() == 0


def off(slots, weights):
    """The largest distance of a source from its target, in blocks, after any number of slots."""
    total, seen, most = sum(weights.values()), collections.Counter(), 0
    for done, s in enumerate(slots, 1):
        seen[s] += 1
        most = max(most, *(abs(seen[x] - done * w / total) for x, w in weights.items()))
    return most


def test_mixing_keeps_to_the_weights_given(spark):
    """Many sources and uneven weights, none of them whole shares of some period; one source has none."""
    sizes = {f"s{i}": 7 + i % 5 for i in range(60)} | {"big": 900, "none": 20}
    weights = mixing.flattened({s: n for s, n in sizes.items() if s != "none"})
    rows = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id bigint, source string")
    got = mixing.mix(rows, weights | {"none": 0}, block=2).collect()
    slots = dict(sorted({(r.mix_slot, r.source) for r in got}))
    assert list(slots) == list(range(len(slots))) and len(got) == 2 * len(slots)
    assert {(r.doc_id, r.source) for r in got} == {(r.doc_id, r.source) for r in rows.collect()}
    inside = [s for s in slots.values() if s != "none"]
    assert list(slots.values())[-10:] == ["none"] * 10 and "none" not in inside and len(inside) == len(slots) - 10
    assert off(inside, weights) < 1
    # More sources than slots of the old period: shares are not all the same.
    weights = {f"s{i}": 1 + i % 3 for i in range(1200)}
    share = mixing.exact(weights)
    assert share == weights and off([s for s, _ in mixing.schedule(share)[:500]], weights) < 1
    assert mixing.exact({"a": 0.5, "b": 0.25, "c": 0, "d": None}) == {"a": 2, "b": 1} and mixing.exact({"a": 0}) == {"a": 1}


def test_chat_folds_events(spark):
    e = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", "assistant", "llo"), (1, 4, 2, "message", "user", "<|im_end|>"),
         (1, 5, 1, "regenerate", "assistant", "new"), (1, 6, 1, "delta", "assistant", "er"), (1, 7, 0, "edit", "user", "hey"), (2, 1, 0, None, None, None)]
    df = spark.createDataFrame(e, "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [(1, 0, "user", "hey"), (1, 1, "assistant", "newer"), (2, 0, "", "")]
    assert chat.fold(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<\\\\|", "a\nb\n", "<|<|", "\\<|"])
def test_chat_escape_is_reversible(spark, text):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    out = chat.render(df)
    row = out.select(chat.parse(F.col("formatted")).alias("t"), "formatted", "mask").first()
    assert [(m.role, m.text) for m in row.t] == [("user", "q"), ("assistant", text)]
    assert row.formatted.count(chat.END) == 2 and row.formatted.count(chat.START) == 2
    assert chat.digest(out).first().loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    from oracle import same

    same(registered.queries()[name](spark, sf_dir), duck, registered.oracle_sql()[name])


def test_empty_tables(empty, spark):
    assert jaccard.join(empty, 5, 80, 100).count() == 0
    assert substring.digest(empty).count() == 0 and spm.digest(empty).count() == 0 and media.digest(empty).count() == 0
    assert lm.score(empty, F.lit(True)).count() == 0
    assert neardup.link(vectors(spark).limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) >= {"doc_id", "n_tokens"} and 0 < out.select("doc_id").distinct().count() < docs.count()


def test_pipeline_keeps_one_of_each_group(spark, docs):
    import corpus_pipeline

    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    found = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.join(docs, 5, 80, 100).collect()}
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows if words(r.text)]
    assert sorted(i for i in ids if i is not None) == sorted({c for (d, n), c in found.items() if n and c is not None})
    assert len([r for r in rows if not words(r.text)]) == docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).count()
