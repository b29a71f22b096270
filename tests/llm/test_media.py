"""Operator 6 by brute force: stored files, their digests and features, and files that are none."""

import hashlib
import struct
import zlib

import numpy as np

from lectern.llm import media


def slow(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
    file = media.wav(payload, rate=16000)

    def mulaw(code):
        code = ~code & 255
        size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
        return -size if code & 128 else size

    x = [mulaw(c) for c in payload]
    pcm = [round((a + b) / 2) for a, b in zip(x[::2], x[1::2], strict=True)]
    cross = sum((a < 0) != (b < 0) for a, b in zip(pcm[1:], pcm[:-1], strict=True))
    crc = lambda tag: zlib.crc32(media.expand(tag, 576, payload).astype("<i2"))
    feature = f"samples={len(pcm)};power={sum(v * v for v in pcm)};peak={max(map(abs, pcm))};crossings={cross};pcm_crc={zlib.crc32(struct.pack(f'<{len(pcm)}h', *pcm))};alaw_crc={crc(6)};adpcm_crc={crc(17)}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(media, "PIECE", 1000)
    monkeypatch.setattr(media, "BLOCKS", 3)
    rows = [(1, "a b", 1), (1, "a b", 2), (None, "é中" * 500, 3), (2, None, 4), (3, "", 5), (4, "x" * 576, 6), (5, "long text " * 2000, 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, media_bytes int")
    got = sorted((tuple(r) for r in media.digest(df).collect()), key=repr)
    assert got == sorted(((i, *slow(t)) for i, t, _ in rows), key=repr)
    assert media.digest(df.limit(0)).count() == 0


def test_files_that_are_cut_off_or_odd_are_null(spark):
    whole = media.wav(b"\xff\x00\x80", "mulaw")
    odd = [b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\1\0", *(whole[:n] for n in range(len(whole) - 1)), media.wav(b"abc", rate=1), media.wav(b"abc", rate=999), media.wav(b"abc", rate=1 << 30), None, b""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "doc_id bigint, media binary")
    got = {r.doc_id: (r.codec, r.samples, r.pcm) for r in media.decode(df).collect()}
    # Only the pad byte after the payload may be missing.
    assert [i for i, r in got.items() if r != (None, None, None)] == []
    assert media.decode(df.limit(0)).count() == 0
    kept = spark.createDataFrame([(1, media.wav(bytes(range(256)), c)) for c in ("alaw", "mulaw")], "doc_id bigint, media binary")
    for r in media.decode(kept).collect():
        table = media.alaw_table() if r.codec == "alaw" else media.mulaw_table()
        assert np.frombuffer(r.pcm, "<i2").tolist() == table.tolist()


def test_resampling(monkeypatch):
    monkeypatch.setattr(media, "PIECE", 7)
    x = np.random.default_rng(1).integers(-32768, 32768, 101).astype(np.int16)
    for rate, to in ((8000, 16000), (11025, 16000), (8000, 12000)):
        at = [i * rate / to for i in range(-(-len(x) * to // rate))]
        want = [x[int(p)] + (float(x[min(int(p) + 1, 100)]) - x[int(p)]) * (p - int(p)) for p in at]
        assert np.abs(media.resample(x, rate, to) - np.array(want)).max() <= 0.6
    for rate, to in ((16000, 8000), (12000, 8000), (44100, 8000)):
        want = []
        for i in range(-(-len(x) * to // rate)):
            lo, hi = i * rate / to, min((i + 1) * rate / to, 101)
            want.append(sum(float(x[j]) * (min(j + 1, hi) - max(j, lo)) for j in range(int(lo), min(101, int(np.ceil(hi))))) / (hi - lo))
        assert np.abs(media.resample(x, rate, to) - np.array(want)).max() <= 0.51
    assert len(media.resample(x[:0], 8000, 16000)) == 0
