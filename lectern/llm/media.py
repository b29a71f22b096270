"""Operator 6: telephony audio as media columns.

A media value is a WAV file: mu-law (format tag 7), A-law (6) or IMA ADPCM (17).
Companded samples expand through 256-entry tables; ADPCM steps through the
samples of a block once, on all blocks at the same time; decoded audio is
resampled linearly and stored as 16-bit PCM.  The query writes the files as a
column, reads them back, writes their PCM as a column, and describes what it
reads from there.

Null bytes decode to null; an empty payload is a file without samples.  A file
that is no WAV of these formats, is cut off, or has a rate outside RATES (whose
resampling would grow without bound) decodes to null rather than failing the
job.  Null ids stay null, repeated rows give repeated results, extra columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import arrow, discard, durable

TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
UNIT = 576
#: Rates of files that are decoded, so that a sample becomes at most 8 at 8 kHz.
RATES = range(1000, 192_001)
#: Output samples handled at once by the resampler.
PIECE = 1 << 18
#: Compression of the tables of files and PCM.
LEVEL = 9
#: ADPCM blocks that step together.
BLOCKS = 1 << 11


@lru_cache
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@lru_cache
def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, low + 0x108 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


@lru_cache
def step_table() -> np.ndarray:
    """IMA steps: 7, then a tenth more each time, as the standard rounds them."""
    # Fixed values of the IMA ADPCM standard, in natural order.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
         118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
         1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
         6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
         32767], np.int32)


@lru_cache
def _adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """Change of the sample and next step index, by step index and nibble."""
    step, nibble = step_table()[:, None], np.arange(16)[None]
    move = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    low = nibble & 7
    to = np.clip(np.arange(89)[:, None] + np.where(low < 4, -1, 2 * (low - 3)), 0, 88)
    return np.where(nibble & 8, -move, move).astype(np.int32).ravel(), to.astype(np.int32).ravel()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA blocks (blocks x bytes): the header's sample, then two a byte, low nibble first."""
    n, size = blocks.shape
    move, to = _adpcm_moves()
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = sample
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(size - 4):
        for half, nibble in ((1, body[k] & 15), (2, body[k] >> 4)):
            at = index * 16 + nibble
            sample = np.clip(sample + move[at], -32768, 32767)
            index = to[at]
            out[2 * k + half] = sample
    return np.ascontiguousarray(out.T)


def wav(payload: bytes, codec: str = "mulaw", rate: int = 8000, block: int = UNIT) -> bytes:
    """A mono file around the payload, byte for byte; an odd payload gets the format's pad byte after it."""
    tag = TAGS[codec]
    if codec == "adpcm":
        samples = 1 + 2 * (block - 4)
        head = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // samples, block, 4, 2, samples)
        count = len(payload) // block * samples
    else:
        head, count = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0), len(payload)
    body = b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, count & 0xFFFFFFFF)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def parts(file: bytes) -> tuple[int, int, int, memoryview] | None:
    """(format tag, rate, block size, payload), or None if this is no such file."""
    if len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        return None
    at, head, view = 12, None, memoryview(file)
    while at + 8 <= len(file):
        name, (size,) = file[at : at + 4], struct.unpack_from("<I", file, at + 4)
        if name == b"fmt " and size >= 16 and at + 24 <= len(file):
            tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", file, at + 8)
            head = (tag, rate, block) if channels == 1 and tag in TAGS.values() and rate in RATES else None
        if name == b"data" and head and at + 8 + size <= len(file):
            return *head, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def expand(tag: int, block: int, payload) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    if tag == TAGS["mulaw"]:
        return mulaw_table()[raw]
    if tag == TAGS["alaw"]:
        return alaw_table()[raw]
    whole = len(raw) // block * block if block > 4 else 0
    blocks = raw[:whole].reshape(-1, max(block, 1))
    return np.concatenate([adpcm(blocks[lo : lo + BLOCKS]).ravel() for lo in range(0, len(blocks), BLOCKS)] or [np.zeros(0, np.int16)])


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Another rate: linear interpolation upwards, the mean over the time of each new sample downwards; n samples become ceil(n * to / rate)."""
    if rate == to or not len(pcm):
        return pcm
    n = -(-len(pcm) * to // rate)
    out = np.empty(n, np.int16)
    for lo in range(0, n, PIECE):
        at = np.arange(lo, min(n, lo + PIECE) + (rate > to), dtype=np.int64) * rate
        left, part = at // to, at % to / to
        if rate > to:
            end = len(pcm)
            part[left >= end] = 0
            left = np.minimum(left, end)
            some = pcm[left[0] : left[-1] + 1].astype(np.float64)
            inside = left - left[0]
            area = np.concatenate([[0.0], np.cumsum(some)])[inside] + part * np.append(some, 0.0)[inside]
            out[lo : lo + len(at) - 1] = np.rint(np.diff(area) / np.diff(left + part))
        else:
            a = pcm[left].astype(np.float32)
            b = pcm[np.minimum(left + 1, len(pcm) - 1)].astype(np.float32)
            out[lo : lo + len(at)] = np.rint(a + (b - a) * part.astype(np.float32))
    return out


def decode(df: DataFrame, media: str = "media", key: str = "doc_id", to: int = 8000) -> DataFrame:
    """Per row: key, codec, samples, and pcm: 16-bit little-endian samples at rate `to`; nulls for what is no such file."""
    arrow(df.sparkSession)
    names = {v: k for k, v in TAGS.items()}

    def one(file):
        got = parts(file) if file is not None else None
        if not got:
            return None, None, None
        pcm = resample(expand(got[0], got[2], got[3]), got[1], to)
        return names[got[0]], len(pcm), pcm.astype("<i2").tobytes()

    kinds = {"codec": pa.string(), "samples": pa.int64(), "pcm": pa.binary()}
    return _each(df, key, (media,), one, kinds, f"key {df.schema[key].dataType.simpleString()}, codec string, samples bigint, pcm binary")


def store(df: DataFrame, codec: str = "mulaw", payload: str = "text", key: str = "doc_id", unit: int = UNIT, rate: int = 8000) -> DataFrame:
    """Per row: key, n_bytes, and media: the payload's bytes, 255 appended to a positive multiple of `unit`, as a file."""
    arrow(df.sparkSession)

    def one(raw):
        return len(raw or b""), wav(pad(raw or b"", unit), codec, rate)

    df = df.select(df[key], df[payload].cast("binary").alias(payload))
    return _each(df, key, (payload,), one, {"n_bytes": pa.int64(), "media": pa.binary()}, f"key {df.schema[key].dataType.simpleString()}, n_bytes bigint, media binary")


def _each(df: DataFrame, key: str, given: tuple[str, ...], one, kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """key and what `one` makes of the given columns of each row."""

    def some(*columns):
        return [one(*row) for row in zip(*columns, strict=True)]

    return _some(df, key, given, some, kinds, schema)


def _some(df: DataFrame, key: str, given: tuple[str, ...], some, kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """key and the rows that `some` makes of lists of the given columns, about a megabyte of rows at a time."""

    def run(batches):
        for b in batches:
            step = max(1, int(b.num_rows * (1 << 20) / max(b.nbytes, 1)))
            for lo in range(0, max(b.num_rows, 1), step):
                part = b.slice(lo, step)
                rows = some(*(c.to_pylist() for c in part.columns[1:]))
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds.values(), strict=True))], ["key", *kinds])

    return df.select(df[key], *(df[c] for c in given)).mapInArrow(run, schema).withColumnRenamed("key", key)


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def other_codecs(payloads) -> list[tuple[int, int]]:
    """Checksums of the samples of the same bytes as A-law and as ADPCM blocks; blocks of all payloads step together."""
    raw = [np.frombuffer(x, np.uint8) for x in payloads]
    first = np.cumsum([0, *(len(x) // UNIT for x in raw)])
    alaw, steps = [0] * len(raw), [0] * len(raw)
    for i, x in enumerate(raw):
        for lo in range(0, len(x), PIECE):
            alaw[i] = zlib.crc32(expand(TAGS["alaw"], 1, x[lo : lo + PIECE]).astype("<i2"), alaw[i])
    every = np.concatenate(raw).reshape(-1, UNIT) if raw else np.zeros((0, UNIT), np.uint8)
    for lo in range(0, len(every), BLOCKS):
        hi = min(lo + BLOCKS, len(every))
        pcm = adpcm(every[lo:hi]).astype("<i2")
        for i in range(int(np.searchsorted(first, lo, side="right")) - 1, int(np.searchsorted(first, hi))):
            steps[i] = zlib.crc32(pcm[max(first[i], lo) - lo : min(first[i + 1], hi) - lo], steps[i])
    return list(zip(alaw, steps, strict=True))


def level(pcm) -> str:
    """Length, power, peak, zero crossings and checksum of 16-bit samples, piece by piece."""
    pcm = np.frombuffer(pcm, "<i2")
    power = peak = cross = 0
    for lo in range(0, len(pcm), PIECE):
        part = pcm[lo : lo + PIECE + 1]  # one more, for the crossing between two pieces
        cross += int(np.count_nonzero((part[1:] < 0) != (part[:-1] < 0)))
        wide = part[:PIECE].astype(np.int64)
        power += int(wide @ wide)
        peak = max(peak, int(np.abs(wide).max()))
    return f"samples={len(pcm)};power={power};peak={peak};crossings={cross};pcm_crc={zlib.crc32(pcm)}"


_READ = {
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
    "media_sha256": pa.string(), "alaw_crc": pa.int64(), "adpcm_crc": pa.int64(), "pcm": pa.binary(),
}


def digest(df: DataFrame, rate: int = 16000, to: int = 8000) -> DataFrame:
    """Per row of (doc_id, text), null being empty: stored as wide-band mu-law files, read back, resampled to telephone
    rate, stored as PCM, read back and described."""
    spark = df.sparkSession

    def read(sizes, files):  # the rate is that of the file
        found = [parts(x) for x in files]
        rows = []
        for n, file, (_, held, _, payload), crc in zip(sizes, files, found, other_codecs([x[3] for x in found]), strict=True):
            pcm = resample(expand(TAGS["mulaw"], 1, payload), held, to).astype("<i2").tobytes()
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), *crc, pcm))
        return rows

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("pcm")
            told = [f"{level(x.as_buffer())};alaw_crc={a};adpcm_crc={c}" for x, a, c in zip(b.column(at), b.column(at - 2).to_pylist(), b.column(at - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: at - 2], pa.array(told, pa.string())], [*b.schema.names[: at - 2], "feature"])

    stored = durable(store(df, rate=rate), spark, level=LEVEL)
    kind = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"
    pcm = durable(_some(stored, "doc_id", ("n_bytes", "media"), read, _READ, kind.replace("doc_id", "key") + ", alaw_crc bigint, adpcm_crc bigint, pcm binary"), spark, level=LEVEL)
    discard(stored, spark)
    return pcm.mapInArrow(run, f"{kind}, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
