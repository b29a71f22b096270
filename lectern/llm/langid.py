"""Operator 1: language identification by error-correcting output codes.

Each language gets a codeword of bits; one binary classifier over hashed byte
n-grams (2, 3 and 4 bytes, lower-case ASCII) predicts each bit.  Decoding is
loss-weighted: the language whose codeword has the least logistic loss under
the bit margins wins, its share of the softmax over negative losses is the
score, and a small gap to the next codeword flags ambiguity.

The classifiers are fitted on at most `per_language` labelled texts of each
language (those with the least hash), a documented bound; prediction reads
every byte of every text.  A null text, or one without a letter, is `und` with
score 0.  Equal texts get equal results; ties between codewords go to the
language that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ._common import arrow, remainder, schema
from ._text import LOWER, buffers, chunks

SLOTS = 1 << 13
PER_LANGUAGE = 600
ORDERS = (2, 3, 4)
#: Scale of relative frequencies, so that the weights are of order one.
SCALE = 100.0


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all distinct splits for up to 5 languages, else a
    dense random code with the largest least distance of 200 tries."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        cols = [[1 if (c >> r) & 1 else -1 for r in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(cols, float).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng, best = np.random.default_rng(7), (-1, None)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        d = ((code[:, None] != code[None]).sum(2) + np.eye(n, dtype=int) * bits).min()
        if d > best[0]:
            best = (d, code)
    return best[1]


def _grams(data: np.ndarray, off: np.ndarray):
    """(slot, text) of every n-gram inside one text, by order."""
    low = LOWER[data].astype(np.uint32)
    size = len(low)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    end = np.repeat(off[1:], np.diff(off))
    h = low + np.uint32(1)
    for n in range(2, max(ORDERS) + 1):
        if size < n:
            return
        h = h[: size - n + 1] * np.uint32(0x01000193) ^ low[n - 1 :]
        if n in ORDERS:
            slot = ((h * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.int64)
            inside = np.arange(size - n + 1) + n <= end[: size - n + 1]
            yield slot[inside], text[: size - n + 1][inside]


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Relative frequencies of the slots, a row for each text (for small samples)."""
    n = len(off) - 1
    out = np.zeros((n, SLOTS))
    for slot, text in _grams(data, off):
        out += np.bincount(text * SLOTS + slot, minlength=n * SLOTS).reshape(n, SLOTS)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)  # slots x bits
    bias: np.ndarray = field(repr=False)

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n, bits = len(off) - 1, self.code.shape[1]
        total, count = np.zeros((n, bits)), np.zeros(n)
        for slot, text in _grams(data, off):
            cut = np.flatnonzero(np.diff(text, prepend=-1))
            if len(cut):
                total[text[cut]] += np.add.reduceat(self.weights[slot], cut, axis=0, dtype=np.float64)
                count[text[cut]] += np.diff(cut, append=len(text))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, its score, and the gap to the next codeword's score."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        score = share[np.arange(len(best)), best]
        rest = np.sort(share, 1)[:, -2] if share.shape[1] > 1 else np.zeros(len(best))
        return best, score, score - rest


def fit(rows: list[tuple[str, bytes]], steps: int = 300) -> Model:
    """Logistic regression for each bit on (language, frequencies as float32 bytes)."""
    names = sorted({r[0] for r in rows})
    code = codewords(len(names))
    bits = code.shape[1]
    if not bits:
        return Model(names, code, np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(r[1], np.float32) for r in rows]) * np.float32(SCALE)
    at = np.searchsorted(names, [r[0] for r in rows])
    y = code[at].astype(np.float32)
    share = np.bincount(at, minlength=len(names))
    each = (1.0 / share[at])[:, None].astype(np.float32) / len(names)
    w, b = np.zeros((SLOTS, bits), np.float32), np.zeros(bits, np.float32)
    m, v = np.zeros((SLOTS + 1, bits), np.float32), np.zeros((SLOTS + 1, bits), np.float32)
    for t in range(1, steps + 1):
        pull = -y * each / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        g = np.vstack([x.T @ pull + 1e-5 * w, pull.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(names, code, (w * SCALE).astype(np.float32), b.astype(float))


def train(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most `per_language` rows of each label, the least by hash of key and text."""
    spark = df.sparkSession
    arrow(spark)
    rows = df.where(df[label].isNotNull() & (F.length(df[text]) > 0)).select(
        df[label].cast("string").alias("label"), df[text].alias("text"), F.xxhash64(df[key].cast("string"), df[text]).alias("h")
    )
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n:
        return Model([], np.ones((0, 0)), np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    # A share of the hash range that holds about twice the bound, so that the exact choice below sorts few rows.
    span = F.lit(None).cast("bigint")
    for name, count in n.items():
        share = min(1.0, 2.0 * per_language / count + 0.001)
        span = F.when(F.col("label") == name, F.lit(int(-(2**63) + share * (2**64 - 2048)))).otherwise(span)
    few = rows.where(F.col("h") <= span)

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            for lo, hi in chunks(off, 1 << 18):
                f = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array([r.tobytes() for r in f], pa.binary())], ["label", "h", "f"])

    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    chosen = few.withColumn("k", rank).where(F.col("k") <= per_language).drop("k")
    got = chosen.mapInArrow(run, "label string, h bigint, f binary").collect()
    return fit([(r["label"], bytes(r["f"])) for r in sorted(got, key=lambda r: (r["label"], r["h"], r["f"]))])


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ambiguous: float = 0.1) -> DataFrame:
    """The columns `keep`, then lang_pred, score (0 to 1) and ambiguous."""
    spark = df.sparkSession
    arrow(spark)
    held = spark.sparkContext.broadcast(model)  # at most languages x SLOTS weights

    def run(batches):
        m = held.value
        names = np.array([*m.languages, "und"], object)
        for b in batches:
            data, off = buffers(b.column(len(keep)))
            letter = pc.fill_null(pc.match_substring_regex(b.column(len(keep)), r"\pL"), False).to_numpy(zero_copy_only=False)
            best, score, gap = np.full(b.num_rows, len(m.languages)), np.zeros(b.num_rows), np.zeros(b.num_rows)
            for lo, hi in chunks(off, 1 << 20):
                if m.languages:
                    found = m.decode(m.margins(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                    best[lo:hi], score[lo:hi], gap[lo:hi] = found
            best[~letter], score[~letter], gap[~letter] = len(m.languages), 0, 0
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(score), pa.array(gap < ambiguous)],
                [*keep, "lang_pred", "score", "ambiguous"],
            )

    return df.select(*[df[c] for c in keep], df[text]).mapInArrow(run, schema(df, keep, "lang_pred string, score double, ambiguous boolean"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    learn = docs.where(remainder(F.col("doc_id"), 5) != 0)
    out = predict(docs.select("doc_id", "text", held_out.alias("held_out")), train(learn), keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
