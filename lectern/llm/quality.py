"""Operator 8: quality classifier by a sparse rule ensemble.

Short gradient-boosted trees over text statistics are grown on a sample; each
path from a root to a node is a conjunctive rule.  Lasso logistic regression
weighs the rules, the ones it keeps are compiled into Spark column expressions,
and the score is the logistic function of their weighted sum.

The fit sees at most `sample` labelled rows (those with the least hash of the
id), a documented bound; statistics and scores cover every whole text.  A null
text counts as empty and gets the score of zero statistics.  Without two label
values the score is the constant share of label 1 (0.5 without any label).
Equal texts get equal scores; repeated or conflicting labels are all used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow, remainder, schema, tidy
from ._text import LOWER, buffers, chunks, shingles, words

SAMPLE = 6000
THRESHOLD = 0.3

#: Shares of bytes by class.
CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "blank": (32, 9),
    "newline": (10,),
    "stop": b".",
    "comma": b",;:",
    "bang": b"!?",
    "symbol": b"#$%&*@^~|<>{}[]\\=+_/`",
    "quote": b"\"'()-",
    "control": [*range(0, 9), *range(11, 32), 127],
    "high": range(128, 256),
}
NAMES = (*CLASSES, "log_bytes", "log_words", "word_length", "long_words", "one_letter", "distinct_words", "distinct_runs", "log_lines")


def _share(hashes: np.ndarray, at: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    """Distinct hashes of each text by its number of hashes (1 for none)."""
    order = np.lexsort((hashes, at))
    h, d = hashes[order], at[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.where(size > 0, np.bincount(d[first], minlength=n) / np.maximum(size, 1), 1.0)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.zeros((n, len(NAMES)))
    for j, chars in enumerate(CLASSES.values()):
        table = np.zeros(256, bool)
        table[list(chars)] = True
        run = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        hits = run[off[1:]] - run[off[:-1]]
        out[:, j] = hits / np.maximum(size, 1)
        if j == list(CLASSES).index("newline"):
            out[:, NAMES.index("log_lines")] = np.log1p(hits)
    w = words(LOWER[data], off)
    count, length = w.counts, w.ends - w.starts
    text = np.repeat(np.arange(n), count)
    per = np.maximum(count, 1)
    k = len(CLASSES)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(count)
    out[:, k + 2] = np.bincount(text, length, n) / per
    out[:, k + 3] = np.bincount(text[length > 16], minlength=n) / per
    out[:, k + 4] = np.bincount(text[length < 2], minlength=n) / per
    h = w.hashes()
    out[:, k + 5] = _share(h, text, n, count)
    runs, at = shingles(h, w.per_doc, 3)
    out[:, k + 6] = _share(runs, text[at], n, np.maximum(count - 2, 0))
    return np.round(out, 9)


def with_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and a column s_<name> for each statistic."""
    arrow(df.sparkSession)
    names = [*keep, *(f"s_{x}" for x in NAMES)]
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(at))
            got = [statistics(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in chunks(off)]
            got = np.concatenate(got) if got else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c) for c in np.ascontiguousarray(got.T))], names)

    return df.select(*[df[c] for c in keep], *([] if text in keep else [df[text]])).mapInArrow(tidy(run), schema(df, keep, ", ".join(f"s_{x} double" for x in NAMES)))


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, bound), all of which must hold


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[float, Rule]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as an expression over the s_ columns."""
        total = F.lit(float(self.bias))
        for weight, rule in self.rules:
            holds = None
            for name, above, bound in rule:
                one = F.col(f"s_{name}") > F.lit(bound) if above else F.col(f"s_{name}") <= F.lit(bound)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int):
    """One tree on the gradients: (its rules, its value at each row)."""
    value, rules = np.zeros(len(x)), []

    def split(rows: np.ndarray, path: Rule, left: int) -> None:
        if path:
            rules.append(path)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if left and len(rows) >= 2 * least:
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = bins[rows, j]
                n = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
                a = np.cumsum(np.bincount(b, g[rows], len(cut) + 1))[:-1]
                c = np.cumsum(np.bincount(b, h[rows], len(cut) + 1))[:-1]
                gain = a * a / (c + 1) + (gs - a) ** 2 / (hs - c + 1) - gs * gs / (hs + 1)
                gain[(n < least) | (len(rows) - n < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if best[1] is None:
            value[rows] = -gs / (hs + 1)
            return
        j, k = best[1]
        low = bins[rows, j] <= k
        split(rows[low], (*path, (NAMES[j], False, float(cuts[j][k]))), left - 1)
        split(rows[~low], (*path, (NAMES[j], True, float(cuts[j][k]))), left - 1)

    split(np.arange(len(x)), (), depth)
    return rules, value


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1e-3, steps: int = 600) -> Ensemble:
    """Grow trees, list their rules, and keep those that the lasso gives a weight."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Ensemble(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 40)))[: -1 or None] for c in x.T]
    cuts = [c[(c >= col.min()) & (c < col.max())] for c, col in zip(cuts, x.T, strict=True)]
    bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
    least = max(5, len(y) // 200)
    f, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        found, value = _grow(x, bins, cuts, p - y, np.maximum(p * (1 - p), 1e-6), depth, least)
        rules.update(dict.fromkeys(found))
        f += rate * value
    rules = list(rules)
    if not rules:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))))
    at = {name: j for j, name in enumerate(NAMES)}
    z = np.stack([np.logical_and.reduce([(x[:, at[s]] > b) == up for s, up, b in r]) for r in rules], 1).astype(float)
    # Proximal gradient steps with momentum; the bias has no penalty.
    w, bias = np.zeros(len(rules)), float(np.log(y.mean() / (1 - y.mean())))
    norm = np.linalg.norm(np.column_stack([z, np.ones(len(y))]), 2) ** 2 / (4 * len(y))
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - z.T @ r / len(y) / norm
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / norm, 0)
        new_b = vb - r.mean() / norm
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - bias)
        w, bias, t = new, new_b, t2
    return Ensemble(float(bias), [(float(c), r) for c, r in zip(w, rules, strict=True) if abs(c) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Ensemble:
    """Fit on at most `sample` labelled rows: the least by hash of the id."""
    few = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("double").alias("y"))
    few = few.orderBy(F.xxhash64(F.col("k").cast("string")), "k", "y").limit(sample)
    # At most `sample` ids are broadcast.
    rows = docs.select(docs[key].alias("k"), docs["text"]).join(F.broadcast(few), "k")
    got = with_statistics(rows, keep=("k", "y")).collect()
    got.sort(key=lambda r: (r["k"], r["y"], tuple(r)[2:]))
    table = np.array([tuple(r)[1:] for r in got], float).reshape(len(got), len(NAMES) + 1)
    return fit(table[:, 1:], (table[:, 0] > 0.5).astype(float))


def score(df: DataFrame, model: Ensemble, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` (none of a result's name), score (0 to 1) and predicted (1 from THRESHOLD on)."""
    value = model.column()
    out = with_statistics(df, keep=keep).withColumn("score", value)
    return out.select(*[f"`{c}`" for c in keep], "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def learn(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Ensemble:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), 5) != 0)
    return train(docs, labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs.withColumn("held_out", held_out), learn(spark, sf_dir, docs), keep=("doc_id", "held_out"))
