"""Word boxes: normalised grids, occupancy, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


def normalize_boxes(words: Column, width: Column, height: Column, most: int = 512) -> Column:
    """Boxes of page 1 on a 0-1000 grid, corners in order, blank and empty ones dropped, the first `most`."""
    at = lambda v, of: F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(v / of * 1000).cast("int")))
    first = F.filter(words, lambda w: (w["page"] == 1) & (F.trim(w["text"]) != ""))
    boxes = F.transform(first, lambda w: F.struct(
        w["text"].alias("text"), F.least(at(w["x0"], width), at(w["x1"], width)).alias("x0"), F.least(at(w["y0"], height), at(w["y1"], height)).alias("y0"),
        F.greatest(at(w["x0"], width), at(w["x1"], width)).alias("x1"), F.greatest(at(w["y0"], height), at(w["y1"], height)).alias("y1"),
    ))
    return F.slice(F.filter(boxes, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])), 1, most)


def occupancy(boxes: DataFrame, key: str, rows: int = 16, cols: int = 12) -> DataFrame:
    """(key, cell, n): boxes x0..y1 in 0-1 that touch each cell of the grid."""
    cell = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v * n).cast("int")))
    r = F.explode(F.sequence(cell(F.col("y0"), rows), cell(F.col("y1"), rows)))
    c = F.explode(F.sequence(cell(F.col("x0"), cols), cell(F.col("x1"), cols)))
    return boxes.withColumn("_r", r).withColumn("_c", c).groupBy(key, (F.col("_r") * cols + F.col("_c")).alias("cell")).agg(F.count("*").alias("n"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(queries: DataFrame, against: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Each query's most similar other row and its label; `against` is a reference set of bounded size, and is broadcast."""
    q, a = queries.select(F.col(key).alias("q"), F.col(vector).alias("qv"), F.col(label).alias("ql")), against.select(F.col(key).alias("k"), F.col(vector).alias("kv"), F.col(label).alias("kl"))
    both = q.join(F.broadcast(a), F.col("q") != F.col("k")).select("q", "ql", F.struct(F.round(cosine(F.col("qv"), F.col("kv")), 6).alias("s"), (-F.col("k")).alias("k"), F.col("kl").alias("l")).alias("b"))
    return both.groupBy("q", "ql").agg(F.max("b").alias("b")).select(F.col("q").alias(key), F.col("ql").alias("label"), (-F.col("b.k")).alias("nearest"), F.col("b.l").alias("nearest_label"))


def _blocked(rows: DataFrame, key: str, vector: str, label: str, block: int) -> DataFrame:
    """Pairs of blocks of rows, x and y, some eight at most to a task; more blocks than the size asks for where tasks would be idle."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(-(-n // 256), cores, 32))
    one = lambda side: rows.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias(f"{side}b")).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("l"))).alias(side)).select(side)
    return one("x").repartition(blocks).crossJoin(one("y").repartition(max(-(-blocks // 8), min(blocks, cores))))


def nearest_of_all(rows: DataFrame, key: str, vector: str, label: str, block: int = 4096, tile: int = 512) -> DataFrame:
    """As nearest(), but against all rows: every pair of blocks of about `block` rows is compared, so time grows with the square of the rows.

    A pair of blocks is scored in single precision, `tile` queries at a time; what comes close to a query's best is scored again
    in double precision and rounded, so the result is that of double precision for all pairs.
    """
    ship(rows.sparkSession)
    def table(found):
        """Unit vectors by row, with their length, 0 where there is no direction."""
        import numpy as np

        lists = found.field("v")
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        out = np.zeros((len(size), max(1, size.max(initial=0))))
        out[row, at] = flat.fill_null(0).to_numpy(zero_copy_only=False)
        size[row[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((out * out).sum(axis=1))
        size[~((norm > 0) & (norm < np.inf))] = 0
        out[size == 0] = 0
        return out / np.where(size > 0, norm, 1)[:, None], size

    def best_of(q, a):
        """For each row of q: the score of the best row of a by rounded score, then least key; a in the order of its keys."""
        import numpy as np

        (qv, qn), (av, an) = table(q), table(a)
        qk, ak = (x.field("k").to_numpy(zero_copy_only=False) for x in (q, a))
        width = max(qv.shape[1], av.shape[1])
        # Two more coordinates: vectors of other lengths, or without direction, score low.
        qv, av = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (qv, av))
        q32, a32 = qv.astype(np.float32), av.astype(np.float32)
        plain = len(np.unique(np.concatenate([qn, an]))) == 1 and qn.min(initial=0) > 0
        # Twice the error of a product in single precision, and a unit of the rounded score.
        close = np.float32(1e-6 + 2 * (width + 4) * 2.0**-24)
        own = np.searchsorted(ak, qk)
        own_end = np.searchsorted(ak, qk, side="right")
        at, score = np.zeros(len(qk), dtype=np.int64), np.full(len(qk), -3.0)
        for i in range(0, len(qk), tile):
            j = min(i + tile, len(qk))
            s = q32[i:j] @ a32.T
            if not plain:
                s[(qn[i:j, None] != an) | (qn[i:j, None] == 0)] = -2.0
            for r in np.flatnonzero(own_end[i:j] > own[i:j]):
                s[r, own[i + r] : own_end[i + r]] = -3.0
            near = s >= (s.max(axis=1) - close)[:, None]
            # Where many are near, the whole row is scored again.
            many = np.count_nonzero(near, axis=1) > 64
            if many.any():
                row = np.flatnonzero(many)
                full = np.round(qv[i + row] @ av.T, 6)
                full = np.where(s[row] < -1.5, s[row], full)
                at[i + row], score[i + row] = full.argmax(axis=1), full.max(axis=1)
                near[row] = False
            r, c = np.nonzero(near)
            low = s[r, c]
            exact = np.where(low < -1.5, low, np.round((qv[i + r] * av[c]).sum(axis=1), 6))
            # By row, then best first, then by place, that is by key.
            order = np.lexsort((c, -exact, r))
            first = order[np.unique(r[order], return_index=True)[1]]
            at[i + r[first]], score[i + r[first]] = c[first], exact[first]
        return at, score

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                q, a = (c.slice(i, 1).flatten() for c in batch.columns)
                # The least key first among equals.
                a = a.take(pa.array(np.argsort(a.field("k").to_numpy(zero_copy_only=False), kind="stable")))
                best, score = best_of(q, a)
                kept = np.flatnonzero(score > -3.0)
                at = pa.array(best[kept])
                q = q.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([q.field("k"), q.field("l"), pa.array(score[kept]), a.field("k").take(at), a.field("l").take(at)], ["q", "ql", "s", "k", "l"])

    k, lab = (rows.schema[x].dataType.simpleString() for x in (key, label))
    found = _blocked(rows, key, vector, label, block).mapInArrow(run, f"q {k}, ql {lab}, s double, k {k}, l {lab}")
    best = found.groupBy("q", "ql").agg(F.max(F.struct("s", (-F.col("k")).alias("k"), "l")).alias("b"))
    return best.select(F.col("q").alias(key), F.col("ql").alias("label"), (-F.col("b.k")).alias("nearest"), F.col("b.l").alias("nearest_label"))
