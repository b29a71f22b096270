"""Operator 4: embedding near-dedup with an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the pairs of centres
form a grid of cells.  A vector visits cells in the order of their least
possible distance (a multi-sequence traversal of both halves' centres) until
the rest cannot hold what it looks for: with `recall` 1 that is the bound of
the Voronoi cells, so no link is missed; a lower value stops earlier.  Pairs in
visited cells are verified by cosine in double precision.

Only vectors of one label and dimension meet.  Equal vectors are one node with
copies.  The codebooks are fitted on at most `sample` vectors (the least by
hash), a documented bound; every vector is indexed.  A cell with more members
or visitors than a block is split, every part against every part.

Vectors that are null, zero or hold null or non-finite components, or have no
label, link with nothing: n_links 0 and their own id as component.  Repeated
rows link with each other.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow, components, durable, partitions
from ._pack import runs
from .jaccard import _forest

CENTRES = 8
SAMPLE = 4096
BLOCK = 1024


def codebook(x: np.ndarray, centres: int = CENTRES, rounds: int = 15) -> np.ndarray:
    """k-means centres of the rows of x, from a fixed seed."""
    x = np.unique(x, axis=0)
    if len(x) <= centres:
        return x if len(x) else np.zeros((1, x.shape[1]))
    c = x[np.random.default_rng(5).choice(len(x), centres, replace=False)]
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, np.stack([np.bincount(near, col, len(c)) for col in x.T], 1) / np.maximum(n, 1)[:, None], c) if x.shape[1] else c
    return np.unique(c, axis=0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)


def cell_bounds(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lower bound of the squared distance from each row to each centre's Voronoi cell."""
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    # Distance to the plane between a centre and each other one.
    plane = (d[:, :, None] - d[:, None, :]) / (2 * apart)[None]
    return np.maximum(plane.max(2), 0) ** 2


def multi_sequence(a: np.ndarray, b: np.ndarray):
    """Pairs (i, j, a[i] + b[j]) by rising sum: the frontier of two sorted lists."""
    x, y = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen = [(a[x[0]] + b[y[0]], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield int(x[i]), int(y[j]), float(total)
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(x) and q < len(y) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (a[x[p]] + b[y[q]], p, q))


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cosine: float, recall: float = 1.0) -> tuple[np.ndarray, list[list[int]]]:
    """(own cell, cells visited) of each unit vector."""
    half = x.shape[1] // 2
    a, b = x[:, :half], x[:, half:]
    width = len(books[1])
    own = nearest(a, books[0]) * width + nearest(b, books[1])
    reach = (2 - 2 * cosine) * recall + 1e-9  # squared distance of unit vectors
    one, two = cell_bounds(a, books[0]), cell_bounds(b, books[1])
    out = []
    for i in range(len(x)):
        cells = []
        for p, q, total in multi_sequence(one[i], two[i]):
            if total > reach:
                break
            cells.append(p * width + q)
        out.append(cells)
    return own, out


def link(df: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         centres: int = CENTRES, sample: int = SAMPLE, recall: float = 1.0) -> DataFrame:
    """key, n_links, component_id, kept of each row."""
    spark = df.sparkSession
    arrow(spark)
    parts = 4 * partitions(spark)
    rows = df.select(df[key].alias("id"), df[vector].cast("array<double>").alias("v"), df[label].cast("string").alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", F.when(F.col("v").isNotNull() & F.col("label").isNotNull() & fine, F.col("v")).alias("v"), "label")
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    nodes = rows.where("v is not null").groupBy("node", "label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    nodes = durable(nodes, spark)

    few = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("v").collect()
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in sorted({len(r[0]) for r in few}):
        x = np.array([r[0] for r in few if len(r[0]) == size])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        books[size] = (codebook(x[:, : size // 2], centres), codebook(x[:, size // 2 :], centres))

    def spread(batches):
        for b in batches:
            v = b.column(2)
            size = pa.compute.list_value_length(v).to_numpy()
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = v.take(pa.array(at)).flatten().to_numpy().reshape(-1, n)
                some = books.get(int(n)) or (np.zeros((1, n // 2)), np.zeros((1, n - n // 2)))
                scale = np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
                unit = x / scale
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                own, cells = visits(unit, some, cosine, recall)
                # A pair meets in the higher cell of the two.
                cells = [[c for c in cs if c > o] + [o] for cs, o in zip(cells, own.tolist(), strict=True)]
                many = np.array([len(c) for c in cells])
                cell = np.concatenate([*map(np.asarray, cells), own]).astype(np.int64)
                who = np.concatenate([np.repeat(at, many), at])
                index = np.concatenate([np.zeros(many.sum(), bool), np.ones(len(at), bool)])
                home = cell == np.concatenate([np.repeat(own, many), own])
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).take(take), pa.array(np.full(len(who), n), pa.int32()), pa.array(cell), pa.array(index), pa.array(home), b.column(0).take(take), b.column(3).take(take), v.take(take)],
                    ["label", "dim", "cell", "is_index", "home", "node", "copies", "v"],
                )

    met = nodes.select("node", "label", "v", "copies").mapInArrow(
        spread, "label string, dim int, cell bigint, is_index boolean, home boolean, node bigint, copies bigint, v array<double>"
    )
    met = durable(met, spark)
    where = ["label", "dim", "cell"]
    load = met.groupBy(*where).agg(F.count_if("is_index").alias("members"), F.count_if(~F.col("is_index")).alias("visitors")).where("members > 0")
    load = load.select(*where, F.ceil(F.col("members") / BLOCK).cast("int").alias("m"), F.ceil(F.col("visitors") / BLOCK).cast("int").alias("q"))
    split = met.join(load, where)
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("is_index"), F.col("m")).otherwise(F.col("q"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("is_index"), F.col("q")).otherwise(F.col("m")) - 1)
    split = split.withColumn("own", mine).withColumn("other", F.explode(others))
    group = F.xxhash64(*where, F.when(F.col("is_index"), F.col("own")).otherwise(F.col("other")), F.when(F.col("is_index"), F.col("other")).otherwise(F.col("own")))
    split = split.select(group.alias("group"), "is_index", "home", "node", "copies", "v").withColumn("part", F.pmod("group", F.lit(parts)).cast("int"))

    def verify(table):
        group = table.column("group").to_numpy()
        index, home, node, copies = (table.column(c).to_numpy() for c in ("is_index", "home", "node", "copies"))
        v = table.column("v").combine_chunks()
        order = np.argsort(group, kind="stable")
        u, to, n = [], [], []
        for own in np.split(order, runs(group[order])[1:]):
            a, b = own[~index[own]], own[index[own]]
            if not len(a) or not len(b):
                continue
            get = lambda at: np.stack([np.asarray(v[int(i)].values) for i in at])
            x, y = get(a), get(b)
            x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
            near = x @ y.T / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))) >= cosine
            # Members visit their own cell, too: those pairs count once.
            near &= ~home[a][:, None] | (node[a][:, None] < node[b][None])
            for at, k in ((a, (near * copies[b][None]).sum(1)), (b, (near * copies[a][:, None]).sum(0))):
                hit = np.flatnonzero(k)
                u += node[at[hit]].tolist()
                to += [None] * len(hit)
                n += k[hit].tolist()
            for p, q in _forest(near, node[a], node[b]):
                u.append(p)
                to.append(q)
                n.append(0)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(to, pa.int64()), "n": pa.array(n, pa.int64())})

    found = durable(split.groupBy("part").applyInArrow(verify, "u bigint, v bigint, n bigint"), spark, few=True)
    near = found.where("v is null").groupBy("u").agg(F.sum("n").alias("near"))
    root = components(spark, found.where("v is not null").select("u", "v")).withColumnRenamed("node", "r")
    info = nodes.select("node", "copies", "least").join(root, F.col("node") == F.col("r"), "left").withColumn("root", F.coalesce("root", "node"))
    first = info.groupBy("root").agg(F.min("least").alias("component"))
    info = info.join(first, "root").join(near, F.col("node") == F.col("u"), "left").select(
        F.col("node").alias("k"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"), "component"
    )
    out = rows.select("id", "node").join(info, F.col("node") == F.col("k"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
