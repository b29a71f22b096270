"""Operator 10: n-gram Jaccard join by vertical partitioning.

A document's set holds its distinct shingles of `k` words (the whole sequence,
if it has fewer).  Equal sets form a class, known by a 64-bit hash of the set.
Two classes link when den * |A & B| >= num * |A | B|.

1. The global n-gram order is cut into fragments (ranges of the shingle hash),
   and every set is cut along with it.  A fragment sees all occurrences of its
   shingles, so it finds for each class the shingles that a class of linkable
   size shares, with their document frequencies.
2. A class whose shared shingles cannot reach the overlap it needs has no link.
   The others keep their shared shingles, rarest first; linked classes must
   share one within the first a - o + 1 of a (o: least overlap).
3. Classes joined through such shingles form candidate clusters (a superset of
   the components).  Clusters are verified in blocks of members of linkable
   sizes: fragment by fragment, partial overlaps of all pairs of a block are
   counted as a matrix product and summed.  A block returns a spanning forest
   of its links and link counts, never pairs.

No pair is missed and no list of pairs is ever made.  Null or empty text has an
empty set that links with nothing; repeated rows are members of one class;
a null id never becomes the id of a component with another id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow, components, durable, partitions, tidied, tidy
from ._pack import from_planes, gather, groups, pack, planes, runs, unpack
from ._text import LOWER, buffers, chunks, mix, shingles, words

#: Members of a block, and shingles counted at once.
BLOCK = 384
COLUMNS = 2048
#: Parts of the occurrences of one shingle.
SALTS = 16


def sets(data: np.ndarray, off: np.ndarray, k: int):
    """(shingle, text) pairs, distinct and sorted by text and shingle; and each text's class (0 if empty) and size."""
    low = LOWER[data]
    w = words(low, off)
    h = w.hashes()
    s, at = shingles(h, w.per_doc, k)
    text = np.searchsorted(w.per_doc, at, side="right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = [int(mix(np.array([hash_sequence(h[w.per_doc[i] : w.per_doc[i + 1]])], np.uint64))[0]) for i in short]
        s, text = np.concatenate([s, np.array(whole, np.uint64)]), np.concatenate([text, short])
    del low, w, h, at  # as large as what follows
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    del order
    first = runs(text, s)
    s, text = s[first], text[first]
    n = len(off) - 1
    per = np.searchsorted(text, np.arange(n + 1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
    size = np.diff(per)
    name = mix((total[per[1:]] - total[per[:-1]]) ^ mix(size.astype(np.uint64)))
    return s, text, np.where(size > 0, name, np.uint64(0)).view(np.int64), size


def hash_sequence(h: np.ndarray) -> np.uint64:
    out = np.array([len(h)], np.uint64)
    for x in h:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out[0]


def classes(df: DataFrame, k: int) -> DataFrame:
    """(doc_id, h, n_shingles, class) of each row of (doc_id, text); h is xxhash64(text)."""
    arrow(df.sparkSession)

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(2))
            for lo, hi in chunks(off):
                _, _, name, size = sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(size, pa.int64()), pa.array(name, pa.int64())], ["doc_id", "h", "n_shingles", "class"])

    rows = df.select(df["doc_id"], F.xxhash64(df["text"]), df["text"])
    return rows.mapInArrow(tidy(run), "doc_id bigint, h bigint, n_shingles bigint, class bigint")


def _alike(small, large, num: int, den: int):
    return small * den >= num * large


def survivors(df: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(class, n, shared binary, prefix binary): the classes that can have a link."""
    spark = df.sparkSession
    arrow(spark)
    parts = partitions(spark)
    bits = max(4, int(np.ceil(np.log2(2 * parts))))
    fragments = 1 << bits

    def cut(batches):
        for table in gather(batches):
            data, off = buffers(table.column(0))
            for lo, hi in chunks(off, 8 << 20):
                s, text, name, size = sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                # Equal sets of this chunk once.
                _, first = np.unique(name, return_index=True)
                once = np.zeros(hi - lo, bool)
                once[first] = True
                once &= size > 0
                s, text = s[once[text]], text[once[text]]
                order, at = groups((s >> np.uint64(64 - bits)).astype(np.int64), fragments)
                blobs = []
                for f in np.flatnonzero(np.diff(at)):
                    own = order[at[f] : at[f + 1]]
                    used = runs(text[own])
                    count = np.diff(used, append=len(own)).astype(np.int32)
                    own_text = text[own][used]
                    blobs.append((f, pack(name[own_text], size[own_text].astype(np.int32), count, planes(s[own]))))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in blobs], pa.int32()), pa.array([x[1] for x in blobs], pa.binary())], ["fragment", "blob"])

    def share(key, table):
        f = key[0].as_py()
        name, size, count, s = (np.concatenate(x, axis=-1) for x in zip(*(unpack(x.as_py()) for x in table.column("blob")), strict=True))
        s = from_planes(s)
        # A class may come from several chunks.
        ids, first, which = np.unique(name, return_index=True, return_inverse=True)
        fresh = np.zeros(len(name), bool)
        fresh[first] = True
        keep = np.repeat(fresh, count)
        owner = np.repeat(which, count)[keep].astype(np.int32)
        s, n = s[keep], size[first]
        order = np.lexsort((n[owner], s))
        s, owner = s[order], owner[order]
        same = s[1:] == s[:-1]
        close = same & _alike(n[owner[:-1]].astype(np.int64), n[owner[1:]].astype(np.int64), num, den)
        linked = np.zeros(len(s), bool)
        linked[1:] |= close
        linked[:-1] |= close
        start = runs(s)
        frequency = np.repeat(np.diff(start, append=len(s)), np.diff(start, append=len(s)))
        s, owner, frequency = s[linked], owner[linked], frequency[linked]
        part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((s, owner, part[owner]))
        s, owner, frequency = s[order], owner[order], frequency[order]
        at = np.searchsorted(part[owner], np.arange(parts + 1))
        blobs = []
        for p in np.flatnonzero(np.diff(at)):
            own = slice(at[p], at[p + 1])
            used = runs(owner[own])
            who = owner[own][used]
            blobs.append((p, pack(f, ids[who], n[who], np.diff(used, append=at[p + 1] - at[p]).astype(np.int32), planes(s[own]), frequency[own].astype(np.int32))))
        return pa.table({"part": pa.array([x[0] for x in blobs], pa.int32()), "blob": pa.array([x[1] for x in blobs], pa.binary())})

    def choose(table):
        name, size, s, frequency = [], [], [], []
        for blob in table.column("blob"):
            f, ids, n, count, low, df_ = unpack(blob.as_py())
            name.append(np.repeat(ids, count))
            size.append(np.repeat(n, count))
            s.append(from_planes(low) | np.uint64(f) << np.uint64(48))
            frequency.append(df_)
        name, size, s, frequency = (np.concatenate(x) for x in (name, size, s, frequency))
        order = np.lexsort((s, frequency, name))
        name, size, s = name[order], size[order].astype(np.int64), s[order]
        at = runs(name)
        a = np.diff(at, append=len(name))
        need = -(-size[at] * num // den)
        rows = [(int(name[i]), int(size[i]), s[i : i + n].tobytes(), s[i : i + n - o + 1].tobytes()) for i, n, o in zip(at.tolist(), a.tolist(), need.tolist(), strict=True) if n >= o]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(list(x), t) for c, x, t in zip(("class", "n", "shared", "prefix"), cols, kinds, strict=True)})

    sent = df.select(df["text"]).mapInArrow(tidy(cut), "fragment int, blob binary")
    held = sent.groupBy("fragment").applyInArrow(lambda key, table: tidied(share(key, table)), "part int, blob binary")
    return held.groupBy("part").applyInArrow(lambda table: tidied(choose(table)), "class bigint, n int, shared binary, prefix binary")


def clusters(able: DataFrame) -> DataFrame:
    """(node, root): classes joined through shingles of their prefixes."""

    def spread(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                data, off = buffers(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), np.diff(off) // 8))], ["s", "class"]
                )

    rows = able.select("class", "prefix").mapInArrow(spread, "s bigint, class bigint").withColumn("salt", F.pmod(F.xxhash64("class", F.lit(2)), F.lit(SALTS)))
    # A shingle that many share is joined in parts, by the least of each, and these by the least of all.
    part = rows.groupBy("s", "salt").agg(F.min("class").alias("v"))
    least = part.groupBy("s").agg(F.min("v").alias("w"))
    near = rows.join(part, ["s", "salt"]).where("class <> v").select(F.col("class").alias("u"), "v")
    far = part.join(least, "s").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return components(able.sparkSession, near.union(far).distinct())


def overlaps(mine: np.ndarray, his: np.ndarray | None, a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Overlap counts of all pairs: partial counts of each range of the order, summed."""
    both = a if b is None else a + b
    flat = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    use = count > 1
    new = np.cumsum(use) - 1
    keep = use[col]
    row, col = row[keep], new[col[keep]]
    total = np.zeros((len(a), len(a) if b is None else len(b)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(use.sum()), COLUMNS):
        x, y = np.searchsorted(col, [lo, lo + COLUMNS])
        m = np.zeros((len(both), COLUMNS), np.float32)
        m[row[x:y], col[x:y] - lo] = 1
        total += m[: len(a)] @ (m if b is None else m[len(a) :]).T
    return total.astype(np.int64)


def _forest(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, at most one for each member."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(link), strict=True):
        x, y = int(rows[i]), int(cols[j])
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def links(able: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v, n): v null: class u has n linked documents in other classes of a block; else an edge of a spanning forest."""
    spark = able.sparkSession
    parts = 4 * partitions(spark)
    member = clusters(able)
    rows = able.select("class", "n", "shared").join(member, F.col("class") == F.col("node")).drop("node").join(copies, "class")
    # Sizes that can link are at most one band apart.
    rows = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("int") if num < den else F.col("n"))
    per = durable(rows.groupBy("root", "band").agg(F.count("*").alias("c")), spark, few=True)
    whole = per.groupBy("root").agg(F.sum("c").alias("all"))
    per = per.join(whole, "root").withColumn("salts", F.ceil(F.col("c") / BLOCK).cast("int"))
    other = per.select("root", (F.col("band") - 1).alias("band"), F.col("salts").alias("above"))
    below = per.select("root", (F.col("band") + 1).alias("band"), F.col("salts").alias("under"))
    per = per.join(other, ["root", "band"], "left").join(below, ["root", "band"], "left").drop("c")
    rows = rows.join(per, ["root", "band"]).withColumn("salt", F.pmod(F.xxhash64("class", F.lit(1)), F.col("salts")).cast("int"))

    def block(band, salt):
        return F.struct(band.alias("band"), salt.alias("salt"))

    none = F.array().cast("array<struct<a:struct<band:int,salt:int>,b:struct<band:int,salt:int>,left:boolean>>")
    own, band = block(F.col("band"), F.col("salt")), F.col("band")

    def pairs(n, make):
        return F.when(n.isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(none)

    inside = F.transform(
        F.sequence(F.lit(0), F.col("salts") - 1),
        lambda t: F.struct(block(band, F.least(t, F.col("salt"))).alias("a"), block(band, F.greatest(t, F.col("salt"))).alias("b"), (F.col("salt") <= t).alias("left")),
    )
    up = pairs(F.col("above"), lambda t: F.struct(own.alias("a"), block(band + 1, t).alias("b"), F.lit(True).alias("left")))
    down = pairs(F.col("under"), lambda t: F.struct(block(band - 1, t).alias("a"), own.alias("b"), F.lit(False).alias("left")))
    alone = F.array(F.struct(block(F.lit(-1), F.lit(0)).alias("a"), block(F.lit(-1), F.lit(0)).alias("b"), F.lit(True).alias("left")))
    tasks = F.explode(F.when(F.col("all") <= BLOCK, alone).otherwise(F.concat(inside, up, down)))
    rows = rows.withColumn("task", tasks).select("root", F.col("task.a").alias("a"), F.col("task.b").alias("b"), F.col("task.left").alias("left"), "class", "n", "copies", "shared")
    rows = rows.select(
        F.pmod(F.xxhash64("root", "a", "b"), F.lit(parts)).cast("int").alias("part"), F.xxhash64("root", "a", "b").alias("group"),
        (F.col("a") == F.col("b")).alias("same"), "left", "class", "n", "copies", "shared",
    )

    def verify(table):
        group = table.column("group").to_numpy()
        order = np.argsort(group, kind="stable")
        same, left = (table.column(c).to_numpy() for c in ("same", "left"))
        name, n, copies_ = (table.column(c).to_numpy() for c in ("class", "n", "copies"))
        shared = table.column("shared")
        u, v, c = [], [], []
        for own in np.split(order, runs(group[order])[1:]):
            if len(own) < 2:
                continue
            mine = own if same[own[0]] else own[left[own]]
            his = own if same[own[0]] else own[~left[own]]
            if not len(mine) or not len(his):
                continue
            get = lambda at: [np.frombuffer(shared[int(i)].as_py(), np.int64) for i in at]
            o = overlaps(mine, his, get(mine), None if same[own[0]] else get(his))
            sizes = n[mine].astype(np.int64)[:, None] + n[his].astype(np.int64)[None]
            link = o * (den + num) >= num * sizes
            if same[own[0]]:
                np.fill_diagonal(link, False)
            count = (link * copies_[his][None]).sum(1)
            for at, k in ((mine, count), *(() if same[own[0]] else ((his, (link * copies_[mine][:, None]).sum(0)),))):
                hit = np.flatnonzero(k)
                u += name[at[hit]].tolist()
                v += [None] * len(hit)
                c += k[hit].tolist()
            for x, y in _forest(np.triu(link) if same[own[0]] else link, name[mine], name[his]):
                u.append(x)
                v.append(y)
                c.append(0)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(c, pa.int64())})

    return rows.groupBy("part").applyInArrow(lambda table: tidied(verify(table)), "u bigint, v bigint, n bigint")


def join(df: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, h, n_shingles, class, n_links, component_id of each row of (doc_id bigint, text).

    n_links counts the other documents linked directly, copies included;
    component_id is the least id reachable by links.
    """
    spark = df.sparkSession
    df = df.select(df["doc_id"], df["text"])
    docs = durable(classes(df, k), spark)
    copies = docs.where("n_shingles > 0").groupBy("class").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    able = durable(survivors(df, k, num, den), spark)
    found = durable(links(able, copies.select("class", "copies"), num, den), spark, few=True)
    near = found.where("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("near"))
    root = components(spark, found.where("v is not null").select("u", "v"))
    root = copies.join(root, F.col("class") == F.col("node"), "left").select("class", "copies", "least", F.coalesce("root", "class").alias("root"))
    first = root.groupBy("root").agg(F.min("least").alias("component"))
    info = root.join(first, "root").join(near, "class", "left").select(
        F.col("class").alias("c2"), "component", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")
    )
    out = docs.join(info, (F.col("class") == F.col("c2")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "h", "n_shingles", "class", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")
