"""Matching predictions with truth, and accuracy by slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import MONEY_TOLERANCE, NAME_THRESHOLD, READ, TEXT_THRESHOLD, clean, compare, digits_only, field_state, is_blank, normalise_identifier, normalise_name, normalise_text, rate
from ..functions.fuzzy import gestalt
from ..registry import Field
from ..session import ship

ROW_FLOOR, KEY_WEIGHT = 0.34, 3.0
PAIRS = "array<struct<t:int,p:int,score:double>>"
#: Kinds that match where their forms are equal; those that are not read to values, nor here, match by the fuzzy ratio.
EQUAL = ("identifier", "enum", "ssn", "ein", "phone", "account", "email")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pair(predicted: DataFrame, truth: DataFrame, key: str = "file") -> DataFrame:
    """Every truth row with its prediction (null if there is none), as structs `truth` and `predicted`."""
    t = truth.select(F.col(key).alias("_t"), F.struct("*").alias("truth"))
    p = predicted.select(F.col(key).alias("_p"), F.struct("*").alias("predicted"))
    return t.join(p, F.col("_t") == F.col("_p"), "left").select(F.col("_t").alias(key), "truth", "predicted")


def long_pairs(paired: DataFrame, fields: tuple[Field, ...], key: str = "file", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, field, state, exact, match, note): a row for each field that the truth declares."""
    # Cleaned, read and compared once, as columns: an exploded array shares no parts, and large generated methods are never compiled.
    sides = ("predicted", "truth")
    paired = paired.withColumns({f"_{side}_{f.name}": clean(F.col(f"{side}.{f.name}")) for f in fields for side in sides})
    paired = paired.withColumns({f"_{side}_{f.name}_v": READ[f.kind](F.col(f"_{side}_{f.name}"), ready=True) for f in fields if f.kind in READ for side in sides})
    cells = {f.name: [F.col(f"_{side}_{f.name}") for side in sides] for f in fields}
    values = {f.name: tuple(F.col(f"_{side}_{f.name}_v") for side in sides) for f in fields if f.kind in READ}
    paired = paired.withColumns({f"_c_{f.name}": compare(f.kind, *cells[f.name], f.tolerance, f.threshold, ready=True, values=values.get(f.name)) for f in fields})
    rows = []
    for f in fields:
        (p, t), c = cells[f.name], F.col(f"_c_{f.name}")
        rows.append(F.struct(F.lit(f.name).alias("field"), field_state(p, t, c["match"], ready=True).alias("state"), c["exact"].alias("exact"), c["match"].alias("match"), c["note"].alias("note"), is_blank(t, ready=True).alias("blank")))
    return paired.select(key, *keep, F.explode(F.array(*rows)).alias("r")).select(key, *keep, "r.*")


def summary() -> list[Column]:
    """Counters and rates over rows of long_pairs."""
    n, match, blank = F.count("*"), F.count_if("match"), F.count_if(F.col("match") & F.col("blank"))
    return [
        n.alias("n"), F.count_if("exact").alias("exact"), match.alias("match"), F.count_if("blank").alias("blank"),
        F.count_if(F.col("state") == "missed").alias("missing"), F.count_if(F.col("state") == "fabricated").alias("spurious"),
        rate(match, n).alias("accuracy"), rate(match - blank, n - F.count_if("blank")).alias("accuracy_nonblank"),
    ]


def by_slice(rows: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """One pass over all dimensions: grouping sets, one for each."""
    out = rows.groupingSets([[d] for d in dimensions], *dimensions).agg(*summary(), *(F.grouping(d).alias(f"_g_{d}") for d in dimensions))
    dim, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dimensions:
        dim, name = F.when(F.col(f"_g_{d}") == 0, d).otherwise(dim), F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(name)
    return out.select(dim.alias("dimension"), name.alias("slice"), "n", "exact", "match", "blank", "missing", "spurious", "accuracy", "accuracy_nonblank")


def contaminated(value: Column, siblings: list[Column]) -> Column:
    """A value of four characters or more that another field of the record has, too."""
    text = F.lower(F.trim(value))
    return (F.length(text) >= 4) & F.exists(F.array(*[F.lower(F.trim(s)) for s in siblings]), lambda s: s == text)


def _readings(field: Field, value: Column) -> dict[str, Column]:
    """What a field is compared by: a form that is null where the value is blank, or a value `v` and, where there is none, its text `u`."""
    raw, kind = value.cast("string"), field.kind
    if kind in READ:
        v = READ[kind](raw)
        if kind in ("money", "number"):  # most are plain numbers, and need no patterns
            v = F.when(raw.rlike(r"^-?[0-9]+(?:\.[0-9]+)?\z"), raw.try_cast("double")).otherwise(v)
        return {f"{field.name}_v": F.unix_date(v) if kind == "date" else v.cast("int") if kind == "bool" else v, f"{field.name}_u": F.when(v.isNull(), F.nullif(clean(raw), F.lit("")))}
    if kind == "email":
        return {f"{field.name}_s": F.nullif(F.lower(clean(raw)), F.lit(""))}
    # These drop or collapse white space themselves.
    form = {"identifier": normalise_identifier, "enum": normalise_identifier, "name": normalise_name}.get(kind, digits_only if kind in ("ssn", "ein", "phone", "account") else normalise_text)(raw, ready=True)
    return {f"{field.name}_s": F.when((form != "") | ~is_blank(raw), form)}


def _read_rows(rows: Column, fields: tuple[Field, ...]) -> Column:
    """A group's rows as their index and the readings of their fields, made once for each row rather than for each pair."""
    return F.transform(rows, lambda x, i: F.struct(i.alias("i"), *(c.alias(n) for f in fields for n, c in _readings(f, x[f.name]).items())))


def _scores(t, p, at_t, at_p, fields: tuple[Field, ...]):
    """Scores of pairs of rows: weight of matching fields over that of all; t, p: readings by name, as numpy arrays, `_s` and `_u` as codes."""
    good, total = np.zeros(len(at_t)), 0.0
    for f in fields:
        w = KEY_WEIGHT if f.key else 1.0
        if f.kind in READ:
            x, y = p[f"{f.name}_v"][at_p], t[f"{f.name}_v"][at_t]
            lost_x, lost_y = p[f"{f.name}_n"][at_p], t[f"{f.name}_n"][at_t]
            if f.kind in ("money", "number"):
                with np.errstate(invalid="ignore"):
                    same = np.abs(x - y) <= (MONEY_TOLERANCE if f.tolerance is None else f.tolerance)
            else:
                same = x == y
            match = np.where(lost_x | lost_y, lost_x & lost_y & (p[f"{f.name}_u"][at_p] == t[f"{f.name}_u"][at_t]), same)
        else:
            x, y = p[f"{f.name}_s"][at_p], t[f"{f.name}_s"][at_t]
            match = x == y
            if f.kind not in EQUAL:
                words = t[f"{f.name}_w"]
                least = f.threshold if f.threshold is not None else NAME_THRESHOLD if f.kind == "name" else TEXT_THRESHOLD
                open_ = np.flatnonzero(~match & (x >= 0) & (y >= 0))
                if match.any() and least > 1:
                    match &= x < 0
                some, back = np.unique(x[open_].astype(np.int64) * len(words) + y[open_], return_inverse=True)
                close = np.array([gestalt(words[c // len(words)], words[c % len(words)]) >= least for c in some.tolist()], dtype=bool)
                match[open_] = close[back]
        good, total = good + np.where(match, w, 0.0), total + w
    return good / total


def _greedy(doc, score, t, p):
    """Places of the pairs of a greedy one-to-one matching inside each document, best first, ties by index, in that order.

    A pair that comes first among those left of both its rows is part of it, so many are found at once.
    """
    order = np.lexsort((p, t, -score, doc))
    tid, pid = (np.unique(doc * (x.max(initial=0) + 1) + x, return_inverse=True)[1][order] for x in (t, p))
    kept, left = [], np.arange(len(order))
    while len(left):
        n, a, b = len(left), tid[left], pid[left]
        first_t, first_p = np.empty(a.max() + 1, dtype=np.int64), np.empty(b.max() + 1, dtype=np.int64)
        at = np.arange(n)[::-1]
        first_t[a[::-1]], first_p[b[::-1]] = at, at  # the last one written, that is the first, stays
        won = (first_t[a] == np.arange(n)) & (first_p[b] == np.arange(n))
        used_t, used_p = np.zeros(len(first_t), dtype=bool), np.zeros(len(first_p), dtype=bool)
        used_t[a[won]], used_p[b[won]] = True, True
        kept.append(left[won])
        left = left[~used_t[a] & ~used_p[b]]
    return order[np.sort(np.concatenate(kept))] if kept else order


def _decoded(found: dict[str, pa.Array], other: dict[str, pa.Array]) -> tuple[dict, dict]:
    """Readings of both sides by name as numpy arrays; strings by codes common to both, -1 for nulls, and their words under `_w`."""
    out = ({}, {})
    for name, x in found.items():
        y = other[name]
        if name.endswith("_v"):
            for side, c in zip(out, (x, y), strict=True):
                side[name], side[f"{name[:-2]}_n"] = c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)
        else:
            codes = pa.concat_arrays([x, y]).dictionary_encode()
            at = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            out[0][name], out[1][name] = at[: len(x)], at[len(x) :]
            if name.endswith("_s"):
                out[0][f"{name[:-2]}_w"] = codes.dictionary.to_pylist() if len(codes.dictionary) else []
    return out


def _pairs_of(batch: pa.RecordBatch, fields: tuple[Field, ...], most: int = 1 << 20) -> pa.Array:
    """For each row of a batch with lists of readings `_t` and `_p`: its list of (t, p, score)."""
    sides, sizes, readings = [], [], []
    for name in ("_t", "_p"):
        lists = batch.column(name)
        sizes.append(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        flat = lists.flatten()
        sides.append(flat.field("i").to_numpy(zero_copy_only=False).astype(np.int64))
        readings.append({f.name: flat.field(f.name) for f in flat.type if f.name != "i"})
    t, p = _decoded(*readings)
    # Every row of the truth with all predicted ones of its document, some at a time.
    doc = np.repeat(np.arange(batch.num_rows), sizes[0])
    begin, many = (np.cumsum(sizes[1]) - sizes[1])[doc], sizes[1][doc]
    ends, found, i = np.cumsum(many), [], 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        n = many[i:j]
        at_t = np.repeat(np.arange(i, j), n)
        at_p = np.arange(len(at_t)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[i:j], n)
        score = _scores(t, p, at_t, at_p, fields)
        good = np.flatnonzero(score >= ROW_FLOOR)
        found.append((at_t[good], at_p[good], score[good]))
        i = j
    at_t, at_p, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    ti, pi = sides[0][at_t], sides[1][at_p]
    keep = _greedy(doc[at_t], score, ti, pi)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[at_t[keep]], minlength=batch.num_rows))])
    rows = pa.StructArray.from_arrays([pa.array(ti[keep], pa.int32()), pa.array(pi[keep], pa.int32()), pa.array(score[keep])], ["t", "p", "score"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def _matched(both: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """both without its lists of readings `_t` and `_p`, and with `pairs`: array<struct<t, p, score>>, greedy one-to-one, best first, ties by index."""
    names = [c for c in both.columns if c not in ("_t", "_p")]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _pairs_of(batch, fields)], [*names, "pairs"])

    ship(both.sparkSession)
    if not fields:
        return both.select(*names, F.array().cast(PAIRS).alias("pairs"))
    return both.mapInArrow(run, T.StructType([*(both.schema[c] for c in names), T.StructField("pairs", T._parse_datatype_string(PAIRS))]))


def match_sides(df: DataFrame, fields: tuple[Field, ...], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """df with the matched `pairs` of the rows of its two array columns, which go, and the sizes of these, `t` and `p`.

    For tables that have both sides of a document in one row: nothing is joined, nor shuffled.
    """
    keep = [c for c in df.columns if c not in (truth, predicted)]
    size = lambda c: F.coalesce(F.size(F.when(F.col(c).isNotNull(), F.col(c))), F.lit(0)).cast("bigint")
    return _matched(df.select(*keep, size(truth).alias("t"), size(predicted).alias("p"), _read_rows(F.col(truth), fields).alias("_t"), _read_rows(F.col(predicted), fields).alias("_p")), fields)


def match_rows(truth: DataFrame, predicted: DataFrame, fields: tuple[Field, ...], key: str = "file", group: str = "line_items") -> DataFrame:
    """(key, t, p, score): greedy one-to-one pairs, best first, ties by index.

    Pairs exist only inside one document's group, and only in the Python worker, a bounded number at a time.
    """
    # Rows of documents that share a key are matched together, by their index.
    side = lambda df, name: df.select(key, _read_rows(F.col(group), fields).alias("_r")).groupBy(key).agg(F.flatten(F.collect_list("_r")).alias(name))
    both = side(truth, "_t").join(side(predicted, "_p"), key)
    return _matched(both, fields).select(key, F.inline("pairs"))


def detection(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per tag: tp, fp, fn, precision, recall, f1 of two arrays of tags."""
    tags = lambda c, what: F.transform(c, lambda x: F.struct(x.alias("tag"), F.lit(what).alias("what")))
    t, p = F.array_distinct(F.coalesce(truth, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(predicted, F.array().cast("array<string>")))
    rows = df.select(F.explode(F.concat(tags(F.array_intersect(t, p), "tp"), tags(F.array_except(p, t), "fp"), tags(F.array_except(t, p), "fn"))).alias("r")).select("r.*")
    out = rows.groupBy("tag").agg(*(F.count_if(F.col("what") == w).alias(w) for w in ("tp", "fp", "fn")))
    pr, rc = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.select("tag", "tp", "fp", "fn", F.round(pr, 4).alias("precision"), F.round(rc, 4).alias("recall"), F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4).alias("f1"))


def field_scores(rows: DataFrame, by: tuple[str, ...] = ("field",), copied: str | None = None, top: int = 3) -> DataFrame:
    """Per field: counters, accuracy, presence (is there a value at all?) and the commonest notes of recoveries.

    rows: long_pairs, and `copied`, a boolean column: the value is also that of another field (`contaminated`).
    Notes are counted before they are gathered, so a list has one entry for each note's first word.
    """
    note, both = F.split_part("note", F.lit(" "), F.lit(1)), F.col("match") & F.col("blank")
    spurious = F.col("state") == "fabricated"
    recovered = F.col("match") & ~F.col("exact") & ~F.col("blank") & (note != "")
    per = rows.groupBy(*by, F.when(recovered, note).alias("_note")).agg(
        F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.count_if("match").alias("match"), F.count_if(both).alias("blank"),
        F.count_if(F.col("state") == "missed").alias("missing"), F.count_if(spurious).alias("spurious"),
        F.count_if(spurious & F.coalesce(F.col(copied) if copied else F.lit(False), F.lit(False))).alias("contaminated"),
    )
    counters = ("n", "exact", "match", "blank", "missing", "spurious", "contaminated")
    seen = F.array_sort(F.collect_list(F.when(F.col("_note").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("_note").alias("note")))))
    out = per.groupBy(*by).agg(seen.alias("_seen"), *(F.sum(c).alias(c) for c in counters))
    c = {x: F.col(x) for x in counters}
    absent = c["blank"] + c["spurious"]
    present, found, correct = c["n"] - absent, c["n"] - absent - c["missing"], c["match"] - c["blank"]
    return out.select(
        *by, *counters, (c["match"] - c["exact"]).alias("recovered_by_normalisation"), absent.alias("n_absent"), present.alias("n_present"),
        rate(c["match"], c["n"]).alias("accuracy"), rate(correct, c["n"] - c["blank"]).alias("accuracy_nonblank"),
        rate(c["blank"] + found, c["n"]).alias("presence_accuracy"), rate(correct, found + c["spurious"]).alias("precision_populated"), rate(correct, present).alias("recall_present"),
        rate(c["spurious"], absent).alias("false_positive_rate"), rate(c["contaminated"], absent).alias("contamination_rate"),
        F.transform(F.slice("_seen", 1, top), lambda x: F.struct(x["note"].alias("note"), (-x["m"]).alias("n"))).alias("notes"),
    )


def abstention(scores: DataFrame, by: tuple[str, ...] = ("field",)) -> DataFrame:
    """The fields that some documents omit, those invented most often first."""
    rows = scores.where("n_absent > 0").select(*by, "n_absent", "n_present", "presence_accuracy", "precision_populated", "false_positive_rate", "contamination_rate")
    return rows.orderBy(F.coalesce("false_positive_rate", F.lit(0.0)).desc(), *by)


def group_scores(truth: DataFrame, predicted: DataFrame, matched: DataFrame, key: str = "file", group: str = "line_items", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a repeating group in truth, predictions and `match_rows`' pairs: precision, recall, F1.

    `by`: columns of the truth to report by.  Only counts are joined, one row for each document.
    """
    size = lambda df: F.coalesce(F.size(F.when(df[group].isNotNull(), df[group])), F.lit(0)).cast("bigint")
    t = truth.select(F.col(key).alias("_k"), *by, size(truth).alias("t"))
    p = predicted.select(F.col(key).alias("_p"), size(predicted).alias("p"))
    m = matched.groupBy(F.col(key).alias("_m")).agg(F.count("*").alias("m"))
    rows = t.join(p, F.col("_k") == F.col("_p"), "left").join(m, F.col("_k") == F.col("_m"), "left")
    return row_totals(rows, by)


def row_totals(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F1 of rows from the numbers t, p and m (truth, predicted, matched) of each document."""
    out = rows.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("t", "truth_rows"), ("p", "predicted_rows"), ("m", "matched_rows"))))
    hit, t, p = F.col("matched_rows"), F.col("truth_rows"), F.col("predicted_rows")
    return out.select(*by, "truth_rows", "predicted_rows", "matched_rows", rate(hit, p).alias("row_precision"), rate(hit, t).alias("row_recall"), rate(2 * hit, p + t).alias("row_f1"))


def weights(fields: tuple[Field, ...], name: Column) -> Column:
    """The declared weight of a field by its name; 1 for fields that are not declared."""
    known = [x for f in fields for x in (F.lit(f.name), F.lit(f.weight))]
    return F.coalesce(F.try_element_at(F.create_map(*known), name), F.lit(1.0)) if known else F.lit(1.0)
