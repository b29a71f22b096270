"""Fingerprints and stamps: may two results stand in one table?"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVALUATION = "1"


def fingerprint(parts: Iterable[str | bytes]) -> str:
    """Sixteen hex digits over parts, each closed by a zero byte; the driver's form of `sampling.digest`."""
    whole = b"".join((p if isinstance(p, bytes) else str(p).encode()) + b"\0" for p in parts)
    return hashlib.sha256(whole).hexdigest()[:16]


def content_fingerprint(files: DataFrame, name: str, content: str) -> DataFrame:
    """(members, bytes, missing, fingerprint) of named contents, by name: whether expected answers or inputs changed.

    A null content is a missing file.  Names are hashed to 256 parts first, so no task holds all of them.
    """
    row = F.struct(F.col(name).cast("string").alias("n"), F.sha2(F.col(content).cast("binary"), 256).alias("h"))
    rows = files.where(F.col(name).isNotNull()).select(row.alias("r"), F.length(F.col(content).cast("binary")).alias("b")).withColumn("p", F.substring(F.sha2("r.n", 256), 1, 2))
    held = F.array_sort(F.collect_list(F.when(F.col("r.h").isNotNull(), F.col("r"))))
    part = rows.groupBy("p").agg(
        F.sha2(F.array_join(F.transform(held, lambda x: F.concat(x["n"], F.lit("\0"), x["h"])), "\0"), 256).alias("h"), F.count("*").alias("k"), F.sum("b").alias("b"), F.count_if(F.col("r.h").isNull()).alias("m")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: F.concat(s["p"], s["h"])), "\0")
    return part.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("members"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing"), F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def stamp(labels: str | None = None, cohort: str | None = None, inputs: str | None = None, documents: int | None = None, pipeline: Mapping | None = None, code: str | None = None) -> dict:
    """What has to be known later to compare a result; what was not captured is left out."""
    corpus = {"label": labels, "document_set": cohort, "input": inputs, "document_count": documents}
    out = {"evaluation_version": EVALUATION, "code": code, "corpus": {k: v for k, v in corpus.items() if v is not None}}
    if pipeline:
        out["pipeline"] = fingerprint([json.dumps(pipeline, sort_keys=True, default=str)])
    return {k: v for k, v in out.items() if v}


def comparable(one: Mapping | None, two: Mapping | None) -> tuple[bool, str, str]:
    """(yes or no, why not, a note).  Whatever is unknown or differs in meaning, answers or cohort refuses; other bytes are a note only."""
    if not one or not two:
        return False, "a result has no stamp", ""
    if one.get("evaluation_version") != two.get("evaluation_version"):
        return False, "the evaluations are of different versions", ""
    a, b = one.get("corpus", {}), two.get("corpus", {})
    for part, why in (("label", "the expected answers differ"), ("document_set", "the cohorts differ")):
        if a.get(part) != b.get(part):
            return False, why, ""
    moved = a.get("input") and b.get("input") and a["input"] != b["input"]
    return True, "", "the same documents with other bytes" if moved else ""


def describe(stamped: Mapping | None) -> str:
    if not stamped:
        return "unstamped: not comparable"
    corpus = stamped.get("corpus", {})
    bits = [f"evaluation {stamped.get('evaluation_version', '?')}", f"code {stamped.get('code') or '?'}"]
    bits += [f"{name} {corpus[k]}" for k, name in (("label", "labels"), ("document_set", "cohort"), ("document_count", "documents")) if k in corpus]
    return ", ".join(bits)
