"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


#: For the workers' allocators: give large freed arrays back to the system at once.
ALLOCATORS = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession | None = None) -> None:
    """Tell Python workers where this package is, in case they were started elsewhere, and keep them small."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    for name, value in ALLOCATORS.items():
        spark.sparkContext.environment.setdefault(name, value)
    root = str(Path(__file__).resolve().parents[1])
    given = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in given.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, given) if x)


def workspace(spark: SparkSession) -> str:
    """A new folder name for tables between steps: in the shared folder that the cluster names, else in a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("executors share no folder: set spark.checkpoint.dir")
        named = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="lectern-")
    return f"{named.rstrip('/')}/lectern-{uuid.uuid4().hex}"
