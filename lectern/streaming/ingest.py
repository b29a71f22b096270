"""File streams: predictions appended once, documents routed as they come, events by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.route import decide


def append_once(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """New files of predictions appended to a table; a restart goes on where the checkpoint stands."""
    return sink_once(spark.readStream.schema(schema).format(fmt).load(source), sink, checkpoint)


def sink_once(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """All that has come so far, appended to a Parquet table; files and offsets are committed together, so nothing is written twice."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed(stream: DataFrame, signals: dict, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The routing decision as a stateless stream."""
    return decide(stream, signals, thresholds)


def reviewed(outcomes: DataFrame, queue: DataFrame, key: str = "file") -> DataFrame:
    """A stream of review outcomes joined to the queue as it stands: a row for each field the reviewer was sure of."""
    rows = outcomes.join(queue.select(key, "selection"), key).select(key, "selection", F.explode("fields").alias("f"))
    return rows.where(F.col("f.action") != "unsure").select(key, "selection", F.col("f.field").alias("field"), (F.col("f.action") == "confirmed").alias("correct"))


def windowed(stream: DataFrame, at: str, width: str, late: str, by: tuple[str, ...], value: str) -> DataFrame:
    """Counts and sums by event time; windows close once the watermark passes them, and later rows are dropped."""
    w = F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")
