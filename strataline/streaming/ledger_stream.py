"""The ledger's replay as a stream: running counts of each task, kept in Spark's state store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_states(events: DataFrame, key: str, event: str, names: list[str]) -> DataFrame:
    """A streaming aggregate: how often each named event was seen for each task. Order-free, so late rows need no watermark."""
    return events.groupBy(key).agg(*[F.count_if(F.col(event) == n).alias(n) for n in names], F.count("*").alias("events"))


def start(events: DataFrame, key: str, event: str, names: list[str], table: str, checkpoint: str):
    """Writes running_states to an in-memory table for as long as the query runs."""
    out = running_states(events, key, event, names)
    return out.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
