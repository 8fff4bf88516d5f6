"""Replay of an append-only event log into task states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(log: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds name: the last non-null value up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn(name, F.last(value, ignorenulls=True).over(w))


def generations(log: DataFrame, key: str, order: list[str], starts) -> DataFrame:
    """Adds generation: how many starting events there were up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("generation", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def replay(log: DataFrame, key: str, order: list[str], event: str, *, created: str, claimed: str, validated: str, failed: str, most_attempts: int) -> DataFrame:
    """key, generation, attempts, claims, done, exhausted, state of each task's latest generation."""
    rows = generations(log, key, order, F.col(event) == created)
    w = Window.partitionBy(key)
    latest = rows.withColumn("_g", F.max("generation").over(w)).filter("generation = _g")
    out = latest.groupBy(key).agg(
        F.max("generation").alias("generation"), F.count_if(F.col(event) == failed).alias("attempts"), F.count_if(F.col(event) == claimed).alias("claims"), F.max(F.col(event) == validated).alias("done")
    )
    out = out.withColumn("exhausted", ~F.col("done") & (F.col("attempts") >= most_attempts))
    state = F.when(F.col("generation") == 0, "unknown").when(F.col("done"), "done").when(F.col("exhausted"), "exhausted").when(F.col("claims") > F.col("attempts"), "claimed").otherwise("open")
    return out.withColumn("state", state)


def readiness(tasks: DataFrame, dependencies: DataFrame, key: str, needs: str) -> DataFrame:
    """key, is_ready: all that it needs is done."""
    state = tasks.select(F.col(key).alias(needs), F.col("done").alias("_done"))
    joined = tasks.select(key).join(dependencies, key, "left").join(state, needs, "left")
    return joined.groupBy(key).agg(F.bool_and(F.col(needs).isNull() | F.coalesce("_done", F.lit(False))).alias("is_ready"))
