"""Total-order ranking: bounded lists that disclose what they leave out, chunks, shards, shares.

Every order ends in a unique key, so results don't depend on partitioning. Windows without a
partition key are avoided: totals come from an aggregate, top lists from TakeOrdered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group. Spark drops later rows before the shuffle (WindowGroupLimit)."""
    ranked = df.withColumn(rank or "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank or "_rn") <= n)
    return ranked if rank else ranked.drop("_rn")


def bounded(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first limit rows, with total_count, included_count and truncated on each."""
    total = df.agg(F.count("*").alias("total_count"))  # one row: broadcast
    included = F.least(F.col("total_count"), F.lit(limit).cast("long"))
    top = df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))
    return top.withColumns({"included_count": included, "truncated": F.col("total_count") > limit})


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Adds total, the sum over all rows, as numerator and denominator of a share."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("total"))))


def chunked(df: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """Adds chunk: equal-sized pieces of each group in order."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size))


def sharded(df: DataFrame, group: str, order: list[Column], shards: int) -> DataFrame:
    """Adds shard: sizes differ by one at most and order is kept."""
    return df.withColumn("shard", F.ntile(shards).over(Window.partitionBy(group).orderBy(*order)))


def head_tail(df: DataFrame, group: str, order: list[Column], most: int, head: int) -> DataFrame:
    """All rows of groups of at most most rows; of others the first head and the last most - head."""
    w = Window.partitionBy(group)
    ranked = df.withColumns({"_rn": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    return ranked.filter((F.col("_n") <= most) | (F.col("_rn") <= head) | (F.col("_rn") > F.col("_n") - (most - head))).drop("_rn", "_n")


def budgeted(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Adds taken: rows in order are taken while they fit in what is left of the group's budget; one that doesn't fit is skipped.

    The fold depends on its own outcome, so it is not a window. Groups are dealt out and sorted, and a task streams over
    them: its state is what is left of one group's budget, whatever the group's size.
    """
    schema = StructType([*df.select(group, order, size).schema, StructField("taken", BooleanType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = object(), budget
        for batch in batches:
            taken = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    now, left = key, budget
                fits = n is not None and n <= left
                left -= n if fits else 0
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], schema=pa.schema([*batch.schema, pa.field("taken", pa.bool_())]))

    return df.select(group, order, size).repartition(group).sortWithinPartitions(group, order).mapInArrow(fold, schema)


def with_grand_total(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Sums for each key and, in the row with is_total, of all: one aggregation whose partial sums come before the shuffle."""
    return df.rollup(key).agg((F.grouping(key) == 1).alias("is_total"), F.count("*").alias("rows"), *[F.sum(c).alias(name) for name, c in sums.items()])
