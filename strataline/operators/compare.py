"""Comparison of two snapshots and exactly-once accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_diff(base: DataFrame, candidate: DataFrame, key: list[str], fields: list[str], outcome: list[str]) -> DataFrame:
    """Key and change (added, removed, changed, reclassified) of rows that differ: one full outer join.

    A change is a reclassification if only outcome fields differ.
    """
    b = base.select(*key, F.struct(*fields).alias("b"))
    c = candidate.select(*key, F.struct(*fields).alias("c"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"c.{f}")), f) for f in fields]))
    both = b.join(c, key, "full_outer").withColumn("diff_fields", differs)
    change = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").when(F.size(F.array_except("diff_fields", F.array(*map(F.lit, outcome)))) == 0, "reclassified").otherwise("changed")
    return both.filter(F.col("b").isNull() | F.col("c").isNull() | (F.size("diff_fields") > 0)).select(*key, change.alias("change"))


def rowset_diff(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Distinct rows that only one side has, with side."""
    return base.subtract(candidate).withColumn("side", F.lit("removed")).unionByName(candidate.subtract(base).withColumn("side", F.lit("added")))


def set_drift(base: DataFrame, candidate: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose sets of values differ, with both sets sorted."""
    sets = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
    return sets(base, "base_values").join(sets(candidate, "candidate_values"), key, "full_outer").filter(~F.col("base_values").eqNullSafe(F.col("candidate_values")))


def exactly_once(universe: DataFrame, disposed: DataFrame, key: str) -> DataFrame:
    """Violations: keys of the universe without exactly one row in disposed, and disposed keys that aren't in it. Empty if all is well."""
    left = universe.select(key).distinct().withColumn("known", F.lit(True))
    right = disposed.groupBy(key).agg(F.count("*").alias("n"))
    fault = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return left.join(right, key, "full_outer").select(key, fault.alias("fault")).filter("fault is not null")


def violations(*checks: tuple[str, DataFrame]) -> DataFrame:
    """check, violations, passed: each check is a query that must be empty."""
    out = None
    for name, df in checks:
        row = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def worst(status: str | Column, order: dict[str, int], empty: str) -> Column:
    """Aggregate: the worst status by order; empty for no rows."""
    column = F.col(status) if isinstance(status, str) else status
    severity = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.max_by(column, severity[column]), F.lit(empty))
