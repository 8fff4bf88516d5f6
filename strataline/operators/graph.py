"""Property-graph operators: merging, resolution, tallies, components, cascades, cycles, matching.

Iterative operators checkpoint each round, so lineage stays short and a lost executor costs one
round; only their convergence counts reach the driver.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> None:
    """Makes checkpoint() usable: with spark.checkpoint.dir, or, in local mode only (tests), a temporary folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp())


def merge_nodes(nodes: DataFrame, key: str, seq: str, scalars: list[str], sets: list[str]) -> DataFrame:
    """One row for each key: the first non-empty scalar in seq order, the sorted union of each set."""
    filled = [F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(seq))).alias(c) for c in scalars]
    return nodes.groupBy(key).agg(*filled, *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets])


def resolve_edges(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """Adds status: resolved, or unresolved where an end is no node. No edge is lost."""
    ids = nodes.select(node).distinct()
    a, b = ids.select(F.col(node).alias(src), F.lit(True).alias("_s")), ids.select(F.col(node).alias(dst), F.lit(True).alias("_d"))
    joined = edges.join(a, src, "left").join(b, dst, "left")
    return joined.withColumn("status", F.when(F.col("_s").isNull() | F.col("_d").isNull(), "unresolved").otherwise("resolved")).drop("_s", "_d")


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """id, degree: in plus out; a self-loop counts twice."""
    return edges.select(F.explode(F.array(src, dst)).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def tallies(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n for each column: one pass over unpivoted values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """id, component (its smallest id), by minimum labels with pointer jumping: rounds grow with the logarithm of a path's length."""
    ready(edges.sparkSession)
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("m"))
        low = labels.join(near, "u").select("u", F.least("l", "m").alias("l"))
        jumped = low.join(labels.select(F.col("u").alias("l"), F.col("l").alias("ll")), "l").select("u", F.least("l", "ll").alias("l")).checkpoint()
        if jumped.join(labels.withColumnRenamed("l", "old"), "u").filter("l <> old").isEmpty():
            return jumped.select(F.col("u").alias("id"), F.col("l").alias("component"))
        labels = jumped


def cascade(edges: DataFrame, start: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """All keys reachable from start along src -> dst, start included: frontiers with an anti join, until none is new."""
    ready(edges.sparkSession)
    links = edges.select(F.col(src).alias(key), F.col(dst).alias("_next")).distinct().checkpoint()
    found = start.select(F.col(key)).distinct().checkpoint()
    front, rounds = found, 0
    while True:
        front = links.join(front, key).select(F.col("_next").alias(key)).distinct().join(found, key, "left_anti").checkpoint()
        if front.isEmpty():
            return found
        found, rounds = found.unionByName(front), rounds + 1
        if rounds % 8 == 0:  # few enough parts to scan, few enough rounds to lose
            found = found.coalesce(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))).checkpoint()


def canonical_cycles(cycles: DataFrame, members: str) -> DataFrame:
    """Distinct cycles, rotated to begin with their smallest member."""
    a, p = F.col(members), F.array_position(members, F.array_min(members)).cast("int")
    return cycles.select(F.concat(F.slice(a, p, F.size(a)), F.slice(a, F.lit(1), p - 1)).alias("cycle")).distinct()


def topological_levels(edges: DataFrame, before: str, after: str) -> DataFrame:
    """id, level: the longest chain of predecessors. Peels one level a round; raises on a cycle."""
    ready(edges.sparkSession)
    left = edges.select(F.col(before).alias("b"), F.col(after).alias("a")).distinct().checkpoint()
    nodes = left.select(F.explode(F.array("a", "b")).alias("id")).distinct().checkpoint()
    out, level = None, 0
    while not nodes.isEmpty():
        free = nodes.join(left.select(F.col("a").alias("id")).distinct(), "id", "left_anti").checkpoint()
        if free.isEmpty():
            raise ValueError("the dependencies have a cycle")
        rows = free.withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
        left = left.join(free.withColumnRenamed("id", "b"), "b", "left_anti").checkpoint()
        nodes, level = nodes.join(free, "id", "left_anti").checkpoint(), level + 1
    return out if out is not None else nodes.withColumn("level", F.lit(0))


def greedy_match(scored: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs by falling score, ties by the ids: in each round pairs that are best for both sides are taken.

    The best of each side is an aggregate, combined before the shuffle, so a side with very many pairs is no one task's.
    """
    ready(scored.sparkSession)
    rest, out = scored.select(left, right, score).checkpoint(), None
    rank = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    while out is None or not rest.isEmpty():
        best = lambda side: rest.groupBy(side).agg(F.min(rank).alias("_best")).select("_best.*")  # noqa: B023, E731
        both = best(left).intersect(best(right))
        taken = both.select(F.col("l").alias(left), F.col("r").alias(right), (-F.col("s")).alias(score)).checkpoint()
        out = taken if out is None else out.unionByName(taken)
        rest = rest.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti").checkpoint()
    return out


def group_topology(edges: DataFrame, owners: DataFrame, src: str, dst: str, item: str, group: str) -> DataFrame:
    """group_a < group_b, links: edges between items of different groups."""
    a, b = owners.select(F.col(item).alias(src), F.col(group).alias("_a")), owners.select(F.col(item).alias(dst), F.col(group).alias("_b"))
    joined = edges.join(a, src).join(b, dst).filter("_a <> _b")
    return joined.groupBy(F.least("_a", "_b").alias("group_a"), F.greatest("_a", "_b").alias("group_b")).agg(F.count("*").alias("links"))


def interval_overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str, lo: str, hi: str, width: int) -> DataFrame:
    """a_id, b_id, overlaps: pairs with intersecting [lo, hi] under equal keys, with how many.

    Intervals are laid over buckets of width; a pair is joined in the bucket where the later of them begins, so each is found once.
    """
    cut = lambda df, i, s: df.select(*keys, F.col(i).alias(f"{s}_id"), F.col(lo).alias(f"{s}_lo"), F.col(hi).alias(f"{s}_hi"), F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("_bucket"))
    joined = cut(a, a_id, "a").join(cut(b, b_id, "b"), [*keys, "_bucket"])
    meet = (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi")) & (F.col("_bucket") == F.floor(F.greatest("a_lo", "b_lo") / width))
    return joined.filter(meet).groupBy("a_id", "b_id").agg(F.count("*").alias("overlaps"))
