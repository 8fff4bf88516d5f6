"""Transaction-log analytics: churn, co-change coupling, ownership, roster, sampling, renames.

All take a log of (transaction, item, ...) rows and role names, so commits and files, or orders
and parts, are two bindings of the same operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.ranking import first_per_group


def churn(log: DataFrame, txn: str, item: str, added: str, deleted: str) -> DataFrame:
    """item, commits, added, deleted, total_lines: transactions counted once for each item."""
    once = log.groupBy(txn, item).agg(F.sum(added).alias("a"), F.sum(deleted).alias("d"))
    return once.groupBy(item).agg(F.count("*").alias("commits"), F.sum("a").alias("added"), F.sum("d").alias("deleted"), F.sum(F.col("a") + F.col("d")).alias("total_lines"))


def systematic_sample(txns: DataFrame, order: str, cap: int) -> DataFrame:
    """Evenly spaced transactions: positions floor(i * n / cap); all if there are no more than cap.

    Positions are counted within ranges of the order and offset by the ranges' sizes, so no task sees all rows.
    """
    ranged = txns.select(order).distinct().repartitionByRange(order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_part").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_before"))
    n = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    placed = ranged.join(F.broadcast(before), "_part").withColumn("_pos", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    # position p is kept if some i has floor(i * n / cap) = p
    kept = F.lit(n <= cap) | (F.floor((F.ceil(F.col("_pos") * cap / F.lit(n)).cast("long")) * F.lit(n) / cap) == F.col("_pos"))
    return placed.filter(kept).select(order)


def _sets(log: DataFrame, txn: str, item: str, bulk_limit: int) -> DataFrame:
    """txn, items (sorted, distinct), bulk. Of bulk transactions only bulk_limit + 1 items are gathered: enough to know them."""
    distinct = log.filter(F.col(item).isNotNull()).select(txn, item).distinct()
    few = first_per_group(distinct, [txn], [F.col(item)], bulk_limit + 1)
    return few.groupBy(txn).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("bulk", F.size("items") > bulk_limit)


def coupling(log: DataFrame, txn: str, item: str, *, min_shared: int, bulk_limit: int, sample_cap: int = 0) -> DataFrame:
    """item_a, item_b, shared, revs_a, revs_b of pairs that at least min_shared transactions touch together.

    Transactions of more than bulk_limit items make no pairs, so there are at most
    bulk_limit * (bulk_limit - 1) / 2 from each. Without sampling, revisions count all
    transactions, bulk ones too; in a sample, only those that made pairs.
    """
    sampled = bool(sample_cap)
    if sampled:
        log = log.join(systematic_sample(log, txn, sample_cap), txn, "left_semi")
    sets = _sets(log, txn, item, bulk_limit)
    small = sets.filter(~F.col("bulk"))
    items = F.col("items")
    pairs = F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("item_a"), b.alias("item_b")))))
    shared = small.select(F.inline(pairs)).groupBy("item_a", "item_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)
    own = small.select(F.explode("items").alias(item)) if sampled else log.filter(F.col(item).isNotNull()).select(txn, item).distinct()
    revs = own.groupBy(item).agg(F.count("*").alias("revs"))
    a, b = (revs.select(F.col(item).alias(f"item_{x}"), F.col("revs").alias(f"revs_{x}")) for x in "ab")
    return shared.join(a, "item_a").join(b, "item_b").select("item_a", "item_b", "shared", "revs_a", "revs_b")


def bulk_disclosure(log: DataFrame, txn: str, item: str, bulk_limit: int) -> DataFrame:
    """One row: transactions, and how many of them coupling leaves out as bulk."""
    return _sets(log, txn, item, bulk_limit).agg(F.count("*").alias("transactions"), F.count_if("bulk").alias("bulk_excluded"))


def top_group(path: Column) -> Column:
    """The first two parts of a path of more than two, else the first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def ownership(log: DataFrame, txn: str, item: str, actor: str, weight: str) -> DataFrame:
    """item, actors, commits, dominant_commits and dominant_weight with their actors: ties go to the smaller actor."""
    by = log.groupBy(txn, item, actor).agg(F.sum(weight).alias("w")).groupBy(item, actor).agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    w = Window.partitionBy(item)
    ranked = by.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("n"), actor)), "rw": F.row_number().over(w.orderBy(F.desc("w"), actor))})
    at = lambda c, r: F.max(F.when(F.col(r) == 1, F.col(c)))
    return ranked.groupBy(item).agg(
        F.count("*").alias("actors"), F.sum("n").alias("commits"), at(actor, "rn").alias("owner"), at("n", "rn").alias("owner_commits"), at(actor, "rw").alias("weight_owner"), at("w", "rw").alias("owner_weight")
    )


def roster(log: DataFrame, group: str, label: str, seq: str) -> DataFrame:
    """group, commits and the label of its last transaction."""
    return log.groupBy(group).agg(F.count("*").alias("commits"), F.max_by(label, seq).alias("display"))


def elect_label(log: DataFrame, group: str, label: str) -> DataFrame:
    """Each group's most frequent label, ties by the normalised then the plain label, with its votes."""
    votes = log.groupBy(group, label).agg(F.count("*").alias("votes"))
    return first_per_group(votes, [group], [F.desc("votes"), F.lower(label), F.col(label)])


def ambiguous_labels(log: DataFrame, group: str, label: str) -> DataFrame:
    """Labels that several groups use, with how many."""
    return log.select(group, label).distinct().groupBy(label).agg(F.count("*").alias("groups")).filter("groups > 1")


def _ends(step: DataFrame, rounds: int) -> DataFrame:
    """(name, next) with next after 2 ** rounds steps, or where the walk ends before: each round doubles the way."""
    for _ in range(rounds):
        ahead = step.select(F.col("name").alias("next"), F.col("next").alias("after"))
        step = step.join(ahead, "next", "left").select("name", F.coalesce("after", "next").alias("next")).checkpoint()
    return step


def rename_closure(renames: DataFrame, old: str, new: str, seq: str) -> DataFrame:
    """name, final: where each renamed item ends; the last rename of a name counts, a cycle ends where it first repeats.

    Rounds grow with the logarithm of the number of names. Where walks still go on after more steps than there are
    names, they stand on a cycle; its names are ends then, and themselves aren't renamed.
    """
    step = first_per_group(renames.filter(F.col(old) != F.col(new)), [old], [F.desc(seq)]).select(F.col(old).alias("name"), F.col(new).alias("next")).checkpoint()
    rounds = step.count().bit_length()
    found = _ends(step, rounds)
    cyclic = found.join(step.select(F.col("name").alias("next")), "next", "left_semi").select(F.col("next").alias("name")).distinct().checkpoint()
    if not cyclic.isEmpty():
        found = _ends(step.join(cyclic, "name", "left_anti"), rounds)
    return found.select("name", F.col("next").alias("final"))


def completeness(txns: DataFrame, at: str, merge: Column) -> DataFrame:
    """One row: how many transactions there are, how many of them merge, and the first and last day. No rows: zeros and nulls."""
    day = F.to_date(at).cast("string")
    return txns.agg(F.count("*").alias("total"), F.count_if(merge).alias("merges"), F.count_if(~merge | merge.isNull()).alias("others"), F.min(day).alias("oldest"), F.max(day).alias("newest"))
