"""Cluster lanes over candidates, and the partition plan built from them.

Clusters are long: a row for each member, never a list of all of them in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.graph import connected_components


def sharing(members: DataFrame, keys: list[str], member: str, least: int = 2) -> DataFrame:
    """keys, member, size: distinct members of each key that has at least so many of them."""
    distinct = members.select(*keys, member).distinct()
    sizes = distinct.groupBy(*keys).agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return distinct.join(sizes, keys)


def bridged_pairs(edges: DataFrame, bridge: DataFrame, src: str, dst: str, node: str, owner: str) -> DataFrame:
    """Distinct (owner_a, owner_b) of different owners at the two ends of an edge."""
    a = bridge.select(F.col(node).alias(src), F.col(owner).alias("owner_a"))
    b = bridge.select(F.col(node).alias(dst), F.col(owner).alias("owner_b"))
    return edges.select(src, dst).distinct().join(a, src).join(b, dst).filter("owner_a <> owner_b").select("owner_a", "owner_b").distinct()


def linked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """component, id, size of the components of pairs."""
    found = connected_components(pairs, a, b)
    return found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component")


def owners_by_store(touches: DataFrame, stores: DataFrame, bridge: DataFrame, file: str, store: str, node: str, owner: str) -> DataFrame:
    """store, owner, size: owners that reach a store through a file or own the store itself, where there are two or more."""
    by_file = touches.select(file, store).join(bridge.select(F.col(node).alias(file), owner), file).select(store, owner)
    own = stores.select(store).join(bridge.select(F.col(node).alias(store), owner), store).select(store, owner)
    return sharing(by_file.unionByName(own), [store], owner)


def partition_plan(candidates: DataFrame, links: DataFrame, key: str, repo: str, root: str, a: str, b: str, size: int = 16) -> DataFrame:
    """key, repo, component, chunk: candidates of a repository that share a root or are linked, in chunks of size by key.

    Links between repositories merge nothing; see boundary_links.
    """
    repos = candidates.select(key, repo)
    ends = links.join(repos.select(F.col(key).alias(a), F.col(repo).alias("_ra")), a).join(repos.select(F.col(key).alias(b), F.col(repo).alias("_rb")), b)
    first = candidates.groupBy(repo, root).agg(F.min(key).alias("_first"))
    by_root = candidates.join(first, [repo, root]).select(F.col(key).alias(a), F.col("_first").alias(b))
    found = connected_components(by_root.unionByName(ends.filter("_ra = _rb").select(a, b)), a, b)
    joined = repos.join(found.select(F.col("id").alias(key), "component"), key)
    return joined.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("component").orderBy(key)) - 1) / size))


def boundary_links(plan: DataFrame, links: DataFrame, key: str, repo: str, a: str, b: str) -> DataFrame:
    """component_a, chunk_a, component_b, chunk_b, crosses, links: pairs of different partitions that links connect."""
    side = lambda end, n: plan.select(F.col(key).alias(end), F.col("component").alias(f"component_{n}"), F.col("chunk").alias(f"chunk_{n}"), F.col(repo).alias(f"_r{n}"))
    both = links.join(side(a, "a"), a).join(side(b, "b"), b).filter("component_a <> component_b or chunk_a <> chunk_b")
    low, high = F.struct("component_a", "chunk_a", "_ra"), F.struct("component_b", "chunk_b", "_rb")
    ordered = F.array_sort(F.array(_plain(low, "a"), _plain(high, "b")))
    rows = both.select(ordered[0].alias("x"), ordered[1].alias("y"))
    crosses = F.bool_or(F.col("x.r") != F.col("y.r")).alias("crosses")
    named = [F.col(f"{s}.{f}").alias(f"{'component' if f == 'c' else 'chunk'}_{n}") for s, n in (("x", "a"), ("y", "b")) for f in ("c", "k")]
    return rows.groupBy(*named).agg(crosses, F.count("*").alias("links"))


def _plain(s: Column, n: str) -> Column:
    return F.struct(s[f"component_{n}"].alias("c"), s[f"chunk_{n}"].alias("k"), s[f"_r{n}"].alias("r"))


def containment(paths: DataFrame, roots: DataFrame, path: str, root: str, owner: str) -> DataFrame:
    """path, owner, matches, status: the owner of the root that holds a path; null if none or several do.

    Paths are expanded to their own prefixes, so that the join is by equality.
    """
    from strataline.functions.text import all_prefixes

    steps = paths.select(path).distinct().withColumn(root, F.explode(all_prefixes(F.col(path))))
    hits = steps.join(roots.select(root, owner), root).groupBy(path).agg(F.count_distinct(owner).alias("matches"), F.min(owner).alias("_one"))
    joined = paths.select(path).distinct().join(hits, path, "left")
    n = F.coalesce("matches", F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return joined.select(path, F.when(n == 1, F.col("_one")).alias(owner), n.alias("matches"), status.alias("status"))


def nested_roots(roots: DataFrame, root: str, owner: str) -> DataFrame:
    """Distinct (outer, inner) owners of roots of which one holds the other, equal ones once."""
    from strataline.functions.text import all_prefixes

    inner = roots.select(F.col(owner).alias("inner"), F.col(root).alias("_path"), F.explode(all_prefixes(F.col(root))).alias(root))
    pairs = inner.join(roots.select(root, F.col(owner).alias("outer")), root)
    return pairs.filter((F.col("outer") != F.col("inner")) & ((F.col(root) != F.col("_path")) | (F.col("outer") < F.col("inner")))).select("outer", "inner").distinct()
