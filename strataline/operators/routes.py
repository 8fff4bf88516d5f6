"""Matching of frontend calls to backend routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.text import route_matches, segments


def _named(segs: Column) -> Column:
    return F.exists(segs, lambda s: s != "*")


def matched(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """Route rows with each call that they match, by columns r and c of segments.

    Both are expanded to their named segments with their places: a route and a call that match agree in one of them,
    so the join is on place and segment, not a cross join. Where that is common, such pairs are all compared.
    """
    first = lambda segs: F.filter(F.transform(segs, lambda s, i: F.struct(i.alias("at"), s.alias("s"))), lambda x: x["s"] != "*")
    r = routes.withColumn("r", segments(F.col("path"))).filter(_named(F.col("r"))).withColumn("_key", F.explode(first(F.col("r"))))
    c = calls.withColumn("c", segments(F.col("call_path"))).withColumn("_key", F.explode(first(F.col("c"))))
    return r.join(c, "_key").filter(route_matches(F.col("r"), F.col("c"))).drop("_key", "r", "c").distinct()


def attribute_bases(routes: DataFrame, calls: DataFrame, *, least: int = 2, dominance: int = 2) -> DataFrame:
    """base, repo: the one backend whose routes match clearly most of a base's distinct paths; null if none does.

    It needs least paths, and dominance times the runner-up's.
    """
    named = calls.withColumn("_c", segments(F.col("call_path"))).filter(_named(F.col("_c")))
    bases = named.select("base").distinct()
    hits = matched(routes, named).groupBy("base", "repo").agg(F.count_distinct("_c").alias("n"))
    w = Window.partitionBy("base").orderBy(F.desc("n"), "repo")
    top = hits.withColumns({"rn": F.row_number().over(w), "second": F.coalesce(F.lead("n").over(w), F.lit(0))}).filter("rn = 1")
    good = top.filter((F.col("n") >= least) & (F.col("n") >= dominance * F.col("second"))).select("base", "repo")
    return bases.join(good, "base", "left")


def classify(routes: DataFrame, calls: DataFrame, bases: DataFrame) -> DataFrame:
    """repo, method, path, status, callers (up to three) for each route that isn't a mount."""
    own = routes.filter("kind <> 'mount'")
    seen = matched(own, calls).join(bases.select("base", F.col("repo").alias("bound")), "base", "left")
    here = F.col("bound") == F.col("repo")
    agree = here & (F.col("call_method") == F.upper("method"))
    few = lambda condition: F.slice(F.array_sort(F.collect_list(F.when(condition, F.col("call_evidence")))), 1, 3)
    found = seen.groupBy("repo", "method", "path").agg(few(agree).alias("agreed"), few(here).alias("bound_calls"))
    joined = own.join(found, ["repo", "method", "path"], "left")
    status = (
        F.when(~_named(segments(F.col("path"))), "match-ambiguous")
        .when(F.size("agreed") > 0, "ui-called")
        .when(F.size("bound_calls") > 0, "method-unresolved")
        .when(F.col("agreed").isNotNull(), "base-unresolved")
        .otherwise("no-direct-path-match")
    )
    none = F.array().cast("array<string>")
    callers = F.when(status == "ui-called", F.col("agreed")).when(status == "method-unresolved", F.col("bound_calls")).otherwise(none)
    return joined.select("repo", "method", "path", status.alias("status"), callers.alias("callers"))
