"""Package and module graphs: projections of tool outputs, fan-in and fan-out, totals, coverage, clones, report orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.sources import import_class, in_module, is_internal_import
from strataline.operators.ranking import first_per_group

# Fixed value: the share of internal edges that may be unresolved in a complete graph.
UNRESOLVED_SHARE = 0.15


def go_packages(packages: DataFrame, module: str) -> DataFrame:
    """(ImportPath, Imports) to package, imports (sorted, distinct) of the packages of a module."""
    own = packages.filter(in_module(F.col("ImportPath"), F.lit(module)))
    return own.groupBy(F.col("ImportPath").alias("package")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("Imports", F.array().cast("array<string>")))))).alias("imports"))


def module_edges(modules: DataFrame) -> DataFrame:
    """(source, dependencies: array of (module, resolved, couldNotResolve, circular, dependencyTypes)) to a row for each dependency."""
    return modules.select("source", F.inline("dependencies"))


def fans(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """id, fan_out, fan_in of distinct edges."""
    e = edges.select(src, dst).distinct()
    ends = e.select(F.col(src).alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col(dst).alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def package_graph(packages: DataFrame) -> DataFrame:
    """(package, imports) to src, dst, internal: edges between known packages, and external imports whose first part has a dot."""
    edges = packages.select(F.col("package").alias("src"), F.explode("imports").alias("dst"))
    known = packages.select(F.col("package").alias("dst"), F.lit(True).alias("internal")).distinct()
    joined = edges.join(known, "dst", "left").withColumn("internal", F.coalesce("internal", F.lit(False)))
    return joined.filter(F.col("internal") | F.split("dst", "/")[0].contains(".")).select("src", "dst", "internal")


def top_fans(edges: DataFrame, src: str, dst: str, limit: int = 20) -> DataFrame:
    """side, id, n: the limit packages with most edges out and in, ties by name."""
    found = fans(edges, src, dst)
    top = lambda c: found.filter(F.col(c) > 0).orderBy(F.desc(c), "id").limit(limit).select(F.lit(c).alias("side"), "id", F.col(c).alias("n"))
    return top("fan_out").unionByName(top("fan_in"))


def dependency_totals(edges: DataFrame, spec: str, unresolved: Column, circular: Column, types: Column) -> DataFrame:
    """One row: edges, unresolved, circular, externals, internal edges and unresolved ones, and whether the graph is only partial."""
    internal = is_internal_import(F.col(spec))
    external = F.exists(types, lambda t: t.startswith("npm"))
    total = edges.agg(
        F.count("*").alias("edges"), F.count_if(unresolved).alias("unresolved"), F.count_if(circular).alias("circular"), F.count_distinct(F.when(external & (F.col(spec) != ""), F.col(spec))).alias("externals"),
        F.count_if(internal).alias("internal_edges"), F.count_if(internal & unresolved).alias("internal_unresolved"),
    )
    return total.withColumn("partial", (F.col("internal_edges") > 0) & (F.col("internal_unresolved") > UNRESOLVED_SHARE * F.col("internal_edges")))


def reference_counts(references: DataFrame, spec: str, module: Column) -> DataFrame:
    """class, n: how many references are internal, third-party and stdlib."""
    return references.groupBy(import_class(F.col(spec), module).alias("class")).agg(F.count("*").alias("n"))


def clone_tallies(pairs: DataFrame) -> DataFrame:
    """dimension, value, n of clone pairs (format, scope, a_status, b_status): formats, scopes and ends by resolution."""
    ends = F.array(F.struct(F.lit("format").alias("dimension"), F.col("format").alias("value")), F.struct(F.lit("scope").alias("dimension"), F.col("scope").alias("value")), *[F.struct(F.lit("endpoint").alias("dimension"), F.col(c).alias("value")) for c in ("a_status", "b_status")])
    return pairs.select(F.inline(ends)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def crossing_clones(pairs: DataFrame, limit: int = 60) -> DataFrame:
    """Clones between two files, or of two repositories: widest first, then in input order (seq)."""
    return pairs.filter((F.col("scope") != "within-repo") | (F.col("a_file") != F.col("b_file"))).orderBy(F.desc("span"), "seq").limit(limit)


def churn_order(churn: DataFrame, item: str, limit: int) -> DataFrame:
    return churn.orderBy(F.desc("commits"), F.desc("total_lines"), item).limit(limit)


def coupling_order(pairs: DataFrame, limit: int) -> DataFrame:
    """Pairs with percent, 100 * shared / mean revisions to one decimal: ordered by it after rounding, then shared and names."""
    percent = F.round(100.0 * F.col("shared") / ((F.col("revs_a") + F.col("revs_b")) / 2), 1)
    return pairs.withColumn("percent", percent).orderBy(F.desc("percent"), F.desc("shared"), "item_a", "item_b").limit(limit)


def finding_order(findings: DataFrame, priorities: list[str], confidences: list[str], modules: str, id_: str, limit: int) -> DataFrame:
    """By priority, confidence (places in the lists, unknown ones last), more modules, id."""
    place = lambda c, values: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(c)), F.lit(0)), F.lit(len(values) + 1))
    return findings.orderBy(place("priority", priorities), place("confidence", confidences), F.desc(modules), id_).limit(limit)


def cycle_order(cycles: DataFrame, members: str, limit: int = 40) -> DataFrame:
    return cycles.orderBy(F.size(members), members).limit(limit)


def language_order(totals: DataFrame, code: str, name: str) -> DataFrame:
    return totals.orderBy(F.desc(code), name)


def section_words(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, heading, words of each second-level heading's section: lower headings belong to it."""
    heading = r"(?m)^##[ \t]+(.+?)[ \t]*$"
    parts = F.slice(F.split(text, heading, -1), F.lit(2), F.size(F.split(text, heading, -1)))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(heading), F.lit(1)).alias("heading"), parts.alias("body"))
    words = F.size(F.filter(F.split("body", r"\s+"), lambda w: w != ""))
    return documents.filter(F.col(text).rlike(heading)).select(key, F.inline(found)).select(key, "heading", words.alias("words"))


def absorbed(merges: DataFrame, id_: str, into: str) -> DataFrame:
    """survivor, absorbed: the ids merged into each survivor, sorted."""
    return merges.filter(F.col(into).isNotNull() & (F.col(into) != F.col(id_))).groupBy(F.col(into).alias("survivor")).agg(F.array_sort(F.collect_set(id_)).alias("absorbed"))


def unclassified(files: DataFrame, path: str, ext: str, claimed: list[str], samples: int = 3) -> DataFrame:
    """extension, files, samples: how many files no profile claims, with the first few."""
    rest = files.filter(~F.col(ext).isin(*claimed))
    few = first_per_group(rest.select(ext, path).distinct(), [ext], [F.col(path)], samples).groupBy(ext).agg(F.array_sort(F.collect_list(path)).alias("samples"))
    return rest.groupBy(ext).agg(F.count("*").alias("files")).join(few, ext)


def marker_ratio(files: DataFrame, group: str, path: str, marked: Column, first: int, least: float = 0.8) -> DataFrame:
    """group, ratio, generated: the share of marked files among a group's first ones, and whether it is high."""
    few = first_per_group(files.withColumn("_marked", marked.cast("int")).select(group, path, "_marked"), [group], [F.col(path)], first)
    return few.groupBy(group).agg(F.avg("_marked").alias("ratio")).withColumn("generated", F.col("ratio") >= least)


def spans(evidence: DataFrame, keys: list[str], line: str) -> DataFrame:
    """The keys with first and last line of their evidence."""
    return evidence.groupBy(*keys).agg(F.min(line).alias("first_line"), F.max(line).alias("last_line"))


def rekeyed(findings: DataFrame, owners: DataFrame, id_: str, affected: str, candidate: str, module: str) -> DataFrame:
    """id, modules (sorted), tail: the modules of the candidates that a finding affects; none leaves it in the tail."""
    each = findings.select(id_, F.explode_outer(affected).alias(candidate)).join(owners.select(candidate, module).distinct(), candidate, "left")
    return each.groupBy(id_).agg(F.array_sort(F.collect_set(module)).alias("modules")).withColumn("tail", F.size("modules") == 0)


def inconsistent(summary: DataFrame, manifest: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Rows of a summary whose status isn't the manifest's, which may be missing."""
    other = manifest.select(*keys, F.col(status).alias("recorded"))
    return summary.join(other, keys, "left").filter(~F.col(status).eqNullSafe(F.col("recorded"))).select(*keys, status, "recorded")


def natural_edges(edges: DataFrame, keys: DataFrame, src: str, dst: str, id_: str, key: str) -> DataFrame:
    """Edges with their ends' ids replaced by natural keys; an unknown id is kept."""
    for end in (src, dst):
        edges = edges.join(keys.select(F.col(id_).alias(end), F.col(key).alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return edges


def united(*fragments: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of some fragments, one for each key: the first fragment that has it counts."""
    out = None
    for i, f in enumerate(fragments):
        part = f.withColumn("_fragment", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in fragments[0].columns if c not in keys]
    first = out.groupBy(*keys).agg(F.min(F.struct("_fragment", *rest)).alias("_first"))
    return first.select(*keys, *[F.col("_first").getField(c).alias(c) for c in rest])


def claimable(tasks: DataFrame, ready: str, id_: str, count: int) -> DataFrame:
    """The next count ready tasks, by id."""
    return tasks.filter(F.col(ready)).orderBy(id_).limit(count)


def unsupported_quotes(quotes: DataFrame, lines: DataFrame, keys: list[str], quote: str, line: str) -> DataFrame:
    """Quotes that aren't on the line they cite, or cite none."""
    text = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    joined = quotes.join(lines.select(*keys, F.col(line).alias("_line")), keys, "left")
    return joined.filter(F.col("_line").isNull() | ~F.contains(text(F.col("_line")), text(F.col(quote)))).drop("_line")
