"""Building and checking a system model: nodes and containment, route links, stores, technologies, task outcomes, catalogues, run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.operators.compare import keyed_diff

# Families whose extraction needs structural matches, and that of SQL scripts.
STRUCTURAL, SCRIPTS = ("gorm", "sequelize"), "sql"
# Outcomes of tasks that leave a run without authority.
OPEN_OUTCOMES = ("partial", "failed")


def contained(citations: DataFrame, repository: str, path: str, symbol: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and containment (src, dst) of cited repositories, files and symbols; a citation without a symbol gives none."""
    r, p, s = F.col(repository), F.col(path), F.col(symbol)
    ids = (F.concat(F.lit("repository:"), r), F.concat_ws("\0", F.concat(F.lit("file:"), r), p), F.concat_ws("\0", F.concat(F.lit("symbol:"), r), p, s))
    has = (r.isNotNull(), r.isNotNull() & (p != ""), r.isNotNull() & (p != "") & (s != ""))
    rows = [F.when(h, F.struct(i.alias("id"), F.lit(k).alias("kind"), c.alias("label"))) for h, i, k, c in zip(has, ids, ("repository", "file", "symbol"), (r, p, s), strict=True)]
    links = [F.when(has[n], F.struct(ids[n - 1].alias("src"), ids[n].alias("dst"))) for n in (1, 2)]
    each = lambda parts: citations.select(F.inline(F.array_compact(F.array(*parts)))).distinct()
    return each(rows), each(links)


def linked_routes(routes: DataFrame, links: DataFrame, keys: list[str], status: str, frontend: str, called: str = "ui-called") -> DataFrame:
    """Routes with ui_linked and ui_frontends (sorted) by their links of status called; routes without stay."""
    by_route = links.filter(F.col(status) == called).groupBy(*keys).agg(F.array_sort(F.collect_set(F.nullif(F.col(frontend), F.lit("")))).alias("ui_frontends"), F.lit(True).alias("ui_linked"))
    joined = routes.join(by_route, keys, "left")
    return joined.withColumns({"ui_linked": F.coalesce("ui_linked", F.lit(False)), "ui_frontends": F.coalesce("ui_frontends", F.array().cast("array<string>"))})


def named_accesses(accesses: DataFrame, registry: DataFrame, identifier: str, order: str, value: str) -> DataFrame:
    """Accesses with the value that the registry's last entry for their identifier has; others keep a null and are unresolved."""
    last = registry.groupBy(identifier).agg(F.max_by(value, order).alias(value))
    return accesses.join(last, identifier, "left").withColumn("resolved", F.col(value).isNotNull())


def described_stores(stores: DataFrame, documents: DataFrame, name: str, family: str, logical: str) -> DataFrame:
    """Stores with kind, families and logical_names: collections where documents name them, else relational tables."""
    known = documents.groupBy(name).agg(F.array_sort(F.collect_set(family)).alias("families"), F.array_sort(F.collect_set(F.nullif(F.col(logical), F.lit("")))).alias("logical_names"))
    joined = stores.select(name).distinct().join(known, name, "left")
    return joined.select(
        name, F.when(F.col("families").isNull(), "table").otherwise("collection").alias("kind"),
        F.coalesce("families", F.array(F.lit("relational"))).alias("families"), F.coalesce("logical_names", F.array().cast("array<string>")).alias("logical_names"),
    )


def node_keys(nodes: DataFrame, repository: str, kind: str, label: str, extra: dict[str, tuple[str, str]]) -> DataFrame:
    """repository, key, and the nodes' columns: kind:label, and for kinds of extra (prefix, column) a second key. One row for each distinct key of a node."""
    keys = [F.concat(F.col(kind), F.lit(":"), F.col(label))]
    keys += [F.when(F.col(kind) == k, F.concat(F.lit(f"{prefix}:"), F.coalesce(F.col(column), F.col(label), F.lit("")))) for k, (prefix, column) in extra.items()]
    return nodes.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))))


def store_coverage(blocks: DataFrame, repository: str) -> DataFrame:
    """How far each repository's data model was read: status and families.

    Blocks have detector (bool, null without one), detected, supported, extracted, unsupported (arrays), stores, bindings
    (unresolved ones), structural (bool), scripts (bool), scripts_complete (bool), capped (bool).
    """
    empty = F.array().cast("array<string>")
    some = lambda c: F.when(F.col("detector").isNull(), empty).otherwise(F.coalesce(c, empty))
    families = {c: some(c) for c in ("detected", "supported", "extracted", "unsupported")}
    rows = blocks.withColumns(families).withColumn("unresolved", F.array_sort(F.array_union("unsupported", F.array_except("supported", "extracted"))))
    needs_match, needs_sql = F.arrays_overlap("supported", F.array(*map(F.lit, STRUCTURAL))), F.array_contains("supported", SCRIPTS)
    failed = (needs_match & ~F.coalesce("structural", F.lit(False))) | (needs_sql & ~F.coalesce("scripts", F.lit(False)))
    partial = needs_sql & F.coalesce("scripts", F.lit(False)) & ~F.coalesce("scripts_complete", F.lit(False))
    rows = rows.withColumns({"failed": failed, "open": partial | F.coalesce("capped", F.lit(False)) | (F.size("unresolved") > 0) | (F.coalesce("bindings", F.lit(0)) > 0)})
    has, got = F.coalesce("stores", F.lit(0)) > 0, F.size("extracted") > 0
    status = F.when(~F.coalesce("detector", F.lit(False)), F.when(has, "partial").otherwise("unavailable")).when(F.size("detected") == 0, "not-applicable")
    status = status.when(F.col("failed") & ~got, "unavailable").when(has & ~F.col("failed") & ~F.col("open"), "complete").when(has | got, "partial").otherwise("unavailable")
    sort = {c: F.array_sort(F.array_distinct(c)) for c in ("detected", "supported", "extracted")}
    return rows.withColumns(sort | {"status": status}).select(repository, "status", "detector", "detected", "supported", "extracted", "unresolved", "stores", "bindings", "failed", "open")


def store_coverage_total(details: DataFrame) -> DataFrame:
    """One row over all repositories of store_coverage; not-applicable if there is none."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    total = details.agg(
        F.count("*").alias("repositories"), F.coalesce(F.bool_and(F.coalesce("detector", F.lit(False))), F.lit(False)).alias("detector_complete"), *[union(c) for c in ("detected", "supported", "extracted", "unresolved")],
        F.coalesce(F.sum("stores"), F.lit(0)).alias("stores"), F.coalesce(F.sum("bindings"), F.lit(0)).alias("bindings"), F.coalesce(F.bool_or(F.col("failed") | F.col("open")), F.lit(False)).alias("_short"),
    )
    has = F.col("stores") > 0
    status = F.when(F.col("repositories") == 0, "not-applicable").when(~F.col("detector_complete"), F.when(has, "partial").otherwise("unavailable")).when(F.size("detected") == 0, "not-applicable")
    status = status.when(has & ~F.col("_short") & (F.size("unresolved") == 0), "complete").when(has | (F.size("extracted") > 0), "partial").otherwise("unavailable")
    return total.withColumn("status", status).drop("_short")


def merged_facets(facets: DataFrame, profile: str, roots: str, evidence: str, confidence: str) -> DataFrame:
    """One row for each profile: the sorted unions of roots and evidence; high if any observation is, else the first one's word."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    high = F.bool_or(F.col(confidence) == "high")
    return facets.groupBy(profile).agg(union(roots), union(evidence), F.when(high, "high").otherwise(F.min(confidence)).alias(confidence))


def facet_names(facets: DataFrame, profiles: DataFrame, profile: str, kind: str, wanted: str, name: str) -> DataFrame:
    """Distinct names of the observed profiles of one kind, in order of names when collected; unknown profiles have none."""
    return facets.select(profile).distinct().join(profiles.filter(F.col(kind) == wanted), profile).select(name).distinct()


def repository_gap(expected: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """key, side: expected but not mapped, or mapped but not expected."""
    e, m = expected.select(key).distinct(), mapped.select(key).distinct()
    return e.join(m, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(m.join(e, key, "left_anti").withColumn("side", F.lit("extra")))


def task_outcomes(tasks: DataFrame, outputs: DataFrame, accounted: DataFrame, task: str, outcome: str, consumer: str, finding: str) -> DataFrame:
    """Tasks with outcome, consumer and reason: a task with a finding that nothing accounts for is partial and has no consumer."""
    lost = outputs.select(task, finding).distinct().join(accounted.select(finding).distinct(), finding, "left_anti").groupBy(task).agg(F.count("*").alias("missing"))
    joined = tasks.join(lost, task, "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    gap = F.col("missing") > 0
    return joined.withColumns({outcome: F.when(gap, "partial").otherwise(F.col(outcome)), consumer: F.when(gap, "").otherwise(F.col(consumer)), "reason": F.when(gap, "lineage-missing").otherwise("")})


def authoritative(outcomes: DataFrame, outcome: str, consumer: str) -> DataFrame:
    """One row: whether every task came to an end that something consumes, and how many didn't."""
    fine = ~F.col(outcome).isin(*OPEN_OUTCOMES) & (F.coalesce(F.col(consumer), F.lit("")) != "")
    return outcomes.agg(F.coalesce(F.bool_and(fine), F.lit(True)).alias("authoritative"), F.count_if(~fine).alias("open"))


def released(log: DataFrame, key: str, order: list[str], event: str, ends: tuple[str, ...], chosen: DataFrame | None = None) -> DataFrame:
    """key, attempt of outstanding claims, whose last event is a claim: all, or those of chosen keys. ends are events that close a claim."""
    at = F.struct(*order)
    last = log.filter(F.col(event).isin("claimed", *ends)).groupBy(key).agg(F.max_by(event, at).alias("_last"), F.count_if(F.col(event) == "claimed").alias("attempt"))
    held = last.filter("_last = 'claimed'").drop("_last")
    return held if chosen is None else held.join(chosen.select(key).distinct(), key, "left_semi")


def catalogue_problems(sections: DataFrame, dependencies: DataFrame, section: str, wave: str, needs: str, document: str, share: str, off: float = 0.01) -> DataFrame:
    """problem, subject: sections given twice, dependencies that are unknown or not of an earlier wave, documents whose shares don't add up to one."""
    twice = sections.groupBy(section).count().filter("count > 1").select(F.lit("duplicate section").alias("problem"), F.col(section).alias("subject"))
    waves = sections.groupBy(section).agg(F.max(wave).alias(wave))
    target = waves.select(F.col(section).alias(needs), F.col(wave).alias("_needed"))
    joined = dependencies.join(waves, section).join(target, needs, "left")
    why = F.when(F.col("_needed").isNull(), "unknown dependency").when(F.col("_needed") >= F.col(wave), "dependency not earlier")
    wrong = joined.select(why.alias("problem"), F.concat_ws(" > ", section, needs).alias("subject")).filter("problem is not null")
    total = sections.filter(F.col(share) > 0).groupBy(document).agg(F.sum(share).alias("_sum")).filter(F.abs(F.col("_sum") - 1) > off)
    return twice.unionByName(wrong).unionByName(total.select(F.lit("shares do not sum to one").alias("problem"), F.col(document).alias("subject")))


def frozen_comparison(base: DataFrame, candidate: DataFrame, field: str, digest: str, ready: Column | bool) -> DataFrame:
    """One row: classification and the fields (sorted) in which two runs' frozen inputs differ. Equal inputs are model-only if both runs are ready for it."""
    changed = keyed_diff(base.select(field, digest), candidate.select(field, digest), [field], [digest], [digest])
    differing = changed.agg(F.array_sort(F.collect_list(field)).alias("differences"))
    ready = F.lit(ready) if isinstance(ready, bool) else ready
    return differing.withColumn("classification", F.when(F.size("differences") > 0, "input-pipeline-difference").when(ready, "model-only").otherwise("functional-only"))


def boundary_kinds(nodes: DataFrame, kind: str, label: str, most: int = 24) -> DataFrame:
    """kind, labels (how many), preview: the first 24 distinct labels, an ellipsis where there are more."""
    from strataline.operators.ranking import first_per_group

    each = nodes.select(F.coalesce(kind, F.lit("unknown")).alias(kind), label).distinct()
    few = first_per_group(each, [kind], [F.col(label)], most).groupBy(kind).agg(F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("preview"))
    counts = each.groupBy(kind).agg(F.count("*").alias("labels"))
    return counts.join(few, kind).withColumn("preview", F.concat("preview", F.when(F.col("labels") > most, " …").otherwise("")))


def united_universe(mechanical: DataFrame, added: DataFrame, key: str, evidence: str) -> DataFrame:
    """All candidates with origin and problem: an added one may not reuse a key and must have evidence."""
    both = mechanical.withColumn("origin", F.lit("mechanical")).unionByName(added.withColumn("origin", F.lit("added")))
    counts = both.groupBy(key).agg(F.count("*").alias("_n"))
    bare = (F.col("origin") == "added") & (F.coalesce(F.size(evidence), F.lit(0)) < 1)
    return both.join(counts, key).withColumn("problem", F.when(F.col("_n") > 1, "duplicate key").when(bare, "no evidence").otherwise("")).drop("_n")


def document_limits(words: DataFrame, limits: DataFrame, document: str, count: str, low: str, high: str) -> DataFrame:
    """document, words, problem of documents below their floor or above their ceiling; a null bound binds nothing, a document without words is missing."""
    total = words.groupBy(document).agg(F.sum(count).alias("words"))
    joined = limits.join(total, document, "left")
    why = F.when(F.col("words").isNull(), "missing").when(F.col("words") < F.col(low), "below floor").when(F.col("words") > F.col(high), "above ceiling")
    return joined.select(document, "words", why.alias("problem")).filter("problem is not null")


def resolved_exactly(boundaries: DataFrame, resolutions: DataFrame, key: str, decision: str, allowed: list[str]) -> DataFrame:
    """key, problem: boundaries without a resolution or with several, resolutions of no boundary, decisions that aren't allowed."""
    b, r = boundaries.groupBy(key).agg(F.lit(True).alias("_b")), resolutions.groupBy(key).agg(F.count("*").alias("_n"), F.bool_and(F.col(decision).isin(*allowed)).alias("_fine"))
    why = F.when(F.col("_b").isNull(), "unknown").when(F.col("_n").isNull(), "unresolved").when(F.col("_n") > 1, "several").when(~F.coalesce("_fine", F.lit(False)), "not allowed")
    return b.join(r, key, "full").select(key, why.alias("problem")).filter("problem is not null")


def candidate_root(value: Column, kind: Column) -> Column:
    """A candidate's first two path segments, of a route without its method; (root) if it has none."""
    bare = F.when(kind.isin("route", "route-mount"), F.when(value.contains(" "), F.regexp_replace(value, r"^[^ ]* ", "")).otherwise("")).otherwise(value)
    parts = F.filter(F.split(bare, "/"), lambda s: (s != "") & ((kind == "folder") | ~s.startswith("GET ")))
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 2), "/")).otherwise("(root)")
