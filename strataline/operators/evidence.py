"""Evidence about candidates, findings, signals and tasks: merging, selection, coverage and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.ranking import first_per_group


def _vocabulary(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A row for each of a few declared values."""
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))


def signal_counts(rows: DataFrame, tool: str, repo: str, status: str, statuses: list[str]) -> DataFrame:
    """tool, invocations, repositories (distinct), and a count for each status."""
    return rows.groupBy(tool).agg(F.count("*").alias("invocations"), F.count_distinct(repo).alias("repositories"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses])


def lens_counts(rows: DataFrame, lenses: dict[str, list[str]], tool: str, repo: str) -> DataFrame:
    """lens, invocations, repositories from the rows themselves: distinct counts of tools don't add up."""
    by_tool = F.create_map(*[x for t in sorted({t for tools in lenses.values() for t in tools}) for x in (F.lit(t), F.array(*[F.lit(n) for n, tools in sorted(lenses.items()) if t in tools]))])
    return rows.withColumn("lens", F.explode(by_tool[F.col(tool)])).groupBy("lens").agg(F.count("*").alias("invocations"), F.count_distinct(repo).alias("repositories"))


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """value, n for each declared value, also where no row has it."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return _vocabulary(rows, column, values).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def sites(rows: DataFrame, group: str, site: str, internal: Column) -> DataFrame:
    """group, internal_sites, external_sites: distinct sites; one with any internal target isn't external."""
    each = rows.groupBy(group, site).agg(F.bool_or(internal).alias("_in"))
    return each.groupBy(group).agg(F.count_if("_in").alias("internal_sites"), F.count_if(~F.col("_in")).alias("external_sites"))


def coverage(candidates: DataFrame, analyzed: DataFrame, failures: DataFrame, repo: str, kind: str) -> DataFrame:
    """repo, status: complete if nothing failed and each kind was analyzed as often as it occurs, else partial."""
    want = candidates.groupBy(repo, kind).agg(F.count("*").alias("_want"), F.lit(0).cast("long").alias("_have"), F.lit(0).cast("long").alias("_bad"))
    have = analyzed.groupBy(repo, kind).agg(F.lit(0).cast("long").alias("_want"), F.count("*").alias("_have"), F.lit(0).cast("long").alias("_bad"))
    bad = failures.groupBy(repo, kind).agg(F.lit(0).cast("long").alias("_want"), F.lit(0).cast("long").alias("_have"), F.count("*").alias("_bad"))
    each = want.unionByName(have).unionByName(bad).groupBy(repo, kind).agg(*[F.sum(c).alias(c) for c in ("_want", "_have", "_bad")])
    lacking = F.bool_or((F.col("_have") < F.col("_want")) | (F.col("_bad") > 0))
    return each.groupBy(repo).agg(F.when(lacking, "partial").otherwise("complete").alias("status"))


def merged_candidates(rows: DataFrame, key: str, kind: str, evidence: str, order: list[Column], most: int = 3) -> DataFrame:
    """key, kinds (sorted, joined by +), seen, evidence (the first few in order, joined by |)."""
    kinds = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(kind)), "+").alias("kinds"), F.count("*").alias("seen"))
    few = first_per_group(rows, [key], order, most, rank="_rank").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rank", evidence))).alias("_few"))
    return kinds.join(few, key).select(key, "kinds", "seen", F.array_join(F.transform("_few", lambda x: x[evidence].cast("string")), "|").alias("evidence"))


def buckets(rows: DataFrame, keys: list[str], order: list[Column], most: int = 8) -> DataFrame:
    """The first few rows of each bucket, with total and truncated."""
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    return first_per_group(rows, keys, order, most, rank="rank").join(totals, keys).withColumn("truncated", F.col("total") > most)


def matches(selector: dict[str, list[str]], columns: dict[str, str]) -> Column:
    """Whether a candidate has, for each field of the selector, one of its values.

    columns names the column of each field; a field that ends in _prefixes compares beginnings, and
    an array column matches if any element does.
    """
    if not selector or not all(selector.values()):
        raise ValueError("a selector needs fields, and each field values")

    def one(field: str, values: list[str]) -> Column:
        c = F.col(columns[field])
        test = (lambda x: reduce(Column.__or__, [x.startswith(v) for v in values])) if field.endswith("_prefixes") else (lambda x: x.isin(*values))
        return F.exists(c, test) if field.endswith("_elements") or field.startswith("evidence_") else test(c)

    return reduce(Column.__and__, [one(f, v) for f, v in selector.items()])


def expand_rules(candidates: DataFrame, rules: list[tuple[str, list[dict[str, list[str]]]]], columns: dict[str, str], key: str, remainder: str | None = None) -> DataFrame:
    """key, rule, matched: the one rule of each candidate; rule is null where none or several match, which is a violation.

    The rules are declared, so they are one expression over a scan, without a join.
    """
    hits = F.array_compact(F.array(*[F.when(F.coalesce(reduce(Column.__or__, [matches(s, columns) for s in selectors]), F.lit(False)), name) for name, selectors in rules]))
    n = F.size("_hits")
    rule = F.when(n == 1, F.col("_hits")[0]).when(n == 0, F.lit(remainder))
    return candidates.withColumn("_hits", hits).select(key, rule.alias("rule"), n.cast("long").alias("matched"))


def merged_findings(findings: DataFrame, merges: DataFrame, key: str, into: str, evidence: str, module: str, seq: str) -> DataFrame:
    """survivor, evidence rows (exact duplicates once, in order of first appearance), with position.

    findings: a row for each piece of evidence, in order seq. The survivor's own evidence comes first.
    """
    joined = findings.join(merges.select(key, into), key, "left").withColumn("survivor", F.coalesce(into, key))
    place = F.min(F.struct((F.col(key) != F.col("survivor")).alias("a"), F.col(key).alias("k"), F.col(seq).alias("s"))).alias("_place")
    first = joined.groupBy("survivor", evidence, module).agg(place)
    return first.select("survivor", evidence, module, F.row_number().over(Window.partitionBy("survivor").orderBy("_place", evidence, module)).alias("position"))


def merged_definitions(rows: DataFrame, key: str, fixed: list[str], confidence: str, rank: dict[str, int], alias: str) -> DataFrame:
    """key, definitions, conflict, confidence (the least certain), aliases: definitions must agree in the fixed fields."""
    order = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    found = rows.groupBy(key).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in fixed])).alias("definitions"), F.min_by(confidence, order[F.col(confidence)]).alias("confidence"), F.array_join(F.array_sort(F.collect_set(alias)), "|").alias("aliases"))
    return found.withColumn("conflict", F.col("definitions") > 1)


def questions(modules: DataFrame, hits: DataFrame, ran: list[str], all_questions: list[str], module: str, question: str, hit: str, most: int = 3) -> DataFrame:
    """module, question, status, hits: confirmed with the first few hits, no concern if the question's signals ran, else unknown."""
    grid = modules.select(module).distinct().withColumn(question, F.explode(F.array(*map(F.lit, all_questions))))
    few = first_per_group(hits.select(module, question, hit).distinct(), [module, question], [F.col(hit)], most)
    found = few.groupBy(module, question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x.cast("string")), "|").alias("hits"))
    status = F.when(F.col("hits").isNotNull(), "confirmed").when(F.col(question).isin(*ran), "no concern").otherwise("unknown")
    return grid.join(found, [module, question], "left").select(module, question, status.alias("status"), F.coalesce("hits", F.lit("")).alias("hits"))


def independent_origins(refs: DataFrame, key: str, origin: Column, least: int = 2) -> DataFrame:
    """key, origins, corroborated: how many different origins the references of a finding have."""
    return refs.groupBy(key).agg(F.count_distinct(origin).alias("origins")).withColumn("corroborated", F.col("origins") >= least)


def budget_shares(sections: DataFrame, document: str, share: str, total: int) -> DataFrame:
    """Adds words: the part of total by each section's share within its document, 1 at least; sections without a share have none."""
    kept = sections.filter(F.col(share) > 0)
    scale = kept.groupBy(document).agg(F.sum(share).alias("_scale"))
    return kept.join(scale, document).withColumn("words", F.greatest(F.lit(1), F.bround(total * F.col(share) / F.col("_scale")).cast("long"))).drop("_scale")


def selected_providers(providers: DataFrame, targets: DataFrame, provider: str, profiles: str, universal: str, target: str, target_profiles: str) -> DataFrame:
    """Distinct (provider, target) with a profile in common; universal providers and all targets have one more, *."""
    star = F.array(F.lit("*"))
    p = providers.select(provider, F.explode(F.when(F.col(universal), star).otherwise(F.col(profiles))).alias("_profile"))
    t = targets.select(target, F.explode(F.concat(F.coalesce(target_profiles, F.array().cast("array<string>")), star)).alias("_profile"))
    return p.join(t, "_profile").select(provider, target).distinct()


def facts_of_modules(modules: DataFrame, facts: DataFrame, module: str, repos: str, fact: str, repo: str) -> DataFrame:
    """Distinct (module, fact) where the fact's repository is one of the module's."""
    return modules.select(module, F.explode(repos).alias(repo)).distinct().join(facts.select(repo, fact), repo).select(module, fact).distinct()


def lost_blocks(before: DataFrame, after: DataFrame, companion: DataFrame, key: str, text: str) -> DataFrame:
    """key, block of what was removed from a text (table rows and sentences, white space normalised) and isn't in its companion."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))

    def blocks(df: DataFrame) -> DataFrame:
        lines = df.select(key, F.explode(F.split(text, r"\r?\n")).alias("_line")).withColumn("_line", F.trim("_line"))
        parts = F.when(F.col("_line").startswith("|"), F.array("_line")).otherwise(F.split("_line", r"(?<=[.!?])\s+|(?<=[。！？])"))
        return lines.select(key, F.explode(parts).alias("_b")).select(key, plain(F.col("_b")).alias("block")).filter("block <> ''").distinct()

    removed = blocks(before).join(blocks(after), [key, "block"], "left_anti")
    kept = companion.select(key, plain(F.col(text)).alias("_companion"))
    return removed.join(kept, key, "left").filter(~F.coalesce(F.col("_companion").contains(F.col("block")), F.lit(False))).select(key, "block")


def shards(units: DataFrame, task: str, seq: str, tokens: str, *, fixed: int, budget: int, most: int = 32) -> DataFrame:
    """task, seq, shard, shards: units of a task in order, dealt to as few shards of almost equal numbers as its tokens need.

    The number of shards is null where it would be over most, or fixed tokens leave no room: the task can't be composed.
    One shard's own tokens may still exceed the budget if units differ much in size; overfull_shards finds those.
    """
    room = budget - fixed
    w = Window.partitionBy(task)
    rows = units.withColumns({"_n": F.count("*").over(w), "_sum": F.sum(tokens).over(w), "_i": F.row_number().over(w.orderBy(seq)) - 1})
    need = F.when(F.col("_sum") <= room, 1).otherwise(F.least(F.greatest(F.lit(2), F.ceil(F.col("_sum") / room)), F.col("_n"))) if room > 0 else F.lit(None).cast("long")
    rows = rows.withColumn("shards", F.when(need <= most, need).cast("long"))
    q, r = F.floor(F.col("_n") / F.col("shards")), F.col("_n") % F.col("shards")
    shard = F.when(F.col("_i") < r * (q + 1), F.floor(F.col("_i") / (q + 1))).otherwise(r + F.floor((F.col("_i") - r * (q + 1)) / q))
    return rows.select(task, seq, tokens, shard.cast("long").alias("shard"), "shards")


def overfull_shards(dealt: DataFrame, task: str, tokens: str, *, fixed: int, budget: int) -> DataFrame:
    """task, shard, used of shards over the budget."""
    return dealt.groupBy(task, "shard").agg((F.sum(tokens) + fixed).alias("used")).filter(F.col("used") > budget)


def executions(log: DataFrame, key: str, order: list[str], event: str, at: str, *, created: str, claimed: str, submitted: str) -> DataFrame:
    """key, generation, attempt, claimed_at, submitted_at, queue_seconds (0 at least; null where one is missing).

    A claim begins an attempt; the last claim and submission of an attempt count.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("generation", F.count_if(F.col(event) == created).over(w))
    g = Window.partitionBy(key, "generation").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("attempt", F.count_if(F.col(event) == claimed).over(g))
    moment = lambda e, name: F.max(F.when(F.col(event) == e, F.col(at))).alias(name)
    out = rows.filter("attempt > 0").groupBy(key, "generation", "attempt").agg(moment(claimed, "claimed_at"), moment(submitted, "submitted_at"))
    waited = F.unix_seconds(F.col("submitted_at").cast("timestamp")) - F.unix_seconds(F.col("claimed_at").cast("timestamp"))
    return out.withColumn("queue_seconds", F.when(waited < 0, 0).otherwise(waited))


def import_classes(imports: DataFrame, manifest: DataFrame, spec: str, package: str, section: str) -> DataFrame:
    """spec, class of distinct imports: production, dev-test or unclassified, by where the manifest declares their package."""
    from strataline.functions.names import package_key

    declared = manifest.groupBy(package).agg(F.bool_or(F.col(section) == "dependencies").alias("_production"))
    keyed = imports.select(spec).distinct().withColumn(package, package_key(F.col(spec), F.lit(False)))
    kind = F.when(F.col("_production"), "production").when(~F.col("_production"), "dev-test").otherwise("unclassified")
    return keyed.join(declared, package, "left").select(spec, kind.alias("class"))


def short_references(paths: DataFrame, path: str) -> DataFrame:
    """path, reference: paths with the same last part all get as many parts as it takes to tell them apart."""
    rows = paths.select(path).distinct().withColumn("_parts", F.split(path, "/"))
    rows = rows.withColumns({"_base": F.element_at("_parts", -1), "_n": F.size("_parts")})
    tail = lambda d: F.array_join(F.slice("_parts", F.greatest(F.lit(1), F.col("_n") - d + 1), d), "/")
    deepest = rows.groupBy("_base").agg(F.max("_n").alias("_deepest"), F.count("*").alias("_all"))
    each = rows.join(deepest, "_base").withColumn("_d", F.explode(F.sequence(F.lit(1), F.col("_deepest")))).withColumn("_tail", tail(F.col("_d")))
    # two aggregations in place of a distinct count: no group of one name goes through one task
    apart = each.groupBy("_base", "_d", "_tail", "_all").agg(F.count("*").alias("_same")).groupBy("_base", "_d", "_all").agg(F.count("*").alias("_different"))
    depth = apart.filter("_different = _all").groupBy("_base").agg(F.min("_d").alias("_d"))
    return rows.join(depth, "_base").select(path, tail(F.col("_d")).alias("reference"))


def view_lines(lines: DataFrame, source: str, at: str, line: str, pattern: str, most: int) -> DataFrame:
    """The first lines of each source that match, with how many do and whether some are left out."""
    return buckets(lines.filter(F.col(line).rlike(pattern)), [source], [F.col(at)], most)


def outdated(reports: DataFrame, source: str, report: str) -> DataFrame:
    """source, name, current, wanted, latest, type: a row for each package of a report, an object by package name."""
    parsed = F.from_json(report, "map<string, struct<current: string, wanted: string, latest: string, type: string>>")
    return reports.select(source, F.explode(parsed).alias("name", "_p")).select(source, "name", *[F.coalesce(F.col("_p")[c], F.lit("")).alias(c) for c in ("current", "wanted", "latest", "type")])
