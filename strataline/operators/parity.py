"""Comparison of two runs at the level of facts: documents of any shape, flattened by what identifies their parts.

A document is a Variant. It is taken apart level by level into parts (path, value): an object's members by name,
an array's items by the fields declared to identify them, or by their values (sets), else by place. The
outermost item with declared fields is a fact, and what lies below it are its fields; a leaf outside such items is a
fact of its own. Noise rules say what is left out or whose local roots are replaced. Facts of both sides, still whole, are grouped by
artifact and fact in one shuffle; their leaves are made and compared there, and
give one entry for each fact that differs: added, removed, changed, or reclassified where only outcomes differ.

Nothing of a document's shape is known in advance but its depth, which is declared or counted. Nothing is written or collected. A
fact is compared in one row. One given twice has both values, in order. A null in a document is a value; a null document is none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.sources import references_in
from strataline.operators.compare import keyed_diff
from strataline.operators.graph import greedy_match, interval_overlaps

# Fields that judge a fact without being another one.
OUTCOMES = ("status", "applicability", "applicable", "outcome", "state")
#: As the only field that identifies an item: its own value.
VALUE = "*"


@dataclass(frozen=True)
class Keyed:
    """Items of arrays at a shape (a path with [] for items, such as /nodes[]/evidence) are known by their fields."""

    shape: str
    fields: tuple[str, ...]
    artifact: str = ".*"


@dataclass(frozen=True)
class Noise:
    """Leaves at a shape (a regular expression) are left out, or scrubbed: roots in their text are replaced."""

    shape: str
    action: str = "drop"
    artifact: str = ".*"


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, doc) of all JSON files below a run's folder, whatever is in them; artifact is the path below it."""
    docs = spark.read.format("json").option("singleVariantColumn", "doc").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    root = path.rstrip("/").rpartition("/")[2]
    return docs.select(F.substring_index(F.col("_metadata.file_path"), f"/{root}/", -1).alias("artifact"), "doc")


def _matches(pattern: str, text: Column) -> Column:
    if pattern == ".*":
        return F.lit(True)
    # without anything but escaped signs, it is a text
    if re.fullmatch(r"(?:[\w/ -]|\\[^\w\s])*", pattern, re.ASCII):
        return text == re.sub(r"\\(.)", r"\1", pattern)
    return text.rlike(f"^(?:{pattern})$")


def _item_key(keys: list[Keyed], artifact: Column, shape: Column, value: Column) -> tuple[Column, Column]:
    """The text that identifies an item, and whether that is by fields; null where none is declared."""
    text, known = F.lit(None).cast("string"), F.lit(False)
    for k in reversed(keys):
        here = (shape == k.shape) & _matches(k.artifact, artifact)
        said = F.to_json(value) if k.fields == (VALUE,) else F.concat_ws(",", *[F.concat(F.lit(f"{f}="), F.coalesce(F.try_variant_get(value, f"$.{f}", "string"), F.lit(""))) for f in k.fields])
        text, known = F.when(here, said).otherwise(text), F.when(here, F.lit(k.fields != (VALUE,))).otherwise(known)
    return text, known


def _part(path: Column, shape: Column, fact: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), shape.alias("shape"), fact.alias("fact"), value.alias("value"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _taken_apart(keys: list[Keyed], noise: list[Noise], artifact: Column, part: Column) -> Column:
    """The parts one level below a part; a leaf, and an empty object or array, is itself the only one."""

    def member(e: Column) -> Column:
        name = F.concat(F.lit("/"), F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        return _part(F.concat(part["path"], name), F.concat(part["shape"], name), part["fact"], e["value"])

    def item(v: Column, i: Column) -> Column:
        said, by_fields = _item_key(keys, artifact, part["shape"], v)
        path = F.concat(part["path"], F.lit("["), F.coalesce(said, i.cast("string")), F.lit("]"))
        return _part(path, F.concat(part["shape"], F.lit("[]")), F.coalesce(part["fact"], F.when(by_fields, path)), v)

    dropped = lambda p: reduce(Column.__or__, [_matches(n.shape, p["shape"]) & _matches(n.artifact, artifact) for n in noise if n.action == "drop"], F.lit(False))
    members = F.transform(F.map_entries(F.try_variant_get(part["value"], "$", "map<string, variant>")), member)
    items = F.transform(F.try_variant_get(part["value"], "$", "array<variant>"), item)
    return _bound(F.coalesce(members, items), lambda below: F.when(F.size(below) > 0, F.filter(below, lambda p: ~dropped(p))).otherwise(F.array(part)))


def levels_of(docs: DataFrame) -> int:
    """The deepest nesting of objects and arrays in any document: brackets outside strings, counted in a pass over docs."""
    bare = F.to_json("doc")
    for pattern in (r"\\.", r'"[^"]*"', r"[^\[\]{}]+"):
        bare = F.regexp_replace(bare, pattern, "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda x, c: _bound(x["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0), lambda now: F.struct(now.alias("now"), F.greatest(x["most"], now).alias("most")))
    return docs.agg(F.max(F.aggregate(F.split(bare, ""), start, step)["most"])).first()[0] or 0


@dataclass(frozen=True)
class Flattened:
    """A run taken apart into facts (artifact, fact, shape, value), and how a fact's shape and value give its leaves (field, NUL, value as JSON).

    Values stay whole, as they are in the document, until both runs' are side by side: leaves are many times larger.
    """

    facts: DataFrame
    leaves: Callable[[Column, Column], Column]


def flattened(docs: DataFrame, keys: list[Keyed], noise: list[Noise] = (), roots: dict[str, str] | None = None, levels: int | None = None) -> Flattened:
    """Facts of (artifact, doc) and their leaves: an empty object or array is a leaf too.

    roots: what stands for each local root in scrubbed leaves. levels: how deep documents are nested at most, where that is known; a deeper one
    fails the job, rather than lose leaves. Else they are counted.
    """
    docs = docs.filter("doc IS NOT NULL")
    levels = levels_of(docs) if levels is None else levels
    none, artifact = F.lit(None).cast("string"), F.col("artifact")
    parts = docs.select("artifact", _part(F.lit(""), F.lit(""), none, F.col("doc")).alias("part"))
    for _ in range(levels):
        parts = parts.select("artifact", F.explode(F.when(F.col("part.fact").isNotNull(), F.array("part")).otherwise(_taken_apart(keys, noise, artifact, F.col("part")))).alias("part"))
    # a fact's item is below so many levels already
    above = min((k.shape.count("/") + k.shape.count("[]") + 1 for k in keys if k.fields != (VALUE,)), default=levels)

    def text(p: Column) -> Column:
        said = F.to_json(p["value"])
        for root, placeholder in sorted((roots or {}).items(), key=lambda x: -len(x[0])):
            scrubbed = [_matches(n.shape, p["shape"]) & _matches(n.artifact, artifact) for n in noise if n.action == "scrub"]
            said = F.when(reduce(Column.__or__, scrubbed, F.lit(False)), F.replace(said, F.lit(root), F.lit(placeholder))).otherwise(said)
        return said

    def leaves(shape: Column, value: Column) -> Column:
        rest = F.array(_part(F.lit(""), shape, F.lit(""), value))
        for _ in range(levels - above):
            rest = F.flatten(F.transform(rest, lambda p: _taken_apart(keys, noise, artifact, p)))
        deeper = lambda said: said.rlike(r"^(\{[^}]|\[[^\]])")
        checked = lambda said: F.when(deeper(said), F.raise_error(F.lit(f"a document has more than {levels} levels"))).otherwise(said)
        return F.transform(rest, lambda p: F.concat(p["path"], F.lit("\0"), _bound(text(p), checked)))

    return Flattened(parts.select("artifact", F.coalesce("part.fact", "part.path").alias("fact"), "part.shape", "part.value"), leaves)


def _counted(leaves: Column) -> Column:
    """Distinct leaves, each with a NUL and how often it is given: texts, which Spark sorts and hashes as they are."""

    def runs(sorted_: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(sorted_, i - 1) != F.get(sorted_, i))
        starts = F.filter(F.transform(sorted_, lambda _, i: i), first)
        return _bound(starts, lambda s: F.transform(s, lambda at, i: F.concat(F.get(sorted_, at), F.lit("\0"), (F.coalesce(F.get(s, i + 1), F.size(sorted_)) - at).cast("string"))))

    return _bound(F.sort_array(leaves), runs)


def fact_diff(base: Flattened, candidate: Flattened, outcomes: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """artifact, fact, change, fields: one entry for each fact of two flattened runs that differs; fields (sorted) are those that do.

    Both runs' facts are brought together in one shuffle, and taken apart there.
    """
    side = lambda run, i: run.facts.select("artifact", "fact", F.lit(i).alias("side"), F.struct("shape", "value").alias("given"))
    given = lambda i: F.collect_list(F.when(F.col("side") == i, F.col("given")))
    facts = side(base, 0).unionByName(side(candidate, 1)).groupBy("artifact", "fact").agg(given(0).alias("b"), given(1).alias("c"))
    leaves = lambda run, c: _counted(F.flatten(F.transform(c, lambda g: run.leaves(g["shape"], g["value"]))))
    told = F.struct(leaves(base, "b").alias("b"), leaves(candidate, "c").alias("c"))

    def judged(t: Column) -> Column:
        # values and counts hold no NUL, so a field ends before the last but one
        field = lambda x: F.left(x, F.length(x) - F.length(F.substring_index(x, "\0", -2)) - 1)
        other = F.transform(F.concat(F.array_except(t["b"], t["c"]), F.array_except(t["c"], t["b"])), field)
        return F.struct((F.size(t["b"]) > 0).alias("in_base"), (F.size(t["c"]) > 0).alias("in_candidate"), F.array_sort(F.array_distinct(other)).alias("fields"))

    found = facts.select("artifact", "fact", F.explode(F.transform(F.array(told), judged)).alias("d")).select("artifact", "fact", "d.*").filter(F.size("fields") > 0)
    of_outcomes = F.forall("fields", lambda f: F.regexp_extract(f, r"^/([^/\[\]]*)", 1).isin(*outcomes))
    change = F.when(~F.col("in_base"), "added").when(~F.col("in_candidate"), "removed").when(of_outcomes, "reclassified").otherwise("changed")
    return found.select("artifact", "fact", change.alias("change"), "fields")


def presence(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """artifact, missing_in: documents that one run lacks."""
    side = lambda df, name: df.filter("doc IS NOT NULL").select("artifact", F.lit(True).alias(name)).distinct()
    both = side(base, "b").join(side(candidate, "c"), "artifact", "full_outer")
    return both.filter("b IS NULL OR c IS NULL").select("artifact", F.when(F.col("b").isNull(), "base").otherwise("candidate").alias("missing_in"))


def verdict(entries: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: added, removed, changed, reclassified, missing (documents), and whether the runs say the same."""
    counts = entries.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "reclassified")])
    both = counts.crossJoin(missing.agg(F.count("*").alias("missing")))  # two rows of sums
    return both.withColumn("same", F.expr("added + removed + changed + reclassified + missing = 0"))


def matched_findings(base: DataFrame, candidate: DataFrame, width: int = 100) -> DataFrame:
    """base_finding, candidate_finding, overlap, deltas: findings of one lens with overlapping evidence, most overlaps first, each once; others have a null.

    Findings: finding, lens, priority, confidence, modules (array), evidence (array of repository, file, first, last).
    deltas names what is judged differently: priority, confidence, modules.
    """
    spans = lambda df: df.select("finding", "lens", F.inline("evidence")).groupBy("finding", "lens", "repository", "file").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    ids = lambda df, name: spans(df).withColumnRenamed("finding", name)
    scored = interval_overlaps(ids(base, "base_finding"), ids(candidate, "candidate_finding"), ["lens", "repository", "file"], "base_finding", "candidate_finding", "first", "last", width)
    scored = scored.select(F.col("a_id").alias("base_finding"), F.col("b_id").alias("candidate_finding"), "overlaps")
    pairs = greedy_match(scored, "base_finding", "candidate_finding", "overlaps")
    about = lambda df, side: df.select(F.col("finding").alias(f"{side}_finding"), F.struct("priority", "confidence", F.array_sort(F.array_distinct(F.coalesce("modules", F.array().cast("array<string>")))).alias("modules")).alias(side))
    joined = about(base, "base").join(pairs, "base_finding", "left").join(about(candidate, "candidate"), "candidate_finding", "full_outer")
    deltas = F.array_compact(F.array(*[F.when(F.col("overlaps").isNotNull() & ~F.col(f"base.{f}").eqNullSafe(F.col(f"candidate.{f}")), F.lit(f)) for f in ("confidence", "modules", "priority")]))
    return joined.select("base_finding", "candidate_finding", F.coalesce("overlaps", F.lit(0)).alias("overlap"), deltas.alias("deltas"))


def module_map_diff(base: tuple[DataFrame, DataFrame], candidate: tuple[DataFrame, DataFrame]) -> DataFrame:
    """module_id, change of modules whose name, classification, aliases or candidates differ. Sides: modules, and dispositions (candidate_id, module_ids)."""
    none = F.array().cast("array<string>")

    def described(modules: DataFrame, dispositions: DataFrame) -> DataFrame:
        members = dispositions.select("candidate_id", F.explode("module_ids").alias("module_id")).groupBy("module_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("members"))
        return modules.join(members, "module_id", "left").select("module_id", "name", "classification", F.array_sort(F.array_distinct(F.coalesce("aliases", none))).alias("aliases"), F.coalesce("members", none).alias("members"))

    return keyed_diff(described(*base), described(*candidate), ["module_id"], ["name", "classification", "aliases", "members"], [])


def citation_diff(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """document, citation, side: references that the prose of only one run's documents (document, text) has."""
    cited = lambda df: df.select("document", F.explode(references_in(F.col("text"))).alias("citation")).distinct()
    both = cited(base).withColumn("b", F.lit(True)).join(cited(candidate).withColumn("c", F.lit(True)), ["document", "citation"], "full_outer")
    return both.filter("b IS NULL OR c IS NULL").select("document", "citation", F.when(F.col("b").isNull(), "added").otherwise("removed").alias("side"))


def shrunken_sections(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """document, heading, base_words, words: sections (document, heading, words) that say less than before, or are gone."""
    before = base.groupBy("document", "heading").agg(F.sum("words").alias("base_words"))
    now = candidate.groupBy("document", "heading").agg(F.sum("words").alias("words"))
    return before.join(now, ["document", "heading"], "left").select("document", "heading", "base_words", F.coalesce("words", F.lit(0)).alias("words")).filter("words < base_words")


def substance_verdict(findings: DataFrame, modules: DataFrame, citations: DataFrame, totals: DataFrame, sections: DataFrame) -> DataFrame:
    """section, differences, same for each part of a comparison of substance; totals: a keyed diff of disposition totals."""
    changed = findings.filter(F.col("base_finding").isNull() | F.col("candidate_finding").isNull() | (F.size("deltas") > 0))
    parts = (("findings", changed), ("module map", modules), ("citations", citations), ("disposition totals", totals), ("sections", sections))
    rows = [df.agg(F.count("*").alias("differences")).select(F.lit(name).alias("section"), "differences", (F.col("differences") == 0).alias("same")) for name, df in parts]
    return reduce(DataFrame.unionByName, rows)
