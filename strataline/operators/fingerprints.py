"""Technologies of repositories by fingerprints held in a table: adding a rule needs no code.

A rule says which profile a fact speaks for: a manifest or configuration file at a path below a project, a declared package, a
module requirement, a source extension, or a manifest that stands for a language where nothing else does. Files and declarations become facts
with the key that rules have, once, and one equi-join finds all that match, however many rules there are. A
profile's facet keeps what it was seen by. Projects are directories with a manifest, up to two levels deep; a
repository without any is one project.

Sums of a repository's facts are taken before they are brought together, and evidence of sources is cut to the
first few by path, as its count says no more. Null paths, packages and rules match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Files that make a directory a project, and directories that are none.
MANIFESTS = ("package.json", "go.mod", "tsconfig.json", "tsconfig.app.json", "tsconfig.base.json")
SKIPPED = ("node_modules", "vendor", "dist", "build", "coverage")
SHAPES = ("manifest-file", "config-file", "package-dependency", "go-require", "source-extension", "manifest-default")
# Kinds of profiles without which a repository is unclassified.
TELLING = ("language", "ecosystem", "framework")
DEPTH, MOST_SOURCES = 2, 8


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def _within(directory: Column, path: Column) -> Column:
    """The path below a directory."""
    return F.when(directory == ".", path).otherwise(F.substring(path, F.length(directory) + 2, F.length(path)))


def projects(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """repository, directory: where projects are, from (repository, path)."""
    folder = _folder(F.col("path"))
    parts = F.filter(F.split(folder, "/"), lambda s: s != ".")
    near = (F.size(parts) <= depth) & ~F.exists(parts, lambda s: s.isin(*SKIPPED) | s.startswith("."))
    named = F.element_at(F.split("path", "/"), -1).isin(*MANIFESTS)
    found = files.filter(near & named).select("repository", folder.alias("directory")).distinct()
    bare = files.select("repository").distinct().join(found.select("repository").distinct(), "repository", "left_anti")
    return found.unionByName(bare.select("repository", F.lit(".").alias("directory")))


def _ancestors(path: Column, depth: int) -> Column:
    parts = F.slice(F.split(path, "/"), 1, depth + 1)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n - 1), "/"))
    return F.transform(above, lambda d: F.when(d == "", ".").otherwise(d))


def facts(files: DataFrame, packages: DataFrame, requirements: DataFrame, depth: int = DEPTH) -> DataFrame:
    """repository, directory (the project), shape, value, evidence: all that a rule may speak of.

    files: repository, path; packages and requirements: repository, path of the manifest, package.
    """
    known = projects(files, depth)
    parts = F.split("path", "/")
    open_ = ~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda s: s.isin(*SKIPPED) | s.startswith("."))
    each = files.filter("path IS NOT NULL").select("repository", "path", open_.alias("open"), F.explode(F.array_distinct(_ancestors(F.col("path"), depth))).alias("directory")).join(known, ["repository", "directory"])
    extension = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    own = [F.struct(F.lit(s).alias("shape"), _within(F.col("directory"), F.col("path")).alias("value")) for s in ("manifest-file", "config-file", "manifest-default")]
    source = F.when(F.col("open") & (extension != ""), F.struct(F.lit("source-extension").alias("shape"), extension.alias("value")))
    by_file = each.select("repository", "directory", F.col("path").alias("evidence"), F.inline(F.array_compact(F.array(*own, source))))
    said = lambda df, shape, word: df.filter("package IS NOT NULL").select("repository", _folder(F.col("path")).alias("directory"), F.concat("path", F.lit(f"#{word}:"), "package").alias("evidence"), F.lit(shape).alias("shape"), F.col("package").alias("value")).distinct().join(known, ["repository", "directory"])
    names = ["repository", "directory", "shape", "value", "evidence"]
    return by_file.select(names).unionByName(said(packages, "package-dependency", "dependency").select(names)).unionByName(said(requirements, "go-require", "require").select(names))


def facets(found: DataFrame, rules: DataFrame, most_sources: int = MOST_SOURCES) -> DataFrame:
    """repository, profile, kind, scopes, evidence, confidence, state of each technology; found: facts(); rules: profile, kind, shape, value.

    A facet seen by sources alone, or by default, is of medium confidence. Its scope is the project, or the src folder in it if the profile's
    sources are there. A default counts where no language was seen. A repository that nothing telling speaks for is unclassified.
    """
    matched = found.join(rules.select("profile", "kind", "shape", F.when(F.col("shape") == "source-extension", F.lower("value")).otherwise(F.col("value")).alias("value")).distinct(), ["shape", "value"])
    order = Window.partitionBy("repository", "profile", "directory").orderBy("evidence")
    key = ["repository", "directory", "profile", "kind"]
    sources = matched.filter("shape = 'source-extension'").select(*key, "evidence").distinct()
    src = F.concat(F.when(F.col("directory") == ".", "").otherwise(F.concat("directory", F.lit("/"))), F.lit("src"))
    has_src = sources.groupBy(*key).agg(F.bool_or(F.col("evidence").startswith(F.concat(src, F.lit("/")))).alias("has_src"))
    few = sources.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= most_sources).select(*key, "evidence", F.lit(False).alias("firm"), F.lit(True).alias("in_src"))
    firm = matched.filter(~F.col("shape").isin("source-extension", "manifest-default")).select(*key, "evidence", F.lit(True).alias("firm"), F.col("shape").isin("manifest-file", "config-file").alias("in_src"))
    seen = few.unionByName(firm)
    # a language's sources or manifests in a project; declared packages are of the project, not of a language
    languages = seen.filter("kind = 'language' AND in_src").select("repository", "directory").distinct()
    defaults = matched.filter("shape = 'manifest-default'").join(languages, ["repository", "directory"], "left_anti").select(*key, "evidence", F.lit(False).alias("firm"), F.lit(False).alias("in_src"))
    every = seen.unionByName(defaults).join(has_src, key, "left")
    scope = F.when(F.col("in_src") & F.coalesce("has_src", F.lit(False)), src).otherwise(F.col("directory"))
    merged = every.groupBy("repository", "profile", "kind").agg(F.array_sort(F.collect_set(scope)).alias("scopes"), F.array_sort(F.collect_set("evidence")).alias("evidence"), F.when(F.bool_or("firm"), "high").otherwise("medium").alias("confidence"))
    return merged.select("repository", "profile", "kind", "scopes", "evidence", "confidence", F.lit("resolved").alias("state"))


def with_unclassified(found: DataFrame, files: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """facets() and a row for each repository without a language, ecosystem or framework, with its first files."""
    told = found.filter(F.col("kind").isin(*TELLING)).select("repository").distinct()
    rest = files.join(told, "repository", "left_anti").select("repository", "path").distinct()
    first = rest.withColumn("no", F.row_number().over(Window.partitionBy("repository").orderBy("path"))).filter(F.col("no") <= most)
    rows = first.groupBy("repository").agg(F.array_sort(F.collect_list("path")).alias("evidence"))
    return found.unionByName(rows.select("repository", F.lit("repository.unclassified").alias("profile"), F.lit("repository-trait").alias("kind"), F.array(F.lit(".")).alias("scopes"), "evidence", F.lit("low").alias("confidence"), F.lit("unknown").alias("state")))


def conflicting_managers(found: DataFrame, files: DataFrame, declared: DataFrame, profile: str = "ecosystem.node") -> DataFrame:
    """Facets where the ecosystem's is conflicting, of medium confidence, if a project has locks of several managers, or of another than it declares (repository, path, manager)."""
    # Lock files and their managers.
    locks = {"package-lock.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm"}
    name = F.element_at(F.split("path", "/"), -1)
    manager = F.create_map(*[F.lit(x) for pair in locks.items() for x in pair])[name]
    held = files.select("repository", _folder(F.col("path")).alias("directory"), manager.alias("lock")).filter("lock IS NOT NULL").groupBy("repository", "directory").agg(F.collect_set("lock").alias("locks"))
    said = declared.select("repository", _folder(F.col("path")).alias("directory"), F.lower(F.substring_index("manager", "@", 1)).alias("said")).filter("said <> ''")
    both = held.join(said, ["repository", "directory"], "left").filter((F.size("locks") > 1) | (F.col("said").isNotNull() & ~F.array_contains("locks", F.col("said"))))
    clashes = both.groupBy("repository").agg(F.collect_set(F.concat("directory", F.lit(": conflicting package-manager evidence"))).alias("clashes"))
    joined = found.join(clashes, "repository", "left")
    here = (F.col("profile") == profile) & F.col("clashes").isNotNull()
    return joined.withColumns({"evidence": F.when(here, F.array_sort(F.array_union("evidence", "clashes"))).otherwise(F.col("evidence")), "confidence": F.when(here, "medium").otherwise(F.col("confidence")), "state": F.when(here, "conflicting").otherwise(F.col("state"))}).drop("clashes")
