"""Rows from manifests and deployment files (path, text): declared packages, stores, services, deployable units, policies, excerpts.

A file is one row, and what is read from it comes from array expressions; only first-of-a-key choices shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.names import byte_prefix
from strataline.functions.sources import is_env_file, is_test
from strataline.functions.text import redact
from strataline.functions.views import lines_of
from strataline.operators.ranking import first_per_group

# Sections of a package manifest (a later one wins).
SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
GO_REQUIRE = r"^\s*(?:require\s+)?([\w./-]+)\s+v[\w.+-]+"
# Beginnings and ends of compose files' names; names of pipelines, and words that say that one deploys.
COMPOSE_BEGINS, COMPOSE_ENDS = ("compose", "docker-compose"), (".yml", ".yaml")
CI_FILES = ("bitbucket-pipelines.yml", ".gitlab-ci.yml", "Jenkinsfile", "azure-pipelines.yml")
DEPLOY_WORDS = ("deploy", "deployment", "rollout", "rancher", "kubectl", "helm", "release", "docker push")
BUILD_FOLDERS = ("build", "deploy", "docker")
# Extensions of policy files, sections of a model, and kinds of a policy's rows.
POLICY_EXTENSIONS = (".conf", ".csv", ".ini", ".model")
MODEL_SECTIONS, POLICY_ROWS = ("request_definition", "policy_definition", "matchers"), ("p", "g")


def _has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda x: text.contains(x))


def is_compose(name: Column) -> Column:
    """Whether a file's name is that of a compose file, in any case: a begin, an end, and word characters, dots or hyphens between."""
    low = F.lower(name)
    ends = F.exists(F.array(*map(F.lit, COMPOSE_ENDS)), lambda x: low.endswith(x))
    begins = F.exists(F.array(*map(F.lit, COMPOSE_BEGINS)), lambda x: low.startswith(x))
    return begins & ends & (F.regexp_replace(low, r"[\w.-]", "") == "")


def deploys(text: Column) -> Column:
    """Whether a text has a word of deployment. Words are runs of letters, digits and underscores; white space between two counts as one space."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"[^\w ]", " , "), F.lit(" "))
    return _has_any(words, tuple(f" {w} " for w in DEPLOY_WORDS))


def _policy_rows(text: Column) -> Column:
    kinds = F.transform(F.split(text, "\n"), lambda line: F.trim(F.substring_index(line, ",", 1)))
    return F.exists(F.arrays_zip(kinds.alias("kind"), F.split(text, "\n").alias("line")), lambda x: x["line"].contains(",") & F.regexp_replace(x["kind"], r"\s", "").isin(*POLICY_ROWS))


_name = lambda path: F.element_at(F.split(path, "/"), -1)


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def declared_packages(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, package, version, section of package manifests; of a package in several sections the last one counts. Bad JSON declares none."""
    manifests = files.filter(_name(F.col(path)) == "package.json")
    parsed = F.from_json(text, ", ".join(f"{s} map<string,string>" for s in SECTIONS))
    each = manifests.select(path, F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("section"), parsed[s].alias("packages")) for i, s in enumerate(SECTIONS)])).alias("s"))
    rows = each.select(path, F.col("s.at").alias("at"), F.col("s.section").alias("section"), F.explode("s.packages").alias("package", "version"))
    last = rows.groupBy(path, "package").agg(F.max_by(F.struct("version", "section"), "at").alias("_last"))
    return last.select(path, "package", "_last.version", "_last.section")


def go_requirements(files: DataFrame, path: str = "path", text: str = "text", *, indirect: bool = True) -> DataFrame:
    """path, line, package of the requirements of Go module files, with or without those marked indirect."""
    lines = files.filter(_name(F.col(path)) == "go.mod").select(path, F.posexplode(lines_of(F.col(text))).alias("at", "s"))
    found = lines.filter(F.col("s").rlike(GO_REQUIRE) & (F.lit(indirect) | ~F.col("s").rlike(r"// indirect\s*$")))
    return found.select(path, (F.col("at") + 1).alias("line"), F.regexp_extract("s", GO_REQUIRE, 1).alias("package"))


def store_families(packages: DataFrame, families: DataFrame, scripts: DataFrame, path: str = "path", most: int = 8) -> DataFrame:
    """family, files (how many), evidence (the first 8 by name) of declared packages (path, package) by families (package, family), and of SQL scripts."""
    found = packages.join(families, "package").select("family", path).unionByName(scripts.select(F.lit("sql").alias("family"), path)).distinct()
    few = first_per_group(found, ["family"], [F.col(path)], most).groupBy("family").agg(F.array_sort(F.collect_list(path)).alias("evidence"))
    return found.groupBy("family").agg(F.count("*").alias("files")).join(few, "family")


def compose_services(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, service, built_here, image of the services blocks of compose files, by indentation.

    A block is what is indented below a services line; its first indentation is that of service names, and deeper lines
    belong to the name above them. Empty lines and comments don't count. A name given twice in a file has its last form.
    """
    lines = files.filter(is_compose(_name(F.col(path)))).select(path, F.posexplode(lines_of(F.col(text))).alias("at", "raw"))
    blank = F.lit(" \t")
    real = lines.select(path, "at", F.trim("raw", blank).alias("s"), (F.length("raw") - F.length(F.ltrim("raw", blank))).alias("indent")).filter("s <> '' and s not like '#%'")
    w = Window.partitionBy(path).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    top = real.withColumns({"block": F.sum((F.col("indent") == 0).cast("int")).over(w), "header": F.last(F.when(F.col("indent") == 0, F.col("s")), ignorenulls=True).over(w)})
    inner = top.filter(F.col("header").rlike(r"^services\s*:") & (F.col("indent") > 0))
    b = Window.partitionBy(path, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    leveled = inner.withColumn("level", F.first("indent").over(b))
    numbered = leveled.withColumn("service_no", F.sum((F.col("indent") == F.col("level")).cast("int")).over(b))
    own, deeper = F.col("indent") == F.col("level"), F.col("indent") > F.col("level")
    image = F.trim(F.regexp_replace("s", r"^image\s*:", ""))
    one = numbered.groupBy(path, "block", "service_no").agg(
        F.max(F.when(own, F.regexp_extract("s", r"^([\w.-]+)\s*:", 1))).alias("service"), F.max(F.when(own, F.col("at"))).alias("at"),
        F.coalesce(F.bool_or(deeper & F.col("s").rlike(r"^build\s*:")), F.lit(False)).alias("built_here"),
        F.max_by(F.regexp_replace(image, "^['\"]+|['\"]+$", ""), F.when(deeper & F.col("s").rlike(r"^image\s*:"), F.col("at"))).alias("image"),
    )
    last = one.filter("service <> ''").groupBy(path, "service").agg(F.max_by(F.struct("built_here", "image"), "at").alias("_last"))
    return last.select(path, "service", "_last.built_here", "_last.image")


def deployable_units(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """kind, name, evidence of container images, compose services, Go binaries and deploying CI files.

    Of files that give the same unit the one least deep counts, then the first by name.
    """
    p, t, name = F.col(path), F.col(text), _name(F.col(path))
    folder, parent = _folder(p), _name(_folder(p))
    context = F.when(parent.isin(*BUILD_FOLDERS), ".").otherwise(folder)
    main = (name == "main.go") & t.rlike(r"(?m)^\s*package\s+main\b") & t.rlike(r"\bfunc\s+main\s*\(")
    ci = (name.isin(*CI_FILES) | F.concat(F.lit("/"), p).contains("/.github/workflows/")) & deploys(t)
    unit = F.when(name.rlike(r"^Dockerfile($|\.)"), F.struct(F.lit("container-image").alias("kind"), context.alias("name")))
    unit = unit.when(main, F.struct(F.lit("go-main-binary").alias("kind"), folder.alias("name"))).when(ci & ~is_compose(name), F.struct(F.lit("ci-deploy-step").alias("kind"), p.alias("name")))
    plain = files.select(p.alias("evidence"), unit.alias("u")).filter("u is not null").select("u.kind", "u.name", "evidence")
    services = compose_services(files, path, text).select(F.lit("compose-service").alias("kind"), F.col("service").alias("name"), F.col(path).alias("evidence"))
    depth = F.struct(F.size(F.split("evidence", "/")).alias("d"), F.col("evidence").alias("e"))
    return plain.unionByName(services).groupBy("kind", "name").agg(F.min(depth)["e"].alias("evidence"))


def policy_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, kind of files that hold an access-control model or its rows."""
    kind = F.when(_has_any(F.col(text), tuple(f"[{s}]" for s in MODEL_SECTIONS)), "casbin-model").when(_policy_rows(F.col(text)), "casbin-policy")
    policies = F.exists(F.array(*map(F.lit, POLICY_EXTENSIONS)), lambda x: F.col(path).endswith(x))
    return files.filter(policies).select(path, kind.alias("kind")).filter("kind is not null")


def bounded_files(files: DataFrame, group: str, path: str, size: str, most_files: int, most_bytes: int) -> DataFrame:
    """The first files of each group by path, with readable (not over most_bytes) and cap_hit (there are more than most_files)."""
    total = files.groupBy(group).agg((F.count("*") > most_files).alias("cap_hit"))
    kept = first_per_group(files, [group], [F.col(path)], most_files)
    return kept.withColumn("readable", F.col(size) <= most_bytes).join(total, group)


def tests_of(files: DataFrame, group: str, path: str = "path", most: int = 200) -> DataFrame:
    """group, total_count, included_count, truncated, paths: the first test files of each group, with how many there are."""
    tests = files.filter(is_test(F.col(path))).select(group, path).distinct()
    few = first_per_group(tests, [group], [F.col(path)], most).groupBy(group).agg(F.array_sort(F.collect_list(path)).alias("paths"))
    total = tests.groupBy(group).agg(F.count("*").alias("total_count"))
    return total.join(few, group).select(group, "total_count", F.size("paths").alias("included_count"), (F.col("total_count") > most).alias("truncated"), "paths")


def excerpts(references: DataFrame, files: DataFrame, keys: list[str], path: str, line: str, revision: str, text: str, *, around: int = 40, most_chars: int = 2000, most_bytes: int = 8192) -> DataFrame:
    """References with status and excerpt: the lines around a cited one, cut, redacted and bounded in bytes.

    Status is ok, or why there is no excerpt: an unsafe path, an environment file, no such file, another revision, a line out of range.
    """
    known = files.select(*keys, path, F.col(revision).alias("_revision"), lines_of(F.col(text)).alias("_lines"))
    joined = references.join(known, [*keys, path], "left")
    unsafe = F.col(path).startswith("/") | F.array_contains(F.split(path, "/"), "..") | (F.col(path) == "")
    status = F.when(unsafe, "unsafe path").when(is_env_file(_name(F.col(path))), "environment file").when(F.col("_lines").isNull(), "no such file")
    status = status.when(F.lower("_revision") != F.lower(revision), "other revision").when((F.col(line) < 1) | (F.col(line) > F.size("_lines")), "line out of range").otherwise("ok")
    start = F.greatest(F.col(line) - around, F.lit(1))
    window = F.transform(F.slice("_lines", start.cast("int"), (F.col(line) + around - start + 1).cast("int")), lambda s: F.substring(s, 1, most_chars))
    held = joined.withColumn("status", status)
    return held.withColumn("excerpt", F.when(F.col("status") == "ok", byte_prefix(redact(F.array_join(window, "\n")), most_bytes))).drop("_revision", "_lines")
