"""Queries on tool outputs, manifests and deployment files, made from the tables' rows, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import views as V
from strataline.operators import manifests as M
from strataline.plans.registry import query

# Outputs of growing length: a warning, a diagnostic below docs, an advisory and a plain line, n times each.
_OUT = "repeat('a.go:1 warning: CCN 12' || chr(10) || 'x/docs/b.go:2 unused' || chr(10) || 'GHSA-1 can be fixed' || chr(10) || 'plain' || chr(10), page_id % 200)"
_ERR = "CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'no Go files in x' ELSE repeat('e' || chr(10), 40) END"
_SPLIT = f"""o AS (SELECT page_id, {_OUT} AS stdout, {_ERR} AS stderr FROM pages), l AS (SELECT page_id, stderr, CASE WHEN stdout = '' THEN []::VARCHAR[] ELSE string_split(rtrim(stdout, chr(10)), chr(10)) END AS ls,
CASE WHEN stderr = '' THEN []::VARCHAR[] ELSE string_split(rtrim(stderr, chr(10)), chr(10))[1:30] END AS es FROM o)"""


def _view(table, f) -> DataFrame:
    outputs = table("pages").select("page_id", F.expr(_OUT).alias("stdout"), F.expr(_ERR).alias("stderr"))
    return outputs.select("page_id", f(F.col("stdout"), F.col("stderr")).alias("v")).select("page_id", F.length("v").alias("chars"), F.md5(F.col("v")).alias("digest"))


def _view_sql(parts: str, errors: str) -> str:
    return f"WITH {_SPLIT}, v AS (SELECT page_id, array_to_string({parts} || CASE WHEN stderr = '' THEN []::VARCHAR[] ELSE {errors} || es END, chr(10)) AS v FROM l) SELECT page_id, length(v) AS chars, md5(v) AS digest FROM v"


@query(_view_sql("['### complexity warnings'] || list_filter(ls, lambda s: s LIKE '%CCN%')[1:180] || ['', '### summary'] || ls[greatest(len(ls) - 7, 1):]", "['', '### stderr']"))
def complexity_views(table):
    return _view(table, V.complexity_view)


@query(f"""WITH {_SPLIT}, v AS (SELECT page_id, array_to_string(['coverage_limitation: ' || CASE WHEN page_id % 3 = 1 THEN 'staticcheck-no-buildable-package: module has no buildable Go package for the configured analysis roots; coverage is reduced'
ELSE 'none (scan completed; zero diagnostics is valid)' END, 'findings_total: ' || len(ls), 'findings_after_generated_filter: ' || (len(ls) * 3 // 4)] || list_filter(ls, lambda s: NOT contains(s, 'docs/'))[1:180] || ['', 'stderr:'] || es, chr(10)) AS v FROM l)
SELECT page_id, length(v) AS chars, md5(v) AS digest FROM v""")
def static_views(table):
    return _view(table, V.static_view)


@query(_view_sql("list_filter(ls, lambda s: s LIKE 'GHSA%')[1:220]", "['', 'stderr:']"))
def advisory_views(table):
    return _view(table, V.advisory_view)


@query("SELECT p_partkey, 'z' || p_size AS name, '1.' || (p_partkey % 9) AS current FROM part UNION ALL SELECT p_partkey, 'a' || p_size, '2' FROM part")
def outdated_tables(table):
    rows = F.concat(F.lit('{"type":"info","data":"x"}\n{"type":"table","data":{"head":["n"],"body":[["z'), "p_size", F.lit('","1.'), F.col("p_partkey") % 9, F.lit('"],["a'), "p_size", F.lit('","2"]]}}\n'))
    return table("part").select("p_partkey", F.explode(V.table_rows(rows)).alias("r")).select("p_partkey", F.col("r")[0].alias("name"), F.col("r")[1].alias("current"))


_OUTPUTS = ("[{\"Name\":\"Go\",\"Code\":1}]", "[{\"Name\":\"Go\"}]", "{", "{\"a\":{\"current\":\"1\"}}", "{\"error\":{\"code\":\"E\"}}", "{\"code\":\"E\",\"summary\":\"s\"}", "{\"a\":1}", "[1]", "", "{\"type\":\"table\"}\n{\"type\":\"info\"}", "{\"type\":\"error\"}", "Found 3 clones.")
_PROBLEMS = {
    "totals": ("", "scc output must be a list of language rows", "invalid scc JSON") + ("scc output must be a list of language rows",) * 5 + ("invalid scc JSON",) * 2 + ("scc output must be a list of language rows", "invalid scc JSON"),
    "outdated": ("npm outdated output must be an object",) * 2 + ("invalid npm JSON", "", "npm emitted a structured error object", "npm output resembles an error response", "npm package rows must be objects", "npm outdated output must be an object", "", "invalid npm JSON", "npm package rows must be objects", "invalid npm JSON"),
    "listed": ("invalid yarn NDJSON",) * 3 + ("expected a table object, or an empty exit-0 stream",) * 4 + ("invalid yarn NDJSON", "", "", "yarn emitted an error object", "invalid yarn NDJSON"),
    "clones": ("jscpd console summary is missing 'Found N clones'",) * 11 + ("",),
}
_quoted = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("SELECT page_id, " + ", ".join(f"({_quoted(v)})[page_id % 12 + 1] AS {k}" for k, v in _PROBLEMS.items()) + " FROM pages")
def output_problems(table):
    text, zero = F.element_at(F.array(*map(F.lit, _OUTPUTS)), (F.col("page_id") % 12 + 1).cast("int")), F.lit(0)
    return table("pages").select("page_id", V.totals_problem(text).alias("totals"), V.outdated_problem(text, zero).alias("outdated"), V.table_problem(text, zero).alias("listed"), V.clones_problem(text).alias("clones"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'go list coverage partial: one or more packages reported a load Error' WHEN p_size % 4 = 1 THEN 'go list coverage partial: package load/resolution failure in diagnostics' ELSE '' END AS note FROM part""")
def load_limitations(table):
    stderr = F.when(F.col("p_size") % 4 == 1, "x: Cannot find package y").when(F.col("p_size") % 4 == 2, "fine")
    return table("part").select("p_partkey", V.load_limitation(F.col("p_size") % 4 == 0, stderr).alias("note"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN 'unavailable' ELSE 'recorded' END AS status, CASE WHEN c_custkey % 4 = 3 THEN c_mktsegment END AS value, CASE WHEN c_custkey % 4 < 3 THEN 'not measured' ELSE '' END AS reason FROM customer""")
def recorded_fields(table):
    value = F.when(F.col("c_custkey") % 4 == 0, "unknown").when(F.col("c_custkey") % 4 == 1, "").when(F.col("c_custkey") % 4 == 3, F.col("c_mktsegment"))
    return table("customer").select("c_custkey", V.recorded(value, "not measured").alias("r")).select("c_custkey", "r.*")


_NESTED = "named_struct('z', repeat('x', p_size * 10), 'a', sequence(1, p_size), 'm', map('k2', p_name, 'k1', p_type))"


@query("""SELECT p_partkey, least(p_size * 10, 240) AS chars, least(p_size, 12) AS items, 'a,m,z' AS fields, substr(p_type, 1, 240) AS first_entry FROM part""")
def compact_rows(table):
    rows = table("part").select("p_partkey", F.expr(_NESTED).alias("v"))
    c = rows.select("p_partkey", V.compact(F.col("v"), rows.schema["v"].dataType).alias("c"))
    names = ",".join(c.schema["c"].dataType.names)
    return c.select("p_partkey", F.length("c.z").alias("chars"), F.size("c.a").alias("items"), F.lit(names).alias("fields"), F.element_at(F.map_values("c.m"), 1).alias("first_entry"))


@query("""SELECT p_partkey, '{"a":' || p_size || ',"m":{"k1":"x","k2":"y"},"z":{"b":null,"c":"' || p_brand || '"}}' AS json FROM part""")
def canonical_rows(table):
    rows = table("part").select("p_partkey", F.expr("named_struct('z', named_struct('c', p_brand, 'b', cast(null as string)), 'm', map('k2', 'y', 'k1', 'x'), 'a', p_size)").alias("v"))
    return rows.select("p_partkey", V.canonical_json(F.col("v"), rows.schema["v"].dataType).alias("json"))


# Edits of a text: one that counts, one found twice, one of another check, one that adds too many words, one that may.
_EDITS = "array(named_struct('find', 'alpha', 'replacement', p_name, 'fixes', 'c1'), named_struct('find', 'dup', 'replacement', 'x', 'fixes', 'c1'), named_struct('find', 'beta', 'replacement', 'q', 'fixes', 'c9'), named_struct('find', 'beta', 'replacement', repeat('w ', 50), 'fixes', 'c1'), named_struct('find', 'beta', 'replacement', repeat('w ', 45), 'fixes', 'c2'))"


@query("""SELECT p_partkey, p_name || ' dup dup ' || repeat('w ', 45) AS text, '1:not found exactly once|2:check is not outstanding|3:too many words changed' AS rejected FROM part""")
def edited_texts(table):
    done = table("part").select("p_partkey", V.edited(F.lit("alpha dup dup beta"), F.expr(_EDITS), F.array(F.lit("c1"), F.lit("c2")), F.array(F.lit("c2"))).alias("e"))
    return done.select("p_partkey", "e.text", F.array_join(F.transform("e.rejected", lambda r: F.concat(r["edit"], F.lit(":"), r["reason"])), "|").alias("rejected"))


# Files by page: manifests, compose files, images, binaries, pipelines, policies.
_PATH = "CASE page_id % 8 WHEN 0 THEN 's' || page_id || '/package.json' WHEN 1 THEN 's' || page_id || '/go.mod' WHEN 2 THEN 's' || page_id || '/docker-compose.yml' WHEN 3 THEN 's' || (page_id % 50) || '/d' || page_id || '/build/Dockerfile' WHEN 4 THEN 's' || (page_id % 50) || '/main.go' WHEN 5 THEN 's' || page_id || '/.github/workflows/ci.yml' WHEN 6 THEN 's' || page_id || '/model.conf' ELSE 's' || page_id || '/rows.csv' END"
_TEXT = """CASE page_id % 8 WHEN 0 THEN '{"dependencies":{"pg":"^8","left":"1"},"devDependencies":{"left":"2","mongoose":"' || (page_id % 9) || '"}}' WHEN 1 THEN 'module x' || chr(10) || 'require github.com/acme/a v1.' || page_id || chr(10) || 'require (' || chr(10) || chr(9) || 'gorm.io/gorm v1.2 // indirect' || chr(10) || ')'
WHEN 2 THEN 'version: 3' || chr(10) || '# c' || chr(10) || 'services:' || chr(10) || '  api' || (page_id % 40) || ':' || chr(10) || '    build: .' || chr(10) || '  db:' || chr(10) || '    image: "pg:' || (page_id % 5) || '"' || chr(10) || 'volumes:' || chr(10) || '  data:' WHEN 3 THEN 'FROM x'
WHEN 4 THEN CASE WHEN page_id % 3 = 0 THEN 'package main' || chr(10) || 'func main() {}' ELSE 'package lib' END WHEN 5 THEN CASE WHEN page_id % 3 = 0 THEN 'kubectl apply' ELSE 'test' END WHEN 6 THEN '[matchers]' || chr(10) || 'm = 1' ELSE 'p, a, b' || chr(10) || 'x' END"""


def _files(table) -> DataFrame:
    return table("pages").select(F.expr(_PATH).alias("path"), F.expr(_TEXT).alias("text"))


@query("""WITH f AS (SELECT page_id, 's' || page_id || '/package.json' AS path FROM pages WHERE page_id % 8 = 0) SELECT path, 'pg' AS package, '^8' AS version, 'dependencies' AS section FROM f UNION ALL SELECT path, 'left', '2', 'devDependencies' FROM f UNION ALL SELECT path, 'mongoose', (page_id % 9)::VARCHAR, 'devDependencies' FROM f""")
def declared_packages(table):
    return M.declared_packages(_files(table))


@query("SELECT 's' || page_id || '/go.mod' AS path, 2 AS line, 'github.com/acme/a' AS package FROM pages WHERE page_id % 8 = 1")
def direct_requirements(table):
    return M.go_requirements(_files(table), indirect=False)


@query("""WITH e AS (SELECT 'sequelize' AS family, 's' || page_id || '/package.json' AS path FROM pages WHERE page_id % 8 = 0 UNION ALL SELECT 'mongoose', 's' || page_id || '/package.json' FROM pages WHERE page_id % 8 = 0 UNION ALL SELECT 'gorm', 's' || page_id || '/go.mod' FROM pages WHERE page_id % 8 = 1 UNION ALL SELECT 'sql', 'db/' || page_id || '.sql' FROM pages WHERE page_id % 8 = 7)
SELECT family, count(*) AS files, array_to_string(list_sort(list(path))[1:8], ',') AS evidence FROM e GROUP BY family""")
def store_families(table):
    f = _files(table)
    packages = M.declared_packages(f).select("path", "package").unionByName(M.go_requirements(f).select("path", "package"))
    families = f.sparkSession.createDataFrame([("pg", "sequelize"), ("mongoose", "mongoose"), ("gorm.io/gorm", "gorm")], "package string, family string")
    scripts = table("pages").filter("page_id % 8 = 7").select(F.concat(F.lit("db/"), "page_id", F.lit(".sql")).alias("path"))
    return M.store_families(packages, families, scripts).withColumn("evidence", F.array_join("evidence", ","))


@query("""WITH f AS (SELECT page_id, 's' || page_id || '/docker-compose.yml' AS path FROM pages WHERE page_id % 8 = 2) SELECT path, 'api' || (page_id % 40) AS service, true AS built_here, NULL AS image FROM f UNION ALL SELECT path, 'db', false, 'pg:' || (page_id % 5) FROM f""")
def compose_services(table):
    return M.compose_services(_files(table))


@query("""WITH u AS (SELECT 'container-image' AS kind, '.' AS name, 's' || (page_id % 50) || '/d' || page_id || '/build/Dockerfile' AS e FROM pages WHERE page_id % 8 = 3 UNION ALL SELECT 'go-main-binary', 's' || (page_id % 50), 's' || (page_id % 50) || '/main.go' FROM pages WHERE page_id % 8 = 4 AND page_id % 3 = 0
UNION ALL SELECT 'ci-deploy-step', 's' || page_id || '/.github/workflows/ci.yml', 's' || page_id || '/.github/workflows/ci.yml' FROM pages WHERE page_id % 8 = 5 AND page_id % 3 = 0 UNION ALL SELECT 'compose-service', unnest(['db', 'api' || (page_id % 40)]), 's' || page_id || '/docker-compose.yml' FROM pages WHERE page_id % 8 = 2)
SELECT kind, name, min(e) AS evidence FROM u GROUP BY 1, 2""")
def deployable_units(table):
    return M.deployable_units(_files(table))


@query("""SELECT 's' || page_id || CASE WHEN page_id % 8 = 6 THEN '/model.conf' ELSE '/rows.csv' END AS path, CASE WHEN page_id % 8 = 6 THEN 'casbin-model' ELSE 'casbin-policy' END AS kind FROM pages WHERE page_id % 8 >= 6""")
def policy_files(table):
    return M.policy_files(_files(table))


@query("""WITH r AS (SELECT p_brand, p_name, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey, p_size <= 25 AS readable, n > 30 AS cap_hit FROM r WHERE rn <= 30""")
def bounded_files(table):
    return M.bounded_files(table("part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_partkey", "p_size", 30, 25).select("p_brand", "p_partkey", "readable", "cap_hit")


@query("""WITH t AS (SELECT DISTINCT p_brand, 'a/f' || lpad(p_partkey::VARCHAR, 9, '0') || '_test.go' AS path FROM part WHERE p_size % 2 = 0) SELECT p_brand, count(*) AS total_count, least(count(*), 15) AS included_count, count(*) > 15 AS truncated, array_to_string(list_sort(list(path))[1:15], ',') AS paths FROM t GROUP BY 1""")
def tests_of_groups(table):
    path = F.concat(F.lit("a/f"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.when(F.col("p_size") % 2 == 0, "_test.go").otherwise(".go"))
    return M.tests_of(table("part").select("p_brand", path.alias("path")), "p_brand", most=15).withColumn("paths", F.array_join("paths", ","))


@query("""WITH r AS (SELECT page_id, page_id % 6 AS k FROM pages) SELECT page_id, ['ok', 'unsafe path', 'environment file', 'no such file', 'other revision', 'line out of range'][k + 1] AS status, CASE WHEN k = 0 THEN 'line 2' || chr(10) || 'token=<REDACTED>' || chr(10) || 'line 4' END AS excerpt FROM r""")
def source_excerpts(table):
    k = F.col("page_id") % 6
    path = F.when(k == 1, "../x").when(k == 2, "a/.env").when(k == 3, "none.go").otherwise("a.go")
    refs = table("pages").select("page_id", F.lit("r").alias("repository"), path.alias("path"), F.when(k == 5, 9).otherwise(3).alias("line"), F.when(k == 4, "zz").otherwise("AB1").alias("revision"))
    files = refs.sparkSession.createDataFrame([("r", "a.go", "ab1", "line 1\nline 2\ntoken=abcdef\nline 4\nline 5\n")], "repository string, path string, revision string, text string")
    return M.excerpts(refs, files, ["repository"], "path", "line", "revision", "text", around=1).select("page_id", "status", "excerpt")
