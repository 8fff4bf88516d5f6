"""Queries on source files, packages, clones and reports, made from the tables' rows, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import sources as S
from strataline.operators import dependencies as D
from strataline.operators import extraction as X
from strataline.plans.registry import query

# Source files from the pages' numbers, as expressions that both dialects read the same way.
_Q, _N, _T = "chr(39)", "chr(10)", "chr(96)"
_PATH = "CASE page_id % 3 WHEN 0 THEN 'svc/f' || page_id || '.go' ELSE 'web/f' || page_id || '.ts' END"
_GO = f"""'import (' || {_N} || chr(9) || '"github.com/acme' || (page_id % 4) || '/lib/sub"' || {_N} || ')' || {_N} || {_N} || 'func f() {{ r.GET("/v1/things/' || (page_id % 7) || '", h) }}' || {_N}
|| 'g.Group("/admin"); k = os.Getenv("KEY_' || (page_id % 5) || '")' || {_N} || 'u = "https://h' || (page_id % 6) || '.acme.io/x"'"""
_JS = f"""'import a from ' || {_Q} || 'pkg' || (page_id % 3) || '/sub' || {_Q} || ';' || {_N} || 'const v = config.base' || (page_id % 4) || ';' || {_N} || 'router.post(' || {_Q} || '/v1/items/' || (page_id % 7) || {_Q} || ', h);' || {_N}
|| 'http.get(' || {_T} || '$' || '{{v}}/items/' || page_id || {_T} || '); k = process.env.KEY_' || (page_id % 5) || {_N} || 'const {{ other, third: w }} = config;' || {_N} || 'y(' || {_T} || '$' || '{{w}}/z/' || (page_id % 9) || {_T} || '); z(' || {_T} || '$' || '{{config.main}}/top' || {_T} || ')'"""
_TEXT = f"CASE page_id % 3 WHEN 0 THEN {_GO} ELSE {_JS} END".replace("{{", "{").replace("}}", "}")
_LINES = f"""f AS (SELECT {_PATH} AS path, {_TEXT} AS text FROM pages), l AS (SELECT path, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM f)"""


def _files(table) -> DataFrame:
    return table("pages").select(F.expr(_PATH).alias("path"), F.expr(_TEXT).alias("text"))


@query(f"""WITH {_LINES} SELECT path, line, upper(CASE WHEN path LIKE '%.go' THEN 'GET' ELSE 'POST' END) AS method, regexp_extract(s, '(/v1/[a-z]+/[0-9]+)', 1) AS route FROM l WHERE regexp_matches(s, '(r.GET|router.post)')""")
def source_routes(table):
    return X.route_registrations(_files(table))


@query(f"""WITH {_LINES}, c AS (SELECT path, line, unnest(regexp_extract_all(s, '\\$\\{{(config\\.)?[a-z]+\\}}/[a-z0-9/]+')) AS m, s FROM l WHERE path LIKE '%.ts')
SELECT path, line, CASE WHEN m LIKE '${{v}}%' THEN 'base' || (regexp_extract(path, 'f([0-9]+)', 1)::BIGINT % 4) WHEN m LIKE '${{w}}%' THEN 'third' ELSE 'main' END AS base, regexp_extract(m, '\\}}(.*)', 1) AS call_path, CASE WHEN m LIKE '${{v}}%' THEN 'GET' ELSE '' END AS method FROM c""")
def source_calls(table):
    return X.ui_calls(_files(table))


@query("""WITH c AS (SELECT DISTINCT 'base' || (page_id % 4) AS base, 'items/' || page_id AS p FROM pages WHERE page_id % 3 <> 0 UNION SELECT DISTINCT 'third', 'z/' || (page_id % 9) FROM pages WHERE page_id % 3 <> 0 UNION SELECT 'main', 'top')
SELECT base, array_to_string(list_sort(list(p)), '|') AS paths FROM c GROUP BY base""")
def calls_by_base(table):
    return X.calls_by_base(X.ui_calls(_files(table))).select("base", F.array_join("paths", "|").alias("paths"))


@query(f"""WITH {_LINES} SELECT path, line, CASE WHEN path LIKE '%.go' THEN regexp_extract(s, '"([^"]*)/sub"', 1) ELSE regexp_extract(s, '(pkg[0-9])', 1) END AS package FROM l WHERE s LIKE '%github.com%' OR s LIKE 'import a%'""")
def source_imports(table):
    return X.imports(_files(table))


@query(f"""WITH {_LINES} SELECT path, line, regexp_extract(s, '(KEY_[0-9])', 1) AS name FROM l WHERE s LIKE '%KEY_%'""")
def source_environment(table):
    return X.environment(_files(table))


@query(f"""WITH {_LINES} SELECT path, line, regexp_extract(s, '(h[0-9].acme.io)', 1) AS host FROM l WHERE s LIKE '%https%'""")
def source_hosts(table):
    return X.hosts(_files(table))


_NAMES = "['api/a.go', 'api/a_test.go', 'web/test/x.ts', 'web/a.d.ts', 'web/b.spec.tsx', 'web/mocks/m.js', 'node_modules/q/i.js', 'web/vite.config.ts', 'db/migrations/1.go', 'api/p.pb.go', 'web/.eslintrc.js', 'legacy/old.js', 'web/c.stories.tsx', 'api/mock_db.go', 'readme.md', 'web/out/z.mjs', '.env.local', 'Makefile', 'yarn.lock', 'lib/v.min.js', 'a/config', '.']"
_REASONS = "['', 'test', 'test', 'declaration', 'test', 'mock', 'vendored', 'config', 'migration-or-seed', 'generated', 'config', 'tier2-excluded', 'fixture-or-example', 'mock', '', 'build-output', '', '', '', '', '', '']"
_EXTENSIONS = "['.go', '.go', '.ts', '.d.ts', '.tsx', '.js', '.js', '.ts', '.go', '.go', '.js', '.js', '.tsx', '.go', '', '.mjs', '', '', '', '.js', '', '']"


def _paths(table) -> DataFrame:
    values = [x.strip(" '") for x in _NAMES.strip("[]").split(",")]
    return table("pages").select(F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int")).alias("path"), F.lit("package x").alias("text"))


@query(f"""WITH x AS (SELECT ({_NAMES})[page_id % 22 + 1] AS path, ({_REASONS})[page_id % 22 + 1] AS reason, ({_EXTENSIONS})[page_id % 22 + 1] AS extension FROM pages)
SELECT extension, reason, count(*) AS files FROM x WHERE extension <> '' GROUP BY 1, 2""")
def production_sources(table):
    return X.production_files(_paths(table), text="text", tier2=("legacy",)).groupBy("extension", "reason").agg(F.count("*").alias("files"))


@query(f"""WITH x AS (SELECT ({_NAMES})[page_id % 22 + 1] AS path FROM pages) SELECT path, count(*) AS files, path IN ('node_modules/q/i.js', 'legacy/old.js', 'yarn.lock', 'lib/v.min.js') AS outside,
path IN ('api/a_test.go', 'web/test/x.ts', 'web/b.spec.tsx') AS is_test, path = '.env.local' AS is_env, path NOT IN ('.', '.env.local') AS is_label FROM x GROUP BY path""")
def path_predicates(table):
    p = F.col("path")
    return _paths(table).groupBy("path").agg(F.count("*").alias("files")).withColumns({"outside": S.outside_sources(p, ("legacy/",)), "is_test": S.is_test(p), "is_env": S.is_env_file(p), "is_label": S.is_source_label(p)})


_HOSTS = "['api.acme.io', 'acme.com', 'avatar.url', 'styles.css', 'pj.id', 'api.vendor.id', 'localhost', 'db.local', 'www.w3.org', 'x.bs.carousel', 'tag.name', 'svc.acme.dev']"


@query(f"""WITH x AS (SELECT ({_HOSTS})[page_id % 12 + 1] AS host FROM pages) SELECT host, count(*) AS n, host IN ('api.acme.io', 'acme.com', 'api.vendor.id', 'svc.acme.dev') AS public FROM x GROUP BY host""")
def host_fragments(table):
    values = [x.strip(" '") for x in _HOSTS.strip("[]").split(",")]
    host = F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int")).alias("host")
    return table("pages").select(host).groupBy("host").agg(F.count("*").alias("n")).withColumn("public", S.is_host(F.col("host")))


@query("""SELECT c_custkey, c_custkey % 5 IN (0, 2) AS bot FROM customer""")
def bot_authors(table):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table("customer").select("c_custkey", S.is_bot(pick("dependabot[bot]", "Ann Renoir", "Build", "Robot Smith", "Bob"), pick("x@y", "a@b", "circleci@x", "r@s", "noreply@x.org")).alias("bot"))


# Packages: brands import the brands and containers of their parts.
_PACKAGES = """p AS (SELECT 'acme.io/' || p_brand AS package, list_sort(list(DISTINCT d)) AS imports FROM (SELECT p_brand, 'acme.io/Brand#' || (p_partkey % 60) AS d FROM part UNION SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN 'ext.org/c' || (p_size % 5) ELSE 'fmt' END FROM part) GROUP BY 1),
e AS (SELECT package AS src, unnest(imports) AS dst FROM p), g AS (SELECT src, dst, dst IN (SELECT package FROM p) AS internal FROM e WHERE dst IN (SELECT package FROM p) OR dst LIKE '%.%/%')"""


def _packages(table) -> DataFrame:
    own, other = F.concat(F.lit("acme.io/Brand#"), F.col("p_partkey") % 60), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ext.org/c"), F.col("p_size") % 5)).otherwise("fmt")
    rows = table("part").select(F.concat(F.lit("acme.io/"), "p_brand").alias("ImportPath"), F.array(own, other).alias("Imports"))
    return D.go_packages(rows.unionByName(rows.limit(1).withColumn("ImportPath", F.lit("other.io/x"))), "acme.io")


@query(f"WITH {_PACKAGES} SELECT * FROM g")
def package_graph(table):
    return D.package_graph(_packages(table))


@query(f"""WITH {_PACKAGES}, i AS (SELECT * FROM g WHERE internal) SELECT * FROM (SELECT 'fan_out' AS side, src AS id, count(*) AS n FROM i GROUP BY src ORDER BY n DESC, id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'fan_in' AS side, dst AS id, count(*) AS n FROM i GROUP BY dst ORDER BY n DESC, id LIMIT 20)""")
def package_fans(table):
    return D.top_fans(D.package_graph(_packages(table)).filter("internal"), "src", "dst")


@query("""WITH e AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN './m' || (l_partkey % 50) WHEN 1 THEN 'npm-' || (l_partkey % 30) WHEN 2 THEN 'src/n' ELSE '@app/z' END AS m, l_returnflag = 'R' AS u, l_linestatus = 'O' AS c, l_linenumber % 4 = 1 AS x FROM lineitem)
SELECT count(*) AS edges, count(*) FILTER (u) AS unresolved, count(*) FILTER (c) AS circular, count(DISTINCT CASE WHEN x THEN m END) AS externals, count(*) FILTER (NOT x) AS internal_edges, count(*) FILTER (NOT x AND u) AS internal_unresolved,
count(*) FILTER (NOT x AND u) > 0.15 * count(*) FILTER (NOT x) AS partial FROM e""")
def dependency_totals(table):
    k = F.col("l_linenumber") % 4
    spec = F.when(k == 0, F.concat(F.lit("./m"), F.col("l_partkey") % 50)).when(k == 1, F.concat(F.lit("npm-"), F.col("l_partkey") % 30)).when(k == 2, "src/n").otherwise("@app/z")
    one = F.struct(spec.alias("module"), (F.col("l_returnflag") == "R").alias("couldNotResolve"), (F.col("l_linestatus") == "O").alias("circular"), F.array(F.when(k == 1, "npm-dev").otherwise("local")).alias("dependencyTypes"))
    edges = D.module_edges(table("lineitem").select(F.col("l_orderkey").alias("source"), F.array(one).alias("dependencies")))
    return D.dependency_totals(edges, "module", F.col("couldNotResolve"), F.col("circular"), F.col("dependencyTypes"))


@query("""SELECT CASE WHEN p_size % 3 = 0 THEN 'internal' WHEN p_size % 3 = 1 THEN 'third-party' ELSE 'stdlib' END AS class, count(*) AS n FROM part GROUP BY 1""")
def reference_counts(table):
    spec = F.element_at(F.array(F.lit("acme.io/m/x"), F.lit("ext.org/y"), F.lit("net/http")), (F.col("p_size") % 3 + 1).cast("int"))
    return D.reference_counts(table("part").withColumn("spec", spec), "spec", F.lit("acme.io/m"))


_CLONES = """SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'ts' ELSE 'css' END AS format, CASE WHEN event_id % 5 = 0 THEN 'cross-repo' ELSE 'within-repo' END AS scope, 'f' || (user_id % 7) AS a_file, 'f' || (event_id % 7) AS b_file,
event_id % 90 AS span, CASE WHEN user_id % 4 = 0 THEN 'unresolved' ELSE 'resolved' END AS a_status, 'resolved' AS b_status FROM events"""


def _clones(table) -> DataFrame:
    return table("events").select(*[F.expr(x).alias(n) for x, n in (x.strip().rsplit(" AS ", 1) for x in _CLONES.removeprefix("SELECT ").removesuffix(" FROM events").replace("\n", " ").split(", "))])


@query(f"""WITH c AS ({_CLONES}) SELECT 'format' AS dimension, format AS value, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'scope', scope, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'endpoint', s, count(*) FROM (SELECT a_status AS s FROM c UNION ALL SELECT b_status FROM c) GROUP BY s""")
def clone_tallies(table):
    return D.clone_tallies(_clones(table))


@query(f"WITH c AS ({_CLONES}) SELECT * FROM c WHERE scope <> 'within-repo' OR a_file <> b_file ORDER BY span DESC, seq LIMIT 60")
def crossing_clones(table):
    return D.crossing_clones(_clones(table))


@query("""SELECT l_partkey, count(*) AS commits, sum(n)::BIGINT AS total_lines FROM (SELECT l_partkey, l_orderkey, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1 ORDER BY commits DESC, total_lines DESC, l_partkey LIMIT 20""")
def churn_order(table):
    from strataline.operators.history import churn

    log = table("lineitem").withColumns({"a": F.col("l_quantity").cast("long"), "d": F.lit(0)})
    return D.churn_order(churn(log, "l_orderkey", "l_partkey", "a", "d"), "l_partkey", 20).select("l_partkey", "commits", "total_lines")


_PAIRS = "SELECT p_brand AS item_a, p_type AS item_b, count(*) AS shared, 50 AS revs_a, 30 + min(p_size) AS revs_b FROM part GROUP BY 1, 2"


@query(f"SELECT *, round(100.0 * shared / ((revs_a + revs_b) / 2.0), 1)::DOUBLE AS percent FROM ({_PAIRS}) ORDER BY percent DESC, shared DESC, item_a, item_b LIMIT 40")
def coupling_order(table):
    pairs = table("part").groupBy(F.col("p_brand").alias("item_a"), F.col("p_type").alias("item_b")).agg(F.count("*").alias("shared"), F.lit(50).alias("revs_a"), (F.min("p_size") + 30).alias("revs_b"))
    return D.coupling_order(pairs, 40)


@query("""SELECT o_orderkey, o_orderpriority, o_orderstatus, o_custkey % 7 AS modules FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_custkey % 7 DESC, o_orderkey LIMIT 50""")
def finding_order(table):
    rows = table("orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("confidence"), (F.col("o_custkey") % 7).alias("modules"))
    return D.finding_order(rows, ["1-URGENT", "2-HIGH"], ["F", "O"], "modules", "o_orderkey", 50).select("o_orderkey", F.col("priority").alias("o_orderpriority"), F.col("confidence").alias("o_orderstatus"), "modules")


@query("""SELECT array_to_string(m, '>') AS cycle FROM (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN ['n' || n_nationkey, 'n' || n_regionkey] ELSE ['n' || n_nationkey, 'n' || n_regionkey, 'z'] END AS m FROM nation) ORDER BY len(m), m LIMIT 15""")
def cycle_order(table):
    n = lambda c: F.concat(F.lit("n"), c)
    m = F.when(F.col("n_nationkey") % 2 == 0, F.array(n("n_nationkey"), n("n_regionkey"))).otherwise(F.array(n("n_nationkey"), n("n_regionkey"), F.lit("z")))
    return D.cycle_order(table("nation").select(m.alias("m")).distinct(), "m", 15).select(F.array_join("m", ">").alias("cycle"))


_MARKDOWN = "'intro words' || chr(10) || '## First ' || (p_partkey % 3) || chr(10) || p_name || chr(10) || '### Deeper' || chr(10) || p_type || chr(10) || '## Second' || chr(10) || p_brand"


@query(f"""WITH d AS (SELECT p_partkey, p_name, p_type, p_brand FROM part), w AS (SELECT p_partkey, 'First ' || (p_partkey % 3) AS heading, p_name || ' ### Deeper ' || p_type AS body FROM d UNION ALL SELECT p_partkey, 'Second', p_brand FROM d)
SELECT p_partkey, heading, len(list_filter(string_split_regex(body, '\\s+'), lambda s: s <> ''))::INT AS words FROM w""")
def section_words(table):
    return D.section_words(table("part").select("p_partkey", F.expr(_MARKDOWN).alias("text")), "p_partkey", "text")


@query("""SELECT p_partkey, len(regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) / 250.0::DOUBLE + (p_size % 4) / 500.0::DOUBLE AS minutes FROM part""")
def reading_minutes(table):
    text = F.concat(F.col("p_name"), F.lit("\n| a | table |\n"), F.col("p_type"), F.lit(" "), F.expr("repeat('漢', p_size % 4)"), F.lit("\n```\ncode here\n```\n"))
    return table("part").select("p_partkey", S.reading_minutes(text).alias("minutes"))


@query("SELECT o_custkey AS survivor, array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS absorbed FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey <> o_orderkey GROUP BY 1")
def absorbed_findings(table):
    rows = table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("into"))
    return D.absorbed(rows, "o_orderkey", "into").select("survivor", F.array_join(F.col("absorbed").cast("array<string>"), ",").alias("absorbed"))


@query("""WITH x AS (SELECT 'f' || lpad(p_partkey::VARCHAR, 9, '0') AS path, '.' || (p_size % 6) AS ext FROM part WHERE p_size % 6 NOT IN (1, 2)), r AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY path) rn FROM x)
SELECT ext, count(*) AS files, array_to_string(list_sort(list(path) FILTER (rn <= 3)), ',') AS samples FROM r GROUP BY ext""")
def unclassified_files(table):
    files = table("part").select(F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path"), F.concat(F.lit("."), F.col("p_size") % 6).alias("ext"))
    return D.unclassified(files, "path", "ext", [".1", ".2"]).withColumn("samples", F.array_join("samples", ","))


@query("""WITH r AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) rn FROM part) SELECT p_brand, avg(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) AS ratio, avg(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) >= 0.8 AS generated FROM r WHERE rn <= 8 GROUP BY 1""")
def marker_ratio(table):
    return D.marker_ratio(table("part"), "p_brand", "p_partkey", F.col("p_size") > 10, 8)


@query("SELECT l_orderkey, l_suppkey, min(l_partkey) AS first_line, max(l_partkey) AS last_line FROM lineitem GROUP BY 1, 2")
def evidence_spans(table):
    return D.spans(table("lineitem"), ["l_orderkey", "l_suppkey"], "l_partkey")


@query("""WITH m AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey % 2 = 0) SELECT l_orderkey, coalesce(array_to_string(list_sort(list(DISTINCT c_nationkey) FILTER (c_nationkey IS NOT NULL)), ','), '') AS modules, count(c_nationkey) = 0 AS tail FROM (SELECT l_orderkey, l_suppkey AS k FROM lineitem) LEFT JOIN m ON c_custkey = k GROUP BY 1""")
def rekeyed_findings(table):
    findings = table("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("affected"))
    owners = table("customer").filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return D.rekeyed(findings, owners, "l_orderkey", "affected", "k", "c_nationkey").withColumn("modules", F.array_join(F.col("modules").cast("array<string>"), ","))


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 8 = 0 THEN 'X' ELSE o_orderstatus END AS recorded FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 8 = 0""")
def inconsistent_status(table):
    o = table("orders").select("o_orderkey", "o_orderstatus")
    manifest = o.filter("o_orderkey % 9 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 8 == 0, "X").otherwise(F.col("o_orderstatus")))
    return D.inconsistent(o, manifest, ["o_orderkey"], "o_orderstatus")


@query("""SELECT l_orderkey, CASE WHEN l_suppkey % 2 = 0 THEN 'S' || l_suppkey ELSE 's' || l_suppkey END AS src, CASE WHEN l_partkey % 2 = 0 THEN 'S' || l_partkey ELSE 's' || l_partkey END AS dst FROM lineitem""")
def natural_edges(table):
    ids = table("lineitem").select(F.explode(F.array("l_suppkey", "l_partkey")).alias("k")).distinct().filter("k % 2 = 0")
    keys = ids.select(F.concat(F.lit("s"), "k").alias("id"), F.concat(F.lit("S"), "k").alias("key"))
    edges = table("lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("s"), "l_partkey").alias("dst"))
    return D.natural_edges(edges, keys, "src", "dst", "id", "key").select("l_orderkey", "src", "dst")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'second' END AS o_orderstatus FROM orders""")
def united_fragments(table):
    o = table("orders").select("o_orderkey", "o_orderstatus")
    return D.united(o.filter("o_orderkey % 2 = 0"), o.withColumn("o_orderstatus", F.lit("second")), keys=["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25")
def claimable_tasks(table):
    return D.claimable(table("orders").withColumn("ready", F.col("o_orderstatus") == "O"), "ready", "o_orderkey", 25).select("o_orderkey")


@query("""SELECT conv_id, turn FROM conversations WHERE turn % 3 = 2 OR text IS NULL""")
def unsupported_quotes(table):
    lines = table("conversations").select("conv_id", "turn", F.concat(F.lit("He  said "), "text").alias("line"))
    quotes = table("conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "never said this ¶").otherwise("said").alias("quote"))
    return D.unsupported_quotes(quotes, lines, ["conv_id", "turn"], "quote", "line").select("conv_id", "turn")


_REFERENCE = "CASE page_id % 4 WHEN 0 THEN 'repo' || (page_id % 5) || '@abc:src/a.go:' || page_id WHEN 1 THEN 'repo@abc:src/a.go' WHEN 2 THEN '@abc:a.go:3' ELSE 'x@y@1f:p/q.ts:7' END"


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'repo' || (page_id % 5) WHEN 3 THEN 'x@y' END AS repository, CASE page_id % 4 WHEN 0 THEN 'abc' WHEN 3 THEN '1f' END AS revision, CASE page_id % 4 WHEN 0 THEN 'src/a.go' WHEN 3 THEN 'p/q.ts' END AS path, CASE page_id % 4 WHEN 0 THEN page_id WHEN 3 THEN 7 END::INT AS line FROM pages""")
def source_references(table):
    return table("pages").select("page_id", S.source_reference(F.expr(_REFERENCE)).alias("r")).select("page_id", "r.*")


@query("""SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'a/b@1f:c.go:' || page_id || '|z@2:d.ts' ELSE 'z@2:d.ts' END AS refs FROM pages""")
def references_in_prose(table):
    prose = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("See (a/b@1f:c.go:"), "page_id", F.lit("), z@2:d.ts."))).otherwise(F.lit("z@2:d.ts, again z@2:d.ts!"))
    return table("pages").select("page_id", F.array_join(S.references_in(prose), "|").alias("refs"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_custkey::VARCHAR ELSE '' END AS label FROM customer""")
def node_labels(table):
    k = F.col("c_custkey") % 3
    rows = table("customer").select("c_custkey", F.when(k == 0, F.col("c_mktsegment")).otherwise("").alias("a"), F.lit(None).cast("string").alias("b"), F.when(k < 2, F.col("c_custkey")).alias("c"))
    return rows.select("c_custkey", S.first_filled("a", "b", "c").alias("label"))


@query("""WITH a AS (SELECT DISTINCT p_name AS s FROM part), b AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN p_name || ' new' ELSE p_name END AS s FROM part)
SELECT s AS prose, 'removed' AS side FROM (SELECT s FROM a EXCEPT SELECT s FROM b) UNION ALL SELECT s, 'added' FROM (SELECT s FROM b EXCEPT SELECT s FROM a)""")
def prose_diff(table):
    from strataline.functions.names import scrubbed
    from strataline.operators.compare import rowset_diff

    base = table("part").select(scrubbed(F.concat(F.lit("/home/x/"), "p_name"), {"/home/x/": ""}).alias("prose"))
    new = table("part").select(F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name")).alias("prose"))
    return rowset_diff(base, new)
