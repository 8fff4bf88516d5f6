"""The assembled model of five differently shaped sources, made from the tables' rows, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators import assembly as A
from strataline.plans.registry import query

_cat = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _repositories(table) -> DataFrame:
    n = table("nation")
    name, head = F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).otherwise(""), F.when(F.col("n_regionkey") > 0, _cat("h", F.col("n_regionkey")))
    return n.select(_cat("r", F.col("n_nationkey")).alias("repository"), name.alias("name"), head.alias("head"), F.to_variant_object(F.struct(F.col("n_regionkey").alias("region"), F.lit(True).alias("is_git"))).alias("attrs"))


def _calls(table) -> DataFrame:
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    a, b = _cat("r", s % 25, "@h:"), _cat("r", p % 27, "@h:")
    return table("lineitem").select(
        F.lit("go").alias("lang"), F.when(F.col("l_returnflag") == "N", "observed").otherwise("guess").alias("resolution"), F.col("l_linestatus").alias("kind"),
        _cat("f", p % 50).alias("caller_symbol"), F.concat(a, _cat("src/a", p % 20, ".go:", p % 50)).alias("caller_citation"),
        _cat("g", s % 7).alias("callee_symbol"), F.concat(b, _cat("src/b", s % 10, ".go:", s % 7)).alias("callee_citation"),
        F.concat(a, _cat("src/c", F.col("l_linenumber"), ".go:", F.col("l_quantity").cast("int"))).alias("callsite_citation"),
    )


def _imports(table) -> DataFrame:
    k = F.col("o_orderkey")
    one = F.struct(_cat("m", k % 30).alias("module"), _cat("src/a", k % 23, ".go").alias("resolved"), (F.col("o_orderstatus") == "F").alias("circular"), F.lit(None).cast("boolean").alias("in_repo"), (F.col("o_orderstatus") != "P").alias("local"))
    rows = table("orders").select(_cat("r", F.col("o_custkey") % 25).alias("repository"), F.lit("h").alias("head"), _cat("src/a", F.col("o_custkey") % 20, ".go").alias("source"), one.alias("d"))
    return rows.distinct().groupBy("repository", "head", "source").agg(F.collect_list("d").alias("dependencies"))


def _stores(table) -> DataFrame:
    # distinct as numbers, which are hashed in place; texts are made of what is left
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    rows = table("lineitem").select((F.col("l_suppkey") % 30).alias("r"), (F.col("l_partkey") % 15).alias("t"), code.alias("code"), F.col("l_linenumber").alias("d"), F.col("l_quantity").cast("int").alias("line")).distinct()
    access = F.when(F.col("code") == 0, "declaration").when(F.col("code") == 1, "read").otherwise("write")
    return rows.select(_cat("r", F.col("r")).alias("repository"), F.lit("").alias("head"), _cat("t", F.col("t")).alias("store"), access.alias("access"), _cat("src/d", F.col("d"), ".go:", F.col("line")).alias("site"))


def _facts(table) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    label = F.when(e % 2 == 0, _cat(',"target_label":"K', e % 9, '"')).otherwise("")
    data = F.when(kind == "error", F.concat(_cat('{"target_kind":"external-boundary","target_key":["k', e % 9, '"]'), label, F.lit("}"))).otherwise(F.col("props"))
    named = F.when(kind == "error", "dependency").when(kind == "purchase", "route").when(kind == "signup", "data-store").otherwise("note")
    return table("events").select(_cat("r", F.col("user_id") % 25).alias("repository"), F.lit(None).cast("string").alias("name"), named.alias("kind"), _cat("e", e).alias("fact_id"), F.parse_json(data).alias("data"), F.array(_cat("ev", e)).alias("evidence"))


def _parts(table) -> list[DataFrame]:
    return [A.repositories(_repositories(table)), A.calls(_calls(table)), A.module_imports(_imports(table)), A.stores(_stores(table)), A.facts(_facts(table))]


def _summed(df: DataFrame) -> DataFrame:
    return df.withColumns({"n_evidence": F.size("evidence"), "evidence": F.md5(F.array_join("evidence", ",").cast("binary"))})


# id and file nodes, as the sources give them; each row of p is one part of a source
_SOURCES = """WITH c AS (SELECT 'r' || l_suppkey % 25 AS ra, 'r' || l_partkey % 27 AS rb, 'src/a' || l_partkey % 20 || '.go' AS fa, 'src/b' || l_suppkey % 10 || '.go' AS fb, 'src/c' || l_linenumber || '.go' AS fs,
  'f' || l_partkey % 50 AS sa, 'g' || l_suppkey % 7 AS sb, CASE l_returnflag WHEN 'N' THEN 'observed' ELSE 'guess' END AS resolution, l_linestatus AS kind, l_partkey % 50 AS la, l_suppkey % 7 AS lb, l_quantity::INT AS ls FROM lineitem
), calls AS (SELECT DISTINCT *, ra || '@h:' || fa || ':' || la AS ca, rb || '@h:' || fb || ':' || lb AS cb, ra || '@h:' || fs || ':' || ls AS cs FROM c
), o AS (SELECT DISTINCT 'r' || o_custkey % 25 AS r, 'src/a' || o_custkey % 20 || '.go' AS src, 'm' || o_orderkey % 30 AS spec, 'src/a' || o_orderkey % 23 || '.go' AS dst, o_orderstatus = 'F' AS circular, o_orderstatus <> 'P' AS local FROM orders
), imports AS (SELECT o.*, local AND (r, dst) IN (SELECT (r, src) FROM o) AS internal, concat_ws(chr(0), r, src, spec, dst, circular::VARCHAR) AS ord FROM o
), s AS (SELECT DISTINCT 'r' || l_suppkey % 30 AS r, 't' || l_partkey % 15 AS store, CASE l_returnflag WHEN 'A' THEN 'declaration' WHEN 'R' THEN 'read' ELSE 'write' END AS access, 'src/d' || l_linenumber || '.go' AS f, 'src/d' || l_linenumber || '.go:' || l_quantity::INT AS site FROM lineitem
), f AS (SELECT 'r' || user_id % 25 AS r, 'e' || event_id AS fact, 'ev' || event_id AS ev, 'k' || event_id % 9 AS target, CASE WHEN event_id % 2 = 0 THEN 'K' || event_id % 9 ELSE 'e' || event_id END AS label, regexp_extract(props, '[0-9]+') AS k,
  CASE event_type WHEN 'error' THEN 'dependency' WHEN 'purchase' THEN 'route' WHEN 'signup' THEN 'data-store' END AS kind FROM events
), files AS (
  SELECT 1 AS loader, ra AS r, fa AS f, ca AS ev FROM calls UNION SELECT 1, rb, fb, cb FROM calls UNION SELECT 1, ra, fs, cs FROM calls UNION SELECT 2, r, src, r || '@h:' || src FROM imports
  UNION SELECT 2, r, dst, r || '@h:' || dst FROM imports WHERE internal UNION SELECT 3, r, f, r || '@nogit:' || site FROM s
), p AS (
  SELECT 0 AS loader, '' AS ord, 'repo:' || left(sha1('r' || n_nationkey), 16) AS id, 'repository' AS kind, CASE WHEN n_nationkey % 5 > 0 THEN n_name ELSE '' END AS label, 'r' || n_nationkey AS r, 'discovery/repository' AS producer,
    CASE WHEN n_regionkey > 0 THEN 'r' || n_nationkey || '@h' || n_regionkey END AS ev, 'declaration' AS basis, [{'k': 'is_git', 'v': 'true'}, {'k': 'region', 'v': n_regionkey::VARCHAR}] AS attrs FROM nation
  UNION ALL SELECT loader, '', 'file:' || left(sha1(concat_ws(chr(0), r, f)), 16), 'file', f, r, ['', 'callgraph', 'dependency-cruiser', 'discovery/tables'][loader + 1], ev, 'static-reference', [] FROM files
  UNION ALL SELECT 1, '', 'sym:' || left(sha1(concat_ws(chr(0), ra, sa, ca)), 16), 'symbol', sa, ra, 'callgraph', ca, 'static-reference', [] FROM calls
  UNION ALL SELECT 1, '', 'sym:' || left(sha1(concat_ws(chr(0), rb, sb, cb)), 16), 'symbol', sb, rb, 'callgraph', cb, 'static-reference', [] FROM calls
  UNION ALL SELECT 3, '', 'data:' || left(sha1(concat_ws(chr(0), r, store)), 16), 'data-store', store, r, 'discovery/tables', r || '@nogit:' || arg_min(site, access || chr(0) || site), CASE WHEN bool_or(access = 'declaration') THEN 'declaration' ELSE 'static-reference' END,
    [{'k': 'access_types', 'v': '[' || string_agg(DISTINCT '"' || access || '"', ',' ORDER BY '"' || access || '"') || ']'}, {'k': 'table', 'v': '"' || store || '"'}] FROM s GROUP BY r, store
  UNION ALL SELECT 4, concat_ws(chr(0), r, fact, kind), 'repo:' || left(sha1(r), 16), 'repository', r, r, 'evidence/capability-results', NULL, 'static-reference', [] FROM f
  UNION ALL SELECT 4, '', CASE kind WHEN 'route' THEN 'route:' ELSE 'data:' END || left(sha1(concat_ws(chr(0), r, kind, fact)), 16), kind, fact, r, 'evidence/capability-results', ev, 'static-reference', [{'k': 'k', 'v': k}] FROM f WHERE kind <> 'dependency'
  UNION ALL SELECT 4, concat_ws(chr(0), r, fact, kind), 'ext:' || left(sha1(concat_ws(chr(0), r, target)), 16), 'external-boundary', label, r, 'evidence/capability-results', ev, 'static-reference', [] FROM f WHERE kind = 'dependency'
), nodes AS (SELECT id, arg_min(kind, (loader, ord)) AS kind, coalesce(arg_min(label, (loader, ord)) FILTER (label <> ''), '') AS label, 'observed' AS status, arg_min(r, (loader, ord)) AS repository, array_to_string(list_sort(list(DISTINCT producer)), ',') AS producers,
  coalesce(list_sort(list(DISTINCT ev) FILTER (ev IS NOT NULL)), []) AS ev, arg_min(basis, (loader, ord)) AS basis, '{' || array_to_string(list_transform(arg_min(attrs, (len(attrs) = 0, loader, ord)), lambda a: '"' || a.k || '":' || a.v), ',') || '}' AS attrs FROM p GROUP BY id)"""


@query(f"""{_SOURCES}
SELECT id, kind, label, status, repository, producers, len(ev)::INT AS n_evidence, md5(array_to_string(ev, ',')) AS evidence, basis, attrs FROM nodes""")
def assembled_nodes(table):
    nodes = _summed(A.assembled_nodes(_parts(table))).withColumn("attrs", F.to_json("attrs"))
    return nodes.select("id", "kind", "label", "status", "repository", F.array_join("producers", ",").alias("producers"), "n_evidence", "evidence", "basis", "attrs")


@query(f"""{_SOURCES}, q AS (
  SELECT loader, '' AS ord, '' AS d, 'containment' AS type, 'repo:' || left(sha1(r), 16) AS src, 'file:' || left(sha1(concat_ws(chr(0), r, f)), 16) AS dst, 'observed' AS status, ['', 'callgraph', 'dependency-cruiser', 'discovery/tables'][loader + 1] AS producer, NULL AS ev, 'static-reference' AS basis, NULL AS confidence, '{{}}' AS attrs, NULL AS target FROM files
  UNION ALL SELECT 1, '', '', 'containment', 'file:' || left(sha1(concat_ws(chr(0), ra, fa)), 16), 'sym:' || left(sha1(concat_ws(chr(0), ra, sa, ca)), 16), 'observed', 'callgraph', NULL, 'static-reference', NULL, '{{}}', NULL FROM calls
  UNION ALL SELECT 1, '', '', 'containment', 'file:' || left(sha1(concat_ws(chr(0), rb, fb)), 16), 'sym:' || left(sha1(concat_ws(chr(0), rb, sb, cb)), 16), 'observed', 'callgraph', NULL, 'static-reference', NULL, '{{}}', NULL FROM calls
  UNION ALL SELECT 1, concat_ws(chr(0), resolution, kind), cs, 'call', 'sym:' || left(sha1(concat_ws(chr(0), ra, sa, ca)), 16), 'sym:' || left(sha1(concat_ws(chr(0), rb, sb, cb)), 16), CASE resolution WHEN 'observed' THEN 'observed' ELSE 'inferred' END, 'callgraph', cs,
    CASE resolution WHEN 'observed' THEN 'static-reference' ELSE 'inferred-linkage' END, CASE resolution WHEN 'observed' THEN NULL ELSE 0.7 END, '{{"kind":"' || kind || '","lang":"go"}}', NULL FROM calls
  UNION ALL SELECT 2, ord, '', 'dependency', 'file:' || left(sha1(concat_ws(chr(0), r, src)), 16), 'file:' || left(sha1(concat_ws(chr(0), r, dst)), 16), 'observed', 'dependency-cruiser', r || '@h:' || dst, 'static-reference', NULL, '{{"circular":' || circular || ',"specifier":"' || spec || '"}}', NULL FROM imports WHERE internal
  UNION ALL SELECT 2, ord, spec, 'dependency', 'file:' || left(sha1(concat_ws(chr(0), r, src)), 16), '', 'unresolved', 'dependency-cruiser', NULL, 'static-reference', NULL, '{{"circular":' || circular || ',"external":true}}', '{{"specifier":"' || spec || '"}}' FROM imports WHERE NOT internal
  UNION ALL SELECT 3, '', access, 'data', 'file:' || left(sha1(concat_ws(chr(0), r, f)), 16), 'data:' || left(sha1(concat_ws(chr(0), r, store)), 16), 'observed', 'discovery/tables', r || '@nogit:' || site, 'static-reference', NULL, '{{"access":"' || access || '"}}', NULL FROM s
  UNION ALL SELECT 4, '', '', 'containment', 'repo:' || left(sha1(r), 16), CASE kind WHEN 'route' THEN 'route:' ELSE 'data:' END || left(sha1(concat_ws(chr(0), r, kind, fact)), 16), 'observed', 'evidence/capability-results', NULL, 'static-reference', NULL, '{{}}', NULL FROM f WHERE kind <> 'dependency'
  UNION ALL SELECT 4, '', fact, 'dependency', 'repo:' || left(sha1(r), 16), 'ext:' || left(sha1(concat_ws(chr(0), r, target)), 16), 'observed', 'evidence/capability-results', ev, 'static-reference', NULL, '{{}}', NULL FROM f WHERE kind = 'dependency'
), e AS (SELECT 'edge:' || left(sha1(concat_ws(chr(0), type, src, CASE WHEN dst = '' THEN 'unresolved:specifier=' || d ELSE dst END, d)), 16) AS id, * FROM q),
m AS (SELECT id, arg_min({{'type': type, 'src': src, 'dst': dst, 'status': status, 'producer': producer, 'basis': basis, 'confidence': confidence, 'attrs': attrs, 'target': target}}, (loader, ord)) AS x, coalesce(list_sort(list(DISTINCT ev) FILTER (ev IS NOT NULL)), []) AS ev FROM e GROUP BY id),
j AS (SELECT m.id, x, m.ev, x.status <> 'unresolved' AND a.id IS NULL AS no_src, x.status <> 'unresolved' AND b.id IS NULL AS no_dst FROM m LEFT JOIN nodes a ON a.id = x.src LEFT JOIN nodes b ON b.id = x.dst)
SELECT id, x.type AS type, x.src AS src, x.dst AS dst, CASE WHEN no_src OR no_dst THEN 'unresolved' ELSE x.status END AS status, x.producer AS producer, len(ev)::INT AS n_evidence, md5(array_to_string(ev, ',')) AS evidence, x.basis AS basis, x.confidence::DOUBLE AS confidence, x.attrs AS attrs,
  CASE WHEN no_src OR no_dst THEN '{{' || concat_ws(',', CASE WHEN no_dst THEN '"dst":"' || x.dst || '"' END, CASE WHEN no_src THEN '"src":"' || x.src || '"' END) || '}}' ELSE x.target END AS target FROM j""")
def assembled_edges(table):
    edges = _summed(A.edges_as_text(_parts(table)))
    return edges.select("id", "type", "src", "dst", "status", "producer", "n_evidence", "evidence", "basis", "confidence", "attrs", "target")
