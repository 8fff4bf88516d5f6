"""Queries that build and check a system model, made from the tables' rows, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators import modeling as O
from strataline.plans.registry import query

_lit = lambda p, c: F.concat(F.lit(p), c)
_joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


# Parts with a maker and a container, which follow from their numbers.
_MADE = "(SELECT *, 'M#' || (p_partkey % 5) AS p_mfgr, 'C' || (p_partkey % 17) AS p_container FROM part)"


def _parts(table) -> DataFrame:
    return table("part").withColumns({"p_mfgr": F.concat(F.lit("M#"), F.col("p_partkey") % 5), "p_container": F.concat(F.lit("C"), F.col("p_partkey") % 17)})


def _cited(table) -> DataFrame:
    return _parts(table).select(F.col("p_mfgr").alias("r"), F.when(F.col("p_size") % 5 > 0, F.col("p_brand")).otherwise("").alias("p"), F.when(F.col("p_size") % 2 > 0, F.col("p_type")).otherwise("").alias("s"))


@query(f"""WITH c AS (SELECT p_mfgr AS r, CASE WHEN p_size % 5 > 0 THEN p_brand ELSE '' END AS p, CASE WHEN p_size % 2 > 0 THEN p_type ELSE '' END AS s FROM {_MADE})
SELECT 'repository' AS kind, count(DISTINCT r) AS nodes, min(r) AS first_label FROM c UNION ALL SELECT 'file', count(DISTINCT r || '|' || p), min(p) FROM c WHERE p <> '' UNION ALL SELECT 'symbol', count(DISTINCT r || '|' || p || '|' || s), min(s) FROM c WHERE p <> '' AND s <> ''""")
def containment_nodes(table):
    return O.contained(_cited(table), "r", "p", "s")[0].groupBy("kind").agg(F.count("*").alias("nodes"), F.min("label").alias("first_label"))


@query(f"""WITH c AS (SELECT p_mfgr AS r, CASE WHEN p_size % 5 > 0 THEN p_brand ELSE '' END AS p, CASE WHEN p_size % 2 > 0 THEN p_type ELSE '' END AS s FROM {_MADE})
SELECT src, count(DISTINCT dst) AS parts FROM (SELECT 'repository:' || r AS src, p AS dst FROM c WHERE p <> '' UNION ALL SELECT 'file:' || r || '|' || p, s FROM c WHERE p <> '' AND s <> '') GROUP BY src""")
def containment_links(table):
    links = O.contained(_cited(table), "r", "p", "s")[1]
    return links.groupBy(F.replace("src", F.lit("\0"), F.lit("|")).alias("src")).agg(F.count("*").alias("parts"))


@query("""WITH k AS (SELECT o_custkey AS r, array_to_string(list_sort(list(DISTINCT CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END) FILTER (o_orderkey % 5 > 0)), ',') AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, k.r IS NOT NULL AS ui_linked, coalesce(f, '') AS ui_frontends FROM customer LEFT JOIN k ON k.r = c_custkey""")
def linked_routes(table):
    links = table("orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "ui-called").otherwise("unmatched").alias("status"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).otherwise("").alias("frontend"))
    return O.linked_routes(table("customer").select("c_custkey"), links, ["c_custkey"], "status", "frontend").withColumn("ui_frontends", F.array_join("ui_frontends", ","))


@query("""WITH g AS (SELECT p_size AS i, max_by(p_brand, p_partkey) AS v FROM part WHERE p_size % 3 > 0 GROUP BY 1) SELECT l_orderkey, l_linenumber, v AS store, v IS NOT NULL AS resolved FROM lineitem LEFT JOIN g ON i = l_quantity::BIGINT""")
def named_accesses(table):
    registry = table("part").filter("p_size % 3 > 0").select(F.col("p_size").cast("long").alias("i"), "p_partkey", F.col("p_brand").alias("store"))
    return O.named_accesses(table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("i")), registry, "i", "p_partkey", "store").drop("i")


@query(f"""WITH d AS (SELECT p_size AS s, list_sort(list(DISTINCT p_mfgr)) AS f, list_sort(list(DISTINCT p_brand) FILTER (p_partkey % 4 > 0)) AS l FROM {_MADE} WHERE p_size % 3 = 0 GROUP BY 1), n AS (SELECT DISTINCT p_size FROM {_MADE})
SELECT p_size, CASE WHEN s IS NULL THEN 'table' ELSE 'collection' END AS kind, coalesce(array_to_string(f, ','), 'relational') AS families, coalesce(array_to_string(l, ','), '') AS logical_names FROM n LEFT JOIN d ON s = p_size""")
def described_stores(table):
    documents = _parts(table).filter("p_size % 3 = 0").select("p_size", "p_mfgr", F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).otherwise("").alias("logical"))
    return O.described_stores(_parts(table), documents, "p_size", "p_mfgr", "logical").select("p_size", "kind", _joined("families"), _joined("logical_names"))


@query(f"""WITH n AS (SELECT p_partkey, p_mfgr, CASE p_size % 3 WHEN 0 THEN 'route' WHEN 1 THEN 'data-store' ELSE 'file' END AS kind, p_brand AS label, CASE WHEN p_size % 2 = 0 THEN p_type END AS x FROM {_MADE})
SELECT p_mfgr, p_partkey, kind || ':' || label AS key FROM n UNION SELECT p_mfgr, p_partkey, CASE kind WHEN 'route' THEN 'route:' ELSE 'table:' END || coalesce(x, label) FROM n WHERE kind <> 'file'""")
def node_keys(table):
    kind = F.when(F.col("p_size") % 3 == 0, "route").when(F.col("p_size") % 3 == 1, "data-store").otherwise("file")
    nodes = _parts(table).select("p_partkey", "p_mfgr", kind.alias("kind"), F.col("p_brand").alias("label"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("x"))
    return O.node_keys(nodes, "p_mfgr", "kind", "label", {"route": ("route", "x"), "data-store": ("table", "x")}).select("p_mfgr", "p_partkey", "key")


# A block for each part: which families were seen, can be read and were read follows from its number.
_BLOCK = """p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 7 > 0 END AS detector, CASE WHEN p_size % 4 = 0 THEN ARR() WHEN p_size % 4 = 1 THEN ARR('sql') WHEN p_size % 4 = 2 THEN ARR('gorm', 'sql') ELSE ARR('redis', 'sequelize') END AS detected,
CASE WHEN p_size % 4 = 0 THEN ARR() WHEN p_size % 4 = 1 THEN ARR('sql') WHEN p_size % 4 = 2 THEN ARR('gorm', 'sql') ELSE ARR('sequelize') END AS supported, CASE WHEN p_size % 4 = 0 THEN ARR() WHEN p_size % 4 = 1 THEN ARR('sql') WHEN p_size % 4 = 2 AND p_partkey % 2 = 0 THEN ARR('gorm', 'sql') ELSE ARR() END AS extracted,
CASE WHEN p_size % 4 = 3 THEN ARR('redis') ELSE ARR() END AS unsupported, p_partkey % 3 AS stores, CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS bindings, p_partkey % 5 > 0 AS structural, p_partkey % 6 > 0 AS scripts, p_partkey % 9 > 0 AS scripts_complete, p_partkey % 17 = 0 AS capped"""
_DUCK = _BLOCK.replace("ARR()", "[]::VARCHAR[]").replace("ARR('redis')", "['redis']").replace("ARR(", "list_value(")
_DETAIL = f"""b AS (SELECT {_DUCK} FROM part), c AS (SELECT p_partkey, coalesce(detector, false) AS d, detector, stores, bindings, structural, scripts, scripts_complete, capped, CASE WHEN detector IS NULL THEN []::VARCHAR[] ELSE detected END AS detected,
CASE WHEN detector IS NULL THEN []::VARCHAR[] ELSE supported END AS supported, CASE WHEN detector IS NULL THEN []::VARCHAR[] ELSE extracted END AS extracted, CASE WHEN detector IS NULL THEN []::VARCHAR[] ELSE unsupported END AS unsupported FROM b),
u AS (SELECT *, list_sort(unsupported || list_filter(supported, lambda s: NOT list_contains(extracted, s))) AS unresolved, (list_has_any(supported, ['gorm', 'sequelize']) AND NOT structural) OR (list_contains(supported, 'sql') AND NOT scripts) AS failed FROM c),
v AS (SELECT *, (list_contains(supported, 'sql') AND scripts AND NOT scripts_complete) OR capped OR len(unresolved) > 0 OR bindings > 0 AS open FROM u),
w AS (SELECT *, CASE WHEN NOT d AND stores > 0 THEN 'partial' WHEN NOT d THEN 'unavailable' WHEN len(detected) = 0 THEN 'not-applicable' WHEN failed AND len(extracted) = 0 THEN 'unavailable' WHEN stores > 0 AND NOT failed AND NOT open THEN 'complete' WHEN stores > 0 OR len(extracted) > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM v)"""


def _coverage(table) -> DataFrame:
    empty = "cast(array() as array<string>)"
    return O.store_coverage(table("part").selectExpr(*_spark_columns(_BLOCK.replace("ARR()", empty).replace("ARR(", "array("))), "p_partkey")


def _spark_columns(text: str) -> list[str]:
    """The select list at its commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


@query(f"WITH {_DETAIL} SELECT p_partkey, status, array_to_string(unresolved, ',') AS unresolved, stores FROM w")
def store_coverage(table):
    return _coverage(table).select("p_partkey", "status", _joined("unresolved"), "stores")


@query(f"""WITH {_DETAIL} SELECT count(*) AS repositories, bool_and(d) AS detector_complete, (SELECT array_to_string(list_sort(list(DISTINCT x)), ',') FROM (SELECT unnest(unresolved) AS x FROM w)) AS unresolved, sum(stores)::BIGINT AS stores, sum(bindings)::BIGINT AS bindings, 'partial' AS status FROM w""")
def store_coverage_total(table):
    return O.store_coverage_total(_coverage(table)).select("repositories", "detector_complete", _joined("unresolved"), "stores", "bindings", "status")


@query(f"""SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_mfgr)), ',') AS roots, array_to_string(list_sort(list(DISTINCT p_container)), ',') AS evidence, CASE WHEN bool_or(p_size > 45) THEN 'high' ELSE 'medium' END AS confidence FROM {_MADE} GROUP BY 1""")
def merged_facets(table):
    facets = _parts(table).select("p_brand", F.array("p_mfgr").alias("roots"), F.array("p_container").alias("evidence"), F.when(F.col("p_size") > 45, "high").otherwise("medium").alias("confidence"))
    return O.merged_facets(facets, "p_brand", "roots", "evidence", "confidence").select("p_brand", _joined("roots"), _joined("evidence"), "confidence")


@query("SELECT DISTINCT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey % 2 = 0")
def facet_names(table):
    profiles = table("nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") % 2).cast("string").alias("kind"), F.col("n_name").alias("name"))
    return O.facet_names(table("customer"), profiles, "c_nationkey", "kind", "0", "name")


@query("""SELECT c_custkey AS k, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def repository_gap(table):
    return O.repository_gap(table("customer").select(F.col("c_custkey").alias("k")), table("orders").select(F.col("o_custkey").alias("k")), "k")


_OUTCOMES = """m AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_suppkey % 10 = 0 GROUP BY 1), t AS (SELECT o_orderkey, CASE WHEN n IS NOT NULL THEN 'partial' WHEN o_orderstatus = 'F' THEN 'consumed' WHEN o_orderstatus = 'O' THEN 'not-needed' ELSE 'failed' END AS outcome,
CASE WHEN n IS NOT NULL THEN '' WHEN o_orderstatus = 'P' THEN '' ELSE 'report' END AS consumer, coalesce(n, 0) AS missing, CASE WHEN n IS NOT NULL THEN 'lineage-missing' ELSE '' END AS reason FROM orders LEFT JOIN m ON l_orderkey = o_orderkey)"""


def _outcomes(table) -> DataFrame:
    s = F.col("o_orderstatus")
    tasks = table("orders").select(F.col("o_orderkey"), F.when(s == "F", "consumed").when(s == "O", "not-needed").otherwise("failed").alias("outcome"), F.when(s == "P", "").otherwise("report").alias("consumer"))
    outputs = table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("finding"))
    accounted = table("lineitem").filter("l_suppkey % 10 <> 0").select(F.col("l_suppkey").alias("finding"))
    return O.task_outcomes(tasks, outputs, accounted, "o_orderkey", "outcome", "consumer", "finding")


@query(f"WITH {_OUTCOMES} SELECT * FROM t")
def task_outcomes(table):
    return _outcomes(table)


@query(f"WITH {_OUTCOMES} SELECT bool_and(outcome NOT IN ('partial', 'failed') AND consumer <> '') AS authoritative, count(*) FILTER (outcome IN ('partial', 'failed') OR consumer = '') AS open FROM t")
def authoritative_run(table):
    return O.authoritative(_outcomes(table), "outcome", "consumer")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'claimed' WHEN 'R' THEN 'failed' ELSE 'claimed' END AS e FROM lineitem) SELECT l_orderkey, count(*) FILTER (e = 'claimed') AS attempt FROM e GROUP BY 1 HAVING max_by(e, (l_linenumber, l_partkey, l_suppkey, e)) = 'claimed' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def released_claims(table):
    log = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "failed").otherwise("claimed").alias("e"))
    return O.released(log, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "e"], "e", ("failed", "validated"), table("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")))


@query("""WITH s AS (SELECT n_name AS id, n_nationkey % 5 AS wave, CASE WHEN n_regionkey = 0 THEN 0.3 ELSE 0.2 END AS share, n_regionkey AS doc FROM nation UNION ALL SELECT n_name, n_nationkey % 5, 0.0, n_regionkey FROM nation WHERE n_nationkey = 3),
d AS (SELECT a.n_name AS id, a.n_nationkey % 5 AS wave, CASE WHEN a.n_nationkey % 6 = 0 THEN 'none' ELSE b.n_name END AS needs, b.n_nationkey % 5 AS needed FROM nation a JOIN nation b ON b.n_nationkey = a.n_regionkey)
SELECT 'duplicate section' AS problem, id AS subject FROM s GROUP BY id HAVING count(*) > 1 UNION ALL SELECT CASE WHEN needs = 'none' THEN 'unknown dependency' ELSE 'dependency not earlier' END, id || ' > ' || needs FROM d WHERE needs = 'none' OR needed >= wave
UNION ALL SELECT 'shares do not sum to one', doc::VARCHAR FROM s WHERE share > 0 GROUP BY doc HAVING abs(sum(share) - 1) > 0.01""")
def catalogue_problems(table):
    n = table("nation")
    s = n.select(F.col("n_name").alias("id"), (F.col("n_nationkey") % 5).alias("wave"), F.when(F.col("n_regionkey") == 0, 0.3).otherwise(0.2).alias("share"), F.col("n_regionkey").cast("string").alias("doc"))
    s = s.unionByName(n.filter("n_nationkey = 3").select(F.col("n_name").alias("id"), (F.col("n_nationkey") % 5).alias("wave"), F.lit(0.0).alias("share"), F.col("n_regionkey").cast("string").alias("doc")))
    b = n.select(F.col("n_nationkey").alias("n_regionkey"), F.col("n_name").alias("b"))
    d = n.join(b, "n_regionkey").select(F.col("n_name").alias("id"), F.when(F.col("n_nationkey") % 6 == 0, "none").otherwise(F.col("b")).alias("needs"))
    return O.catalogue_problems(s, d, "id", "wave", "needs", "doc", "share")


@query("""SELECT array_to_string(list_sort(list(n_name)), ',') AS differences, 'input-pipeline-difference' AS classification FROM nation WHERE n_nationkey % 6 = 0""")
def frozen_comparison(table):
    base = table("nation").select("n_name", F.col("n_nationkey").cast("string").alias("digest"))
    other = table("nation").select("n_name", F.when(F.col("n_nationkey") % 6 == 0, "x").otherwise(F.col("n_nationkey").cast("string")).alias("digest"))
    return O.frozen_comparison(base, other, "n_name", "digest", True).withColumn("differences", F.array_join("differences", ","))


@query(f"""WITH e AS (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN 'unknown' ELSE p_mfgr END AS k, p_type AS l FROM {_MADE}) SELECT k, count(*) AS labels, array_to_string(list_sort(list(l))[1:24], ', ') || CASE WHEN count(*) > 24 THEN ' …' ELSE '' END AS preview FROM e GROUP BY k""")
def boundary_kinds(table):
    return O.boundary_kinds(_parts(table).select(F.when(F.col("p_size") % 7 > 0, F.col("p_mfgr")).alias("k"), F.col("p_type").alias("l")), "k", "l")


@query("""WITH b AS (SELECT c_custkey AS id, 'mechanical' AS origin, 1 AS n FROM customer UNION ALL SELECT o_orderkey + 10, 'added', o_orderkey % 3 FROM orders), c AS (SELECT id, count(*) AS k FROM b GROUP BY id)
SELECT id, origin, CASE WHEN k > 1 THEN 'duplicate key' WHEN origin = 'added' AND n = 0 THEN 'no evidence' ELSE '' END AS problem FROM b JOIN c USING (id)""")
def united_universe(table):
    mechanical = table("customer").select(F.col("c_custkey").cast("long").alias("id"), F.array(F.lit("e")).alias("evidence"))
    added = table("orders").select((F.col("o_orderkey") + 10).cast("long").alias("id"), F.array_repeat(F.lit("e"), (F.col("o_orderkey") % 3).cast("int")).alias("evidence"))
    return O.united_universe(mechanical, added, "id", "evidence").select("id", "origin", "problem")


@query("""WITH w AS (SELECT o_custkey AS c, count(*) AS words FROM orders GROUP BY 1), l AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 2 = 0 THEN 5 END AS low, 15 AS high FROM customer)
SELECT * FROM (SELECT c, words, CASE WHEN words IS NULL THEN 'missing' WHEN words < low THEN 'below floor' WHEN words > high THEN 'above ceiling' END AS problem FROM l LEFT JOIN w USING (c)) WHERE problem IS NOT NULL""")
def document_limits(table):
    words = table("orders").select(F.col("o_custkey").alias("c"), F.lit(1).alias("n"))
    limits = table("customer").select(F.col("c_custkey").alias("c"), F.when(F.col("c_custkey") % 2 == 0, 5).alias("low"), F.lit(15).alias("high"))
    return O.document_limits(words, limits, "c", "n", "low", "high")


@query("""WITH r AS (SELECT o_custkey + 5 AS k, count(*) AS n, bool_and(o_orderstatus <> 'P') AS fine FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1)
SELECT * FROM (SELECT coalesce(k, c_custkey) AS k, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'several' WHEN NOT fine THEN 'not allowed' END AS problem FROM customer FULL JOIN r ON k = c_custkey) WHERE problem IS NOT NULL""")
def resolved_exactly(table):
    found = table("orders").filter("o_orderkey % 7 = 0").select((F.col("o_custkey") + 5).alias("k"), "o_orderstatus")
    return O.resolved_exactly(table("customer").select(F.col("c_custkey").alias("k")), found, "k", "o_orderstatus", ["F", "O"])


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'v1/things' WHEN 1 THEN 'src/mod' || (page_id % 9) WHEN 2 THEN '(root)' ELSE 'db' END AS root FROM pages""")
def candidate_roots(table):
    k = F.col("page_id") % 4
    value = F.when(k == 0, _lit("GET /v1/things/", F.col("page_id").cast("string"))).when(k == 1, F.concat(F.lit("src/mod"), F.col("page_id") % 9, F.lit("/x/y"))).when(k == 2, "/").otherwise("db")
    kind = F.when(k == 0, "route").when(k == 1, "folder").otherwise("data-store")
    return table("pages").select("page_id", O.candidate_root(value, kind).alias("root"))
