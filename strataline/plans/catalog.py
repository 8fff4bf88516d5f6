"""Queries that bind each operator to the star-schema tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import sources as S
from strataline.functions import text as T
from strataline.operators import compare, graph, history, ledger, ranking, routes
from strataline.plans.registry import query

# History: orders are transactions, parts are items, customers are actors.


@query("""WITH o AS (SELECT l_orderkey k, l_partkey p, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)::BIGINT a, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT d FROM lineitem GROUP BY 1, 2)
SELECT p AS l_partkey, count(*) AS commits, sum(a)::BIGINT AS added, sum(d)::BIGINT AS deleted, sum(a + d)::BIGINT AS total_lines FROM o GROUP BY p""")
def churn(table):
    q = F.col("l_quantity").cast("long")
    log = table("lineitem").withColumns({"a": F.when(F.col("l_returnflag") != "R", q).otherwise(0), "d": F.when(F.col("l_returnflag") == "R", q).otherwise(0)})
    return history.churn(log, "l_orderkey", "l_partkey", "a", "d")


_BRANDS = "SELECT DISTINCT l_orderkey k, p_brand b FROM lineitem JOIN part ON l_partkey = p_partkey"
_COUPLING = f"""WITH t AS ({_BRANDS}), big AS (SELECT k FROM t GROUP BY k HAVING count(*) > 6), s AS (SELECT * FROM t WHERE k NOT IN (SELECT k FROM big)),
r AS (SELECT b, count(*) AS n FROM t GROUP BY b), pairs AS (SELECT x.b AS item_a, y.b AS item_b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.b < y.b GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT item_a, item_b, shared, ra.n AS revs_a, rb.n AS revs_b FROM pairs JOIN r ra ON ra.b = item_a JOIN r rb ON rb.b = item_b"""


def _brand_log(table) -> DataFrame:
    return table("lineitem").select("l_orderkey", "l_partkey").join(table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")


@query(_COUPLING)
def coupling(table):
    return history.coupling(_brand_log(table), "l_orderkey", "p_brand", min_shared=20, bulk_limit=6)


@query(f"""SELECT item_a, item_b, shared, (100 * shared / ((revs_a + revs_b) / 2.0))::DOUBLE AS degree FROM ({_COUPLING}) WHERE substr(item_a, 1, 7) <> substr(item_b, 1, 7)""")
def cross_group_coupling(table):
    pairs = history.coupling(_brand_log(table), "l_orderkey", "p_brand", min_shared=20, bulk_limit=6)
    return pairs.filter(F.substring("item_a", 1, 7) != F.substring("item_b", 1, 7)).select("item_a", "item_b", "shared", (100 * F.col("shared") / ((F.col("revs_a") + F.col("revs_b")) / 2)).alias("degree"))


@query("""WITH o AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT l_orderkey k FROM lineitem)),
keep AS (SELECT DISTINCT (i * n) // 500 AS pos FROM (SELECT n FROM o LIMIT 1), range(500) t(i)), t AS (SELECT DISTINCT l_orderkey k, l_partkey b FROM lineitem JOIN o ON l_orderkey = k JOIN keep USING (pos)),
s AS (SELECT * FROM t WHERE k NOT IN (SELECT k FROM t GROUP BY k HAVING count(*) > 6)), r AS (SELECT b, count(*) n FROM s GROUP BY b),
pairs AS (SELECT x.b item_a, y.b item_b, count(*) shared FROM s x JOIN s y ON x.k = y.k AND x.b < y.b GROUP BY 1, 2)
SELECT item_a, item_b, shared, ra.n AS revs_a, rb.n AS revs_b FROM pairs JOIN r ra ON ra.b = item_a JOIN r rb ON rb.b = item_b""")
def sampled_coupling(table):
    return history.coupling(table("lineitem"), "l_orderkey", "l_partkey", min_shared=1, bulk_limit=6, sample_cap=500)


@query(f"WITH t AS ({_BRANDS}) SELECT count(*) AS transactions, count(*) FILTER (n > 6) AS bulk_excluded FROM (SELECT k, count(*) n FROM t GROUP BY k)")
def bulk_disclosure(table):
    return history.bulk_disclosure(_brand_log(table), "l_orderkey", "p_brand", 6)


@query("""WITH x AS (SELECT l_partkey p, o_custkey c, count(DISTINCT l_orderkey) n, sum(l_quantity)::BIGINT w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, c) rn, row_number() OVER (PARTITION BY p ORDER BY w DESC, c) rw FROM x)
SELECT p AS l_partkey, count(*) AS actors, sum(n)::BIGINT AS commits, max(c) FILTER (rn = 1) AS owner, max(n) FILTER (rn = 1) AS owner_commits, max(c) FILTER (rw = 1) AS weight_owner, max(w) FILTER (rw = 1) AS owner_weight FROM r GROUP BY p""")
def ownership(table):
    orders = table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    log = table("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("w")).join(orders, "l_orderkey")
    return history.ownership(log, "l_orderkey", "l_partkey", "o_custkey", "w")


@query("SELECT c_nationkey, count(*) AS commits, arg_max(c_mktsegment, c_custkey) AS display FROM customer GROUP BY c_nationkey")
def roster(table):
    return history.roster(table("customer"), "c_nationkey", "c_mktsegment", "c_custkey")


@query("""SELECT c_nationkey, c_mktsegment, votes FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY votes DESC, lower(c_mktsegment), c_mktsegment) rn
FROM (SELECT c_nationkey, c_mktsegment, count(*) votes FROM customer GROUP BY 1, 2)) WHERE rn = 1""")
def label_election(table):
    return history.elect_label(table("customer"), "c_nationkey", "c_mktsegment")


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS groups FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def ambiguous_labels(table):
    return history.ambiguous_labels(table("customer"), "c_nationkey", "c_mktsegment")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id AS o, (user_id * user_id + 1) % 60 AS n FROM events WHERE event_type = 'signup'),
s AS (SELECT o, n FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY event_id DESC) rn FROM r WHERE o <> n) WHERE rn = 1),
w AS (SELECT o AS name, n AS cur, [o] AS seen FROM s UNION ALL SELECT w.name, s.n, list_append(w.seen, w.cur) FROM w JOIN s ON s.o = w.cur WHERE NOT list_contains(w.seen, w.cur))
SELECT name, arg_max(cur, len(seen)) AS final FROM w GROUP BY name HAVING arg_max(cur, len(seen)) <> name""")
def rename_closure(table):
    log = table("events").filter(F.col("event_type") == "signup").withColumn("n", (F.col("user_id") * F.col("user_id") + 1) % 60)
    return history.rename_closure(log, "user_id", "n", "event_id")


# Ranking


@query("""SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total_count, least((SELECT count(*) FROM orders), 200) AS included_count, (SELECT count(*) FROM orders) > 200 AS truncated
FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""")
def bounded_top(table):
    return ranking.bounded(table("orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 200).select("o_orderkey", "o_custkey", "total_count", "included_count", "truncated")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) rn FROM lineitem) WHERE rn <= 3")
def first_per_group(table):
    return ranking.first_per_group(table("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 3)


@query("SELECT n_regionkey, count(*) AS customers, (SELECT count(*) FROM customer) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def share_of_total(table):
    n = table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return ranking.share_of_total(table("customer").join(n, "c_nationkey").groupBy("n_regionkey").agg(F.count("*").alias("customers")), "customers")


@query("SELECT c_custkey, c_nationkey, (row_number() OVER w - 1) // 16 AS chunk, ntile(5) OVER w AS shard FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def chunks_and_shards(table):
    c = table("customer").select("c_custkey", "c_nationkey")
    return ranking.sharded(ranking.chunked(c, "c_nationkey", [F.col("c_custkey")], 16), "c_nationkey", [F.col("c_custkey")], 5)


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) rn, count(*) OVER (PARTITION BY l_suppkey) n FROM lineitem)
WHERE n <= 200 OR rn <= 120 OR rn > n - 80""")
def head_tail(table):
    return ranking.head_tail(table("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey", [F.col("l_orderkey"), F.col("l_linenumber")], 200, 120)


@query("""WITH RECURSIVE x AS (SELECT o_custkey c, o_orderkey k, floor(o_totalprice)::BIGINT s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders),
f AS (SELECT c, k, s, rn, s <= 300000 AS taken, CASE WHEN s <= 300000 THEN 300000 - s ELSE 300000 END AS rest FROM x WHERE rn = 1
UNION ALL SELECT x.c, x.k, x.s, x.rn, x.s <= f.rest, CASE WHEN x.s <= f.rest THEN f.rest - x.s ELSE f.rest END FROM f JOIN x ON x.c = f.c AND x.rn = f.rn + 1)
SELECT c AS o_custkey, k AS o_orderkey, s AS size, taken FROM f""")
def skip_budget(table):
    return ranking.budgeted(table("orders").withColumn("size", F.floor("o_totalprice")), "o_custkey", "o_orderkey", "size", 300000)


# Comparison: orders against a changed copy of themselves.

_CANDIDATE = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN 'none' ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey > 0"""


def _candidate(table) -> DataFrame:
    o = table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    new = {"o_orderstatus": F.when(k % 11 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(k % 13 == 0, "none").otherwise(F.col("o_orderpriority"))}
    return o.filter(k % 7 != 0).withColumns(new).unionByName(o.filter((k % 17 == 0) & (k > 0)).withColumn("o_orderkey", -k))


@query(f"""WITH c AS ({_CANDIDATE}) SELECT o_orderkey, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN c.o_custkey IS NULL THEN 'removed'
WHEN b.o_custkey IS NOT DISTINCT FROM c.o_custkey AND b.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority THEN 'reclassified' ELSE 'changed' END AS change
FROM orders b FULL JOIN c USING (o_orderkey) WHERE b.o_custkey IS NULL OR c.o_custkey IS NULL OR b.o_custkey <> c.o_custkey OR b.o_orderstatus <> c.o_orderstatus OR b.o_orderpriority <> c.o_orderpriority""")
def keyed_diff(table):
    return compare.keyed_diff(table("orders"), _candidate(table), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"], ["o_orderstatus"])


@query(f"""WITH b AS (SELECT o_custkey, o_orderstatus FROM orders), c AS (SELECT o_custkey, o_orderstatus FROM ({_CANDIDATE}))
SELECT *, 'removed' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'added' AS side FROM (SELECT * FROM c EXCEPT SELECT * FROM b)""")
def rowset_diff(table):
    return compare.rowset_diff(*[x.select("o_custkey", "o_orderstatus") for x in (table("orders"), _candidate(table))])


@query(f"""WITH b AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') v FROM orders GROUP BY 1), c AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') v FROM ({_CANDIDATE}) GROUP BY 1)
SELECT o_custkey, b.v AS base_values, c.v AS candidate_values FROM b FULL JOIN c USING (o_custkey) WHERE b.v IS DISTINCT FROM c.v""")
def set_drift(table):
    found = compare.set_drift(table("orders"), _candidate(table), "o_custkey", "o_orderpriority")
    return found.select("o_custkey", F.array_join("base_values", "|").alias("base_values"), F.array_join("candidate_values", "|").alias("candidate_values"))


@query("""SELECT c_custkey, CASE WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS fault FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE n IS NULL OR n > 1""")
def exactly_once(table):
    return compare.exactly_once(table("customer"), table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT 'orders-have-customers' AS check, count(*) AS violations, count(*) = 0 AS passed FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'unique-orders', count(*), count(*) = 0 FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'closed-vocabulary', count(*), count(*) = 0 FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def constraint_checks(table):
    o = table("orders")
    return compare.violations(
        ("orders-have-customers", o.join(table("customer"), o.o_custkey == F.col("c_custkey"), "left_anti")),
        ("unique-orders", o.groupBy("o_orderkey").count().filter("count > 1")),
        ("closed-vocabulary", o.filter(~F.col("o_orderstatus").isin("O", "F"))),
    )


@query("""SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) WHEN 3 THEN 'failed' WHEN 2 THEN 'partial' WHEN 1 THEN 'skipped' ELSE 'complete' END AS status FROM events GROUP BY 1""")
def worst_status(table):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "partial").when(F.col("event_type") == "click", "skipped").otherwise("complete")
    return table("events").groupBy("user_id").agg(compare.worst(status, {"complete": 0, "skipped": 1, "partial": 2, "failed": 3}, "failed").alias("status"))


# Graph: suppliers, nations, regions, parts.


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 10 = 3 OR c_custkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def resolve_edges(table):
    own = table("customer").filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("id"))
    found = graph.resolve_edges(table("orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("src")), own, "src", "o_custkey", "id")
    return found.select("o_orderkey", "o_custkey", "status")


_EDGES = "SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region"


def _edges(table) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    s = table("supplier").select(name("s", "s_suppkey").alias("a"), name("n", "s_nationkey").alias("b"))
    return s.unionByName(table("nation").select(name("n", "n_nationkey").alias("a"), name("r", "n_regionkey").alias("b"))).unionByName(table("region").select(name("r", "r_regionkey").alias("a"), name("r", "r_regionkey").alias("b")))


@query(f"WITH e AS ({_EDGES}) SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id ORDER BY degree DESC, id LIMIT 20")
def hubs(table):
    return graph.degrees(_edges(table), "a", "b").orderBy(F.desc("degree"), "id").limit(20)


@query("""SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def tallies(table):
    return graph.tallies(table("orders"), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) FILTER (c_mktsegment <> '') AS c_mktsegment, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS tags FROM customer GROUP BY 1""")
def merged_nodes(table):
    nodes = table("customer").withColumn("tags", F.array("c_mktsegment"))
    return graph.merge_nodes(nodes, "c_nationkey", "c_custkey", ["c_mktsegment"], ["tags"]).withColumn("tags", F.array_join("tags", "|"))


_BY_CUSTOMER = "SELECT o_custkey AS a, -1 - o_orderkey AS b FROM orders"


def _by_customer(table) -> DataFrame:
    return table("orders").select(F.col("o_custkey").alias("a"), (-1 - F.col("o_orderkey")).alias("b"))


@query(f"""WITH RECURSIVE e AS ({_BY_CUSTOMER}), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x, x AS z FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.z = u.x)
SELECT x AS id, min(z) AS component FROM r GROUP BY x""")
def components(table):
    return graph.connected_components(_by_customer(table), "a", "b")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, (user_id * 3 + 1) % 1000 AS b FROM events), r AS (SELECT DISTINCT user_id AS a FROM events WHERE event_type = 'error' UNION SELECT e.b FROM r JOIN e ON r.a = e.a) SELECT a FROM r""")
def failure_cascade(table):
    e = table("events")
    return graph.cascade(e.select(F.col("user_id").alias("src"), ((F.col("user_id") * 3 + 1) % 1000).alias("dst")).distinct(), e.filter("event_type = 'error'").select(F.col("user_id").alias("a")), "src", "dst", "a")


@query("""WITH c AS (SELECT [n_regionkey, n_nationkey, (n_nationkey + 7) % 25] AS m FROM nation) SELECT DISTINCT array_to_string(list_concat(list_slice(m, p, len(m)), list_slice(m, 1, p - 1)), '>') AS cycle FROM (SELECT m, list_position(m, list_min(m)) AS p FROM c)""")
def cycles(table):
    loops = table("nation").select(F.array(F.col("n_regionkey"), F.col("n_nationkey"), (F.col("n_nationkey") + 7) % 25).alias("m"))
    return graph.canonical_cycles(loops, "m").select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey + 1 + n_regionkey AS b FROM nation), l AS (SELECT a AS id, 0 AS level FROM e WHERE a NOT IN (SELECT b FROM e) UNION SELECT e.b, l.level + 1 FROM l JOIN e ON l.id = e.a) SELECT id, max(level) AS level FROM l GROUP BY id""")
def topological_levels(table):
    return graph.topological_levels(table("nation").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1 + F.col("n_regionkey")).alias("b")), "a", "b")


@query()
def greedy_match(table):
    scored = table("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("score"))
    return graph.greedy_match(scored, "l_suppkey", "l_linenumber", "score")


@query("""WITH e AS (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT least(s_nationkey, c_nationkey) AS group_a, greatest(s_nationkey, c_nationkey) AS group_b, count(*) AS links
FROM e JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2""")
def group_topology(table):
    o = table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    ends = table("lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst")).distinct()
    owners = table("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("item"), F.col("s_nationkey").alias("g")).unionByName(table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("item"), F.col("c_nationkey").alias("g")))
    return graph.group_topology(ends, owners, "src", "dst", "item", "g")


_SPANS = "SELECT l_suppkey k, l_orderkey o, (min(epoch(l_shipdate)) // 86400)::BIGINT AS lo, (max(epoch(l_shipdate)) // 86400)::BIGINT AS hi FROM lineitem WHERE l_returnflag {} 'R' GROUP BY 1, 2"


@query(f"WITH a AS ({_SPANS.format('=')}), b AS ({_SPANS.format('<>')}) SELECT a.o AS a_id, b.o AS b_id, count(*) AS overlaps FROM a JOIN b ON a.k = b.k AND a.lo <= b.hi + 5 AND b.lo <= a.hi + 5 GROUP BY 1, 2")
def interval_overlaps(table):
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400)
    spans = table("lineitem").groupBy("l_suppkey", "l_orderkey", (F.col("l_returnflag") == "R").alias("returned")).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    a, b = spans.filter("returned").withColumn("hi", F.col("hi") + 5), spans.filter("NOT returned").withColumn("hi", F.col("hi") + 5)
    return graph.interval_overlaps(a, b, ["l_suppkey"], "l_orderkey", "l_orderkey", "lo", "hi", 30)


# Metrics


@query("""SELECT coalesce(c_mktsegment, 'all') AS c_mktsegment, coalesce(c_nationkey, -1) AS c_nationkey, count(*) AS total, count(*) FILTER (c_acctbal < 0) AS unresolved FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())""")
def dependency_metrics(table):
    c = table("customer")
    return c.groupingSets([[c.c_mktsegment, c.c_nationkey], [c.c_mktsegment], []], c.c_mktsegment, c.c_nationkey).agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("unresolved")).fillna({"c_mktsegment": "all", "c_nationkey": -1})


@query("""SELECT c_mktsegment, count(*) FILTER (o_orderpriority = '1-URGENT') AS p1, count(*) FILTER (o_orderpriority = '2-HIGH') AS p2, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS other FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def health_pivot(table):
    o = table("orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderpriority") == "1-URGENT", "p1").when(F.col("o_orderpriority") == "2-HIGH", "p2").otherwise("other").alias("p"))
    return table("customer").join(o, "c_custkey", "left").groupBy("c_mktsegment").pivot("p", ["p1", "p2", "other"]).count().fillna(0)


@query("""SELECT p_brand, count(*) AS stores, count(DISTINCT s_nationkey) AS owners FROM (SELECT DISTINCT p_brand, l_suppkey, s_nationkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 1""")
def shared_stores(table):
    s = table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = table("lineitem").select("l_partkey", "l_suppkey").join(table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(s, "l_suppkey")
    return rows.select("p_brand", "l_suppkey", "s_nationkey").distinct().groupBy("p_brand").agg(F.count("*").alias("stores"), F.count_distinct("s_nationkey").alias("owners")).filter("owners > 1")


# Routes and paths


@query("""SELECT prefix, count(*) AS routes FROM (SELECT array_to_string(list_slice(list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda s: s <> ''), 1, 2), '/') AS prefix FROM pages) GROUP BY 1 HAVING count(*) >= 2""")
def route_prefix_clusters(table):
    return table("pages").select(T.path_prefix(F.regexp_replace("url", r"[?#].*$", ""), 2).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("routes")).filter("routes >= 2")


@query("""WITH f AS (SELECT page_id, list_slice(string_split(regexp_replace(url, '[?#].*$', ''), '/'), 1, 3) AS d, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS p FROM pages), g AS (SELECT DISTINCT array_to_string(d, '/') AS folder FROM f)
SELECT folder, count(*) AS files FROM f JOIN g ON starts_with(array_to_string(p, '/') || '/', folder || '/') GROUP BY folder""")
def prefix_join(table):
    path = F.regexp_replace("url", r"[?#].*$", "")
    files = table("pages").select("page_id", path.alias("path"))
    folders = files.select(F.array_join(F.slice(F.split("path", "/"), 1, 3), "/").alias("folder")).distinct()
    return files.select("page_id", F.explode(T.all_prefixes(F.col("path"))).alias("folder")).join(folders, "folder").groupBy("folder").agg(F.count("*").alias("files"))


def _fixture(table) -> tuple[DataFrame, DataFrame]:
    """Routes and calls cut from the pages' URLs: the language is the backend, the number a parameter."""
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*", "")
    parts = F.split(F.regexp_replace(path, r"[?#].*$", ""), "/")
    rows = table("pages").select("page_id", path.alias("call_path"), parts[1].alias("repo"), parts.alias("parts"))
    r = rows.select(F.coalesce("repo", F.lit("")).alias("repo"), F.element_at(F.array(F.lit("GET"), F.lit("POST")), (F.col("page_id") % 2 + 1).cast("int")).alias("method"), F.concat_ws("/", F.lit(""), "repo", F.lit(":id")).alias("path"), F.lit("route").alias("kind")).distinct()
    c = rows.select(F.lit("site").alias("base"), "call_path", F.lit("GET").alias("call_method"), F.concat(F.lit("page:"), "page_id").alias("call_evidence"))
    return r, c.withColumn("base", F.concat(F.lit("base-"), F.coalesce(F.regexp_extract("call_path", r"^/([^/?]*)", 1), F.lit(""))))


@query()
def route_linkage(table):
    r, c = _fixture(table)
    return routes.classify(r, c, routes.attribute_bases(r, c))


# Text


@query()
def redaction(table):
    return table("documents").select("doc_id", T.redact(F.col("text")).alias("text")).withColumn("n", F.regexp_count("text", F.lit("<REDACTED>"))).filter("n > 0").select("doc_id", "n", F.sha2("text", 256).alias("sha"))


@query("""SELECT conv_id, turn, length(text) AS chars, ceil(length(text) / 4.0)::BIGINT AS tokens, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda s: s <> ''))::INT AS words, 'c-' || substr(sha1(conv_id || chr(0) || turn), 1, 16) AS id FROM conversations""")
def text_counts(table):
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda s: s != ""))
    return table("conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"), T.estimated_tokens(F.col("text")).alias("tokens"), words.alias("words"), T.stable_id("c-", F.col("conv_id"), F.col("turn")).alias("id"))


@query("""SELECT p_partkey, substr(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64) AS slug, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS name FROM part""")
def slugs(table):
    return table("part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), T.normal_name(F.col("p_type")).alias("name"))


@query("""SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(props, '[0-9][0-9,]*(\\.[0-9]+)?'), lambda s: replace(s, ',', '')))), '|') AS numbers, json_extract_string(props, '$.k') AS k FROM events""")
def numbers_and_json(table):
    return table("events").select("event_id", F.array_join(T.numbers_in(F.col("props")), "|").alias("numbers"), F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT path, count(*) AS files, CASE WHEN path LIKE '%node_modules%' THEN 'vendored' WHEN path LIKE '%dist%' THEN 'build-output' WHEN path LIKE '%_test.go' THEN 'test' ELSE '' END AS reason
FROM (SELECT CASE page_id % 4 WHEN 0 THEN 'node_modules/x.js' WHEN 1 THEN 'a/dist/x.js' WHEN 2 THEN 'svc/run_test.go' ELSE 'svc/run.go' END AS path FROM pages) GROUP BY 1, 3""")
def exclusions(table):
    path = F.element_at(F.array(*map(F.lit, ("node_modules/x.js", "a/dist/x.js", "svc/run_test.go", "svc/run.go"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table("pages").select(path.alias("path")).groupBy("path", S.exclusion_reason(F.col("path")).alias("reason")).agg(F.count("*").alias("files"))


# Event log


@query("""SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS header FROM events""")
def carry_forward(table):
    log = table("events").withColumn("h", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return ledger.carry_forward(log, "user_id", ["ts", "event_id"], "h", "header").select("event_id", "user_id", F.coalesce("header", F.lit(-1)).alias("header"))


_STATES = """WITH g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS gen FROM events), l AS (SELECT *, max(gen) OVER (PARTITION BY user_id) AS mx FROM g),
s AS (SELECT user_id, max(gen) AS generation, count(*) FILTER (event_type = 'error') AS attempts, count(*) FILTER (event_type = 'click') AS claims, bool_or(event_type = 'purchase') AS done FROM l WHERE gen = mx GROUP BY 1)
SELECT *, NOT done AND attempts >= 3 AS exhausted, CASE WHEN generation = 0 THEN 'unknown' WHEN done THEN 'done' WHEN attempts >= 3 THEN 'exhausted' WHEN claims > attempts THEN 'claimed' ELSE 'open' END AS state FROM s"""


def _states(table) -> DataFrame:
    return ledger.replay(table("events"), "user_id", ["ts", "event_id"], "event_type", created="signup", claimed="click", validated="purchase", failed="error", most_attempts=3)


@query(_STATES)
def ledger_replay(table):
    return _states(table)


@query(f"""WITH t AS ({_STATES}), d AS (SELECT DISTINCT user_id, user_id // 2 AS needs FROM events WHERE user_id > 0) SELECT t.user_id, bool_and(d.needs IS NULL OR coalesce(n.done, false)) AS is_ready FROM t LEFT JOIN d USING (user_id) LEFT JOIN t n ON n.user_id = d.needs GROUP BY 1""")
def readiness(table):
    needs = table("events").filter("user_id > 0").select("user_id", F.floor(F.col("user_id") / 2).alias("needs")).distinct()
    return ledger.readiness(_states(table).checkpoint(), needs, "user_id", "needs")


# Totals


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS merges, count(*) FILTER (o_orderstatus IS DISTINCT FROM 'P') AS others,
min(o_orderdate)::DATE::VARCHAR AS oldest, max(o_orderdate)::DATE::VARCHAR AS newest FROM orders""")
def history_completeness(table):
    return history.completeness(table("orders"), "o_orderdate", F.col("o_orderstatus") == "P")


@query("""SELECT p_brand, grouping(p_brand) = 1 AS is_total, count(*) AS rows, sum(p_size)::BIGINT AS lines, sum(p_partkey % 7)::BIGINT AS comments FROM part GROUP BY ROLLUP (p_brand)""")
def label_totals(table):
    return ranking.with_grand_total(table("part"), "p_brand", {"lines": F.col("p_size"), "comments": F.col("p_partkey") % 7})
