"""Coverage of runs made from customers (runs), orders (repositories) and lines (producers), and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators import coverage as C
from strataline.plans.registry import query

_NAMES = [p.name for p in C.PARTITIONS]


def _pick(names: list[str], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


def _said(table) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    state = _pick(["complete", "complete", "complete", "partial", "unavailable", "failed", "not-applicable"], F.when(k % 5 > 1, F.lit(0)).otherwise((F.col("l_partkey") + n) % 7))
    lines = table("lineitem").join(table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").filter("o_custkey % 4 > 0")
    part = (F.col("l_suppkey") + n) % 10
    rows = lines.select(F.col("o_custkey").alias("run"), _pick(_NAMES, part).alias("partition"), k.alias("repository"), state.alias("state"), (F.col("l_quantity").cast("long") % 3).alias("found"), F.when(k % 3 == 0, F.col("l_partkey") % 2).otherwise(0).cast("long").alias("unresolved"), (F.col("l_partkey") % 29 == 0).alias("capped"))
    return rows


@query("""WITH names AS (SELECT ['repositories', 'files', 'symbols_and_calls', 'routes', 'tables', 'access_model', 'external_boundaries', 'deployable_units', 'dependency_imports', 'modules'] AS a, ['always', 'always', 'lanes', 'surface', 'stores', 'available', 'candidates', 'capped', 'maps', 'present'] AS b),
s AS (SELECT o_custkey AS run, a[(l_suppkey + l_linenumber) % 10 + 1] AS partition, l_orderkey AS repository, ['complete', 'complete', 'complete', 'partial', 'unavailable', 'failed', 'not-applicable'][CASE WHEN l_orderkey % 5 > 1 THEN 0 ELSE (l_partkey + l_linenumber) % 7 END + 1] AS state,
  l_quantity::BIGINT % 3 AS found, CASE WHEN l_orderkey % 3 = 0 THEN l_partkey % 2 ELSE 0 END AS unresolved, l_partkey % 29 = 0 AS capped FROM lineitem JOIN orders ON l_orderkey = o_orderkey, names WHERE o_custkey % 4 > 0),
p AS (SELECT run, partition, repository, arg_max(state, list_position(['complete', 'not-applicable', 'partial', 'unavailable', 'failed'], state)) AS state, sum(found) AS found, sum(unresolved) AS unresolved, bool_or(capped) AS capped FROM s GROUP BY ALL),
e AS (SELECT o_custkey AS run, x AS partition, o_orderkey AS repository FROM orders, (VALUES ('symbols_and_calls'), ('dependency_imports')) v(x) WHERE o_orderkey % 2 = 0 AND o_custkey % 3 > 0),
g AS (SELECT run, partition, count(state) AS seen, count(e.repository) AS eligible, count(*) FILTER (e.repository IS NOT NULL AND state IS NULL) AS missing, count(*) FILTER (state = 'failed') AS nf, count(*) FILTER (state = 'unavailable') AS nu, count(*) FILTER (state = 'partial') AS np, count(*) FILTER (state = 'not-applicable') AS na,
  coalesce(sum(found), 0)::BIGINT AS found, coalesce(sum(unresolved), 0)::BIGINT AS unresolved, coalesce(bool_or(capped), false) AS capped FROM p FULL JOIN e USING (run, partition, repository) GROUP BY 1, 2),
r AS (SELECT o_custkey AS run, count(*) AS repositories FROM orders GROUP BY 1),
w AS (SELECT r.run, t.x AS partition, t.y AS rule, r.repositories, coalesce(seen, 0) AS seen, coalesce(eligible, 0) AS eligible, coalesce(missing, 0) AS missing, coalesce(nf, 0) AS nf, coalesce(nu, 0) AS nu, coalesce(np, 0) AS np, coalesce(na, 0) AS na, coalesce(found, 0) AS found, coalesce(unresolved, 0) AS unresolved, coalesce(capped, false) AS capped
  FROM r CROSS JOIN (SELECT unnest(a) AS x, unnest(b) AS y FROM names) t LEFT JOIN g ON g.run = r.run AND g.partition = t.x),
z AS (SELECT *, CASE WHEN seen = 0 THEN 'unavailable' WHEN nf > 0 THEN 'failed' WHEN seen = na THEN 'not-applicable' WHEN nu = seen - na THEN 'unavailable' WHEN np + nu > 0 THEN 'partial' ELSE 'complete' END AS worst, seen - nu AS there FROM w),
y AS (SELECT *, CASE rule WHEN 'always' THEN 'complete' WHEN 'lanes' THEN CASE WHEN eligible = 0 THEN 'not-applicable' WHEN seen = 0 THEN 'unavailable' ELSE worst END
  WHEN 'maps' THEN CASE WHEN eligible = 0 THEN 'not-applicable' WHEN seen = 0 THEN 'partial' WHEN worst = 'failed' THEN 'failed' WHEN missing > 0 OR unresolved > 0 THEN 'partial' ELSE worst END
  WHEN 'surface' THEN CASE WHEN there > 0 AND (capped OR unresolved > 0) THEN 'partial' WHEN there > 0 THEN 'complete' WHEN found = 0 THEN 'not-applicable' ELSE 'partial' END WHEN 'stores' THEN worst
  WHEN 'available' THEN CASE WHEN there = 0 THEN 'unavailable' WHEN there < repositories OR capped THEN 'partial' ELSE 'complete' END WHEN 'candidates' THEN CASE WHEN there > 0 AND there >= repositories AND NOT capped THEN 'complete' ELSE 'partial' END
  WHEN 'capped' THEN CASE WHEN capped THEN 'partial' ELSE 'complete' END ELSE CASE WHEN seen > 0 THEN 'complete' ELSE 'unavailable' END END AS status FROM z)
SELECT run, partition, status, seen AS repositories, eligible, missing, found, unresolved, CASE WHEN status = 'complete' THEN '' WHEN status = 'not-applicable' THEN 'nothing-eligible' WHEN nf > 0 THEN 'producer-failed' WHEN seen = 0 THEN 'artifact-absent' WHEN missing > 0 THEN 'repositories-missing' WHEN capped THEN 'cap-hit' WHEN unresolved > 0 THEN 'open-references' ELSE 'producer-partial' END AS reason FROM y""")
def coverage_partitions(table):
    runs = table("orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("repositories"))
    both = F.explode(F.array(F.lit("symbols_and_calls"), F.lit("dependency_imports")))
    eligible = table("orders").filter("o_orderkey % 2 = 0 AND o_custkey % 3 > 0").select(F.col("o_custkey").alias("run"), both.alias("partition"), F.col("o_orderkey").alias("repository"))
    return C.coverage_partitions(runs, _said(table), eligible)


@query("""WITH e AS (SELECT o_custkey AS run, 'cap' || o_orderkey % 4 AS capability, 'f' || o_orderkey % 9 AS artifact, o_custkey % 6 > 0 AS applicable FROM orders), o AS (SELECT DISTINCT o_custkey AS run, 'f' || o_orderkey % 9 AS artifact FROM orders WHERE o_orderstatus = 'O'),
g AS (SELECT run, capability, bool_or(applicable) AS applicable, list_sort(list(DISTINCT artifact)) AS expected, coalesce(list_sort(list(DISTINCT artifact) FILTER ((run, artifact) IN (SELECT (run, artifact) FROM o))), []) AS observed FROM e GROUP BY 1, 2),
p AS (SELECT o_custkey AS run, 'cap' || o_orderkey % 4 AS capability, ['complete', 'skipped', 'partial', 'failed', 'complete', 'complete', 'complete', 'complete'][o_orderkey % 8 + 1] AS s FROM orders WHERE o_orderkey % 5 > 0), q AS (SELECT run, capability, list(s) AS s FROM p GROUP BY 1, 2)
SELECT run, capability, applicable, CASE WHEN NOT applicable THEN 'not-applicable' WHEN s IS NULL THEN 'failed' WHEN len(list_filter(s, lambda x: x <> 'skipped')) = 0 THEN 'unavailable' WHEN list_contains(s, 'failed') THEN 'failed' WHEN list_contains(s, 'partial') OR list_contains(s, 'skipped') THEN 'partial' ELSE 'complete' END AS status,
  array_to_string(expected, ',') AS expected, array_to_string(observed, ',') AS observed, array_to_string(list_filter(expected, lambda x: NOT list_contains(observed, x)), ',') AS missing FROM g LEFT JOIN q USING (run, capability)""")
def capability_records(table):
    k = F.col("o_orderkey")
    keys = [F.col("o_custkey").alias("run"), F.concat(F.lit("cap"), k % 4).alias("capability")]
    artifact = F.concat(F.lit("f"), k % 9).alias("artifact")
    expected = table("orders").select(*keys, artifact, (F.col("o_custkey") % 6 > 0).alias("applicable"))
    observed = table("orders").filter("o_orderstatus = 'O'").select(keys[0], artifact)
    producers = table("orders").filter("o_orderkey % 5 > 0").select(*keys, _pick(["complete", "skipped", "partial", "failed", "complete", "complete", "complete", "complete"], k % 8).alias("state"))
    found = C.capability_records(expected, observed, producers)
    return found.withColumns({c: F.array_join(c, ",") for c in ("expected", "observed", "missing")})


@query("""WITH s AS (SELECT o_orderkey AS k, ['complete', 'partial', 'failed', 'unavailable', 'not-applicable', 'skipped', 'odd'][o_orderkey % 7 + 1] AS s, o_custkey % 3 > 0 AS a FROM orders)
SELECT k, CASE WHEN s IN ('complete', 'partial', 'failed', 'skipped') THEN 'applicable ' || s || ' signal-status-' || s END AS signal,
  CASE WHEN s IN ('odd', 'skipped') OR (a AND s = 'not-applicable') THEN NULL WHEN NOT a THEN 'not-applicable complete capability-not-applicable' ELSE 'applicable ' || s || ' capability-status-' || s END AS capability,
  CASE WHEN s IN ('odd', 'skipped') THEN NULL WHEN s = 'not-applicable' THEN 'not-applicable complete datastore-coverage-not-applicable' ELSE 'applicable ' || s || ' datastore-coverage-' || s END AS store FROM s""")
def two_axis_statuses(table):
    s, a = _pick(["complete", "partial", "failed", "unavailable", "not-applicable", "skipped", "odd"], F.col("o_orderkey") % 7), F.col("o_custkey") % 3 > 0
    line = lambda c: F.concat_ws(" ", c["applicability"], c["status"], c["reason"])
    shown = lambda c: F.when(c.isNotNull(), line(c))
    return table("orders").select(F.col("o_orderkey").alias("k"), shown(C.two_axes(s)).alias("signal"), shown(C.two_axes(s, a, "capability")).alias("capability"), shown(C.two_axes(s, kind="datastore-coverage")).alias("store"))
