"""Two runs' documents, made from each customer's orders, compared fact by fact; with the SQL that gives the same entries from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators import parity
from strataline.plans.registry import query

_KEYS = [parity.Keyed("/orders", ("id",)), parity.Keyed("/orders[]/tags", (parity.VALUE,)), parity.Keyed("/orders[]/lines", ("no", "part"))]
_NOISE = [parity.Noise("/scan_date"), parity.Noise(r"/orders\[\]/cache"), parity.Noise("/root", "scrub")]


# objects and arrays within each other: document, orders, order, lines, line
_LEVELS = 5


def _documents(table, run: str) -> DataFrame:
    """A document for each customer; the candidate run differs by rules over the keys. Both are made of the same groups, so that Spark shuffles the tables once."""
    new = run == "candidate"
    c = F.col("o_custkey")
    when = lambda condition, a, b: F.when(condition, a).otherwise(b) if new else b
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    orders = table("orders").join(lines, "o_orderkey", "left")
    grouped = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "lines")).alias("given"))

    def order(o):
        k, quantity = o["o_orderkey"], lambda x: when(k % 19 == 0, x["quantity"] + 1, x["quantity"])
        # the sides list sets and items in other orders
        tags = [F.lit("a"), o["o_orderpriority"], when(k % 23 == 0, F.lit("new"), F.lit("old"))]
        held = F.transform(o["lines"], lambda x: F.struct(x["no"].alias("no"), x["part"].alias("part"), quantity(x).alias("quantity")))
        price = when(k % 11 == 0, o["o_totalprice"] + 1, o["o_totalprice"])
        return F.struct(k.alias("id"), when(k % 7 == 0, F.lit("X"), o["o_orderstatus"]).alias("status"), price.alias("price"), F.array(*(tags[::-1] if new else tags)).alias("tags"), held.alias("lines"), F.lit(run).alias("cache"))

    # a condition on the key alone would be pushed below the groups, and each run would shuffle the orders for itself
    given = F.when(c % (17 if new else 31) != 0, F.filter("given", lambda o: o["o_orderkey"] % (13 if new else 29) != 0))
    kept = grouped.select("o_custkey", given.alias("given")).filter(F.size("given") > 0)
    body = F.struct(F.lit(run).alias("scan_date"), F.concat(F.lit(f"/{run}/work/"), c.cast("string")).alias("root"), when(c % 5 == 0, F.lit("moved"), F.lit("here")).alias("head"), F.struct(F.lit(None).cast("int").alias("none"), F.array().cast("array<int>").alias("empty")).alias("more"), F.sort_array(F.transform("given", order), asc=not new).alias("orders"))
    return kept.select(F.concat(F.lit("repos/"), c.cast("string"), F.lit(".json")).alias("artifact"), F.to_variant_object(body).alias("doc"))


def _flat(table, run: str) -> parity.Flattened:
    return parity.flattened(_documents(table, run), _KEYS, _NOISE, {f"/{run}/work": "$WORK"}, _LEVELS)


_ENTRIES = """WITH o AS (SELECT *, o_orderkey AS k, o_custkey AS c FROM orders),
b AS (SELECT * FROM o WHERE k % 29 <> 0 AND c % 31 <> 0), n AS (SELECT * FROM o WHERE k % 13 <> 0 AND c % 17 <> 0),
items AS (SELECT coalesce(b.c, n.c) AS c, coalesce(b.k, n.k) AS k, b.k IS NULL AS added, n.k IS NULL AS removed FROM b FULL JOIN n USING (k)),
l AS (SELECT l_orderkey AS k, l_linenumber AS no, l_partkey AS part FROM lineitem WHERE l_orderkey % 19 = 0 GROUP BY ALL),
fields AS (
  SELECT k, '/status' AS f FROM o WHERE k % 7 = 0 AND o_orderstatus <> 'X' UNION ALL SELECT k, '/price' FROM o WHERE k % 11 = 0
  UNION ALL SELECT k, '/tags["' || t || '"]' FROM o, (VALUES ('new'), ('old')) v(t) WHERE k % 23 = 0 UNION ALL SELECT k, '/lines[no=' || no || ',part=' || part || ']/quantity' FROM l
), one AS (SELECT k, list_sort(list(f)) AS f FROM fields GROUP BY k),
docs AS (SELECT c, c IN (SELECT c FROM b) AS in_b, c IN (SELECT c FROM n) AS in_n FROM (SELECT DISTINCT c FROM o)),
e AS (
  SELECT c, '/orders[id=' || k || ']' AS fact, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN f = ['/status'] THEN 'reclassified' ELSE 'changed' END AS change, CASE WHEN NOT added AND NOT removed THEN array_to_string(f, ' ') ELSE '*' END AS fields
  FROM items LEFT JOIN one USING (k) WHERE added OR removed OR f IS NOT NULL
  UNION ALL SELECT c, fact, CASE WHEN in_b THEN 'removed' ELSE 'added' END, '*' FROM docs, (VALUES ('/head'), ('/root'), ('/more/none'), ('/more/empty')) v(fact) WHERE in_b <> in_n
  UNION ALL SELECT c, '/head', 'changed', '' FROM docs WHERE in_b AND in_n AND c % 5 = 0)"""


@query(f"""{_ENTRIES} SELECT 'repos/' || c || '.json' AS artifact, fact, change, fields FROM e""")
def fact_entries(table):
    found = parity.fact_diff(_flat(table, "base"), _flat(table, "candidate"))
    return found.withColumn("fields", F.when(F.col("change").isin("added", "removed"), "*").otherwise(F.array_join("fields", " ")))


@query(f"""{_ENTRIES} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'reclassified') AS reclassified,
  (SELECT count(*) FROM docs WHERE in_b <> in_n) AS missing, count(*) = 0 AS same FROM e""")
def run_verdict(table):
    missing = parity.presence(_documents(table, "base"), _documents(table, "candidate"))
    return parity.verdict(parity.fact_diff(_flat(table, "base"), _flat(table, "candidate")), missing)


def _modules(table, new: bool) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    brands = table("part").groupBy("p_brand").agg(F.min("p_partkey").alias("m"), F.array_sort(F.collect_set("p_type")).alias("aliases"))
    kept = brands.filter(F.col("m") % (9 if new else 7) != 0)
    modules = kept.select(F.col("p_brand").alias("module_id"), F.concat(F.lit("N"), F.col("m") % (4 if new else 5)).alias("name"), F.lit("core").alias("classification"), "aliases")
    moved = F.when(k % 40 == 0, F.array()).otherwise(F.array("p_brand")) if new else F.array("p_brand")
    return modules, table("part").select(F.concat(F.lit("k"), k).alias("candidate_id"), moved.cast("array<string>").alias("module_ids"))


@query("""WITH g AS (SELECT p_brand, min(p_partkey) AS m, bool_or(p_partkey % 40 = 0) AS moved FROM part GROUP BY 1)
SELECT p_brand AS module_id, CASE WHEN m % 7 = 0 THEN 'added' WHEN m % 9 = 0 THEN 'removed' ELSE 'changed' END AS change FROM g WHERE NOT (m % 7 = 0 AND m % 9 = 0) AND (m % 7 = 0 OR m % 9 = 0 OR m % 4 <> m % 5 OR moved)""")
def module_map_changes(table):
    return parity.module_map_diff(_modules(table, False), _modules(table, True))


def _prose(table, new: bool) -> DataFrame:
    line = F.col("l_linenumber") + (F.when(F.col("l_orderkey") % 9 == 0, 100).otherwise(0) if new else 0)
    said = F.concat(F.lit("See (r@h:a"), F.col("l_partkey").cast("string"), F.lit(".go:"), line.cast("string"), F.lit("), and more."))
    return table("lineitem").select(F.col("l_returnflag").alias("document"), said.alias("text"))


@query("""WITH x AS (SELECT DISTINCT l_returnflag AS document, 'r@h:a' || l_partkey || '.go:' || l_linenumber AS citation FROM lineitem), y AS (SELECT DISTINCT l_returnflag AS document, 'r@h:a' || l_partkey || '.go:' || (l_linenumber + CASE WHEN l_orderkey % 9 = 0 THEN 100 ELSE 0 END) AS citation FROM lineitem)
SELECT *, 'removed' AS side FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT *, 'added' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""")
def citation_changes(table):
    return parity.citation_diff(_prose(table, False), _prose(table, True))


@query("""SELECT 'd' || o_orderstatus AS document, o_orderpriority AS heading, sum(o_custkey)::BIGINT AS base_words, coalesce(sum(o_custkey + 1) FILTER (o_orderkey % 37 <> 0), 0)::BIGINT AS words FROM orders GROUP BY 1, 2 HAVING coalesce(sum(o_custkey + 1) FILTER (o_orderkey % 37 <> 0), 0) < sum(o_custkey)""")
def section_losses(table):
    o = table("orders").select(F.concat(F.lit("d"), "o_orderstatus").alias("document"), F.col("o_orderpriority").alias("heading"), F.col("o_custkey").alias("words"), "o_orderkey")
    return parity.shrunken_sections(o, o.filter("o_orderkey % 37 <> 0").withColumn("words", F.col("words") + 1))
