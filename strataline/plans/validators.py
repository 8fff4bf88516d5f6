"""Outputs and findings made from orders and their lines, with faults by rules over the keys, and the SQL that names the faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators import validators as V
from strataline.plans.registry import query

_SCHEMA = {
    "type": "object", "required": ["id", "status", "lines"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 3}, "status": {"type": "string", "enum": ["F", "O", "P"]}, "note": {"type": ["string", "null"], "line": True, "maxLength": 12},
        "lines": {"type": "array", "minItems": 1, "maxItems": 6, "uniqueItems": True, "items": {"type": "object", "required": ["no"], "properties": {"no": {"type": "integer", "maximum": 6}, "tax": {"type": "number"}}}},
    },
}


def _outputs(table) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.struct(F.col("l_linenumber").alias("no"), F.when(F.col("l_orderkey") % 7 == 0, F.lit("much")).otherwise(F.col("l_tax").cast("string")).alias("t"))
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    number = lambda x: F.when(F.col("o_orderkey") % 7 == 0, F.to_json(F.struct(x["no"].alias("no"), x["t"].alias("tax")))).otherwise(F.to_json(F.struct(x["no"].alias("no"), x["t"].cast("double").alias("tax"))))
    items = F.concat(F.lit("["), F.array_join(F.transform("lines", number), ","), F.lit("]"))
    # some outputs lack members or have further ones
    parts = F.array_compact(F.array(
        F.concat(F.lit('"id":'), k.cast("string")), F.when(k % 5 > 0, F.concat(F.lit('"status":"'), F.when(k % 11 == 0, "X").otherwise(F.col("o_orderstatus")), F.lit('"'))),
        F.when(k % 3 == 0, F.when(k % 2 == 0, '"note":null').otherwise('"note":"a longer remark"')), F.when(k % 13 == 0, '"more":{"x":1}'), F.concat(F.lit('"lines":'), items),
    ))
    doc = F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, "[1]").otherwise(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
    return table("orders").join(lines, "o_orderkey").select(k.alias("task"), F.when(k % 23 == 0, "other").otherwise("order").alias("kind"), F.parse_json(doc).alias("doc"))


# what is wrong with each output; lines are numbered from 0 by their order
_VIOLATIONS = """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS no, CASE WHEN l_orderkey % 7 = 0 THEN 'much' ELSE l_tax::VARCHAR END AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN 'much' ELSE l_tax::VARCHAR END) - 1 AS i FROM lineitem),
n AS (SELECT k, count(*) AS n, count(DISTINCT (no, t)) AS d FROM l GROUP BY k), o AS (SELECT o_orderkey AS k, o_orderstatus AS s, n, d, o_orderkey % 17 = 0 AS missing, o_orderkey % 23 = 0 AS other, o_orderkey % 19 = 0 AS list FROM orders JOIN n ON k = o_orderkey),
x AS (SELECT * FROM o WHERE NOT missing AND NOT other AND NOT list), v AS (
  SELECT k, '$' AS path, 'missing' AS rule, '' AS detail FROM o WHERE missing UNION ALL SELECT k, '$', 'kind', 'other' FROM o WHERE NOT missing AND other UNION ALL SELECT k, '$', 'type', 'array' FROM o WHERE NOT missing AND NOT other AND list
  UNION ALL SELECT k, '$', 'required', 'status' FROM x WHERE k % 5 = 0 UNION ALL SELECT k, '$', 'additionalProperties', 'more' FROM x WHERE k % 13 = 0 UNION ALL SELECT k, '$.id', 'minimum', k::VARCHAR FROM x WHERE k < 3
  UNION ALL SELECT k, '$.status', 'enum', 'X' FROM x WHERE k % 5 > 0 AND k % 11 = 0 UNION ALL SELECT k, '$.note', 'line', NULL FROM x WHERE k % 6 = 0 UNION ALL SELECT k, '$.note', 'maxLength', 'a longer remark' FROM x WHERE k % 3 = 0 AND k % 2 = 1
  UNION ALL SELECT k, '$.lines', 'maxItems', n::VARCHAR FROM x WHERE n > 6 UNION ALL SELECT k, '$.lines', 'uniqueItems', n::VARCHAR FROM x WHERE d < n
  UNION ALL SELECT k, '$.lines[' || i || '].no', 'maximum', no::VARCHAR FROM l JOIN x USING (k) WHERE no > 6 UNION ALL SELECT k, '$.lines[' || i || '].tax', 'type', 'string' FROM l JOIN x USING (k) WHERE k % 7 = 0)"""


@query(f"{_VIOLATIONS} SELECT k AS task, path, rule, detail FROM v")
def output_violations(table):
    return V.each_violation(V.checked(_outputs(table), "kind", "doc", {"order": _SCHEMA}), "task")


@query(f"""{_VIOLATIONS}, r AS (SELECT *, CASE rule WHEN 'required' THEN 1 WHEN 'additionalProperties' THEN 2 WHEN 'minimum' THEN 3 WHEN 'enum' THEN 4 WHEN 'line' THEN 5 WHEN 'maxLength' THEN 6 WHEN 'maxItems' THEN 7 WHEN 'uniqueItems' THEN 8 WHEN 'maximum' THEN 9 WHEN 'type' THEN 9 ELSE 0 END AS w,
  coalesce(nullif(regexp_extract(path, '[[]([0-9]+)', 1), '')::INT, 0) AS i, CASE WHEN path LIKE '%.no' THEN 0 ELSE 1 END AS m FROM v)
SELECT o.k AS task, f.rule FROM o LEFT JOIN (SELECT k, arg_min(rule, (w, i, m)) AS rule FROM r GROUP BY k) f USING (k)""")
def first_violations(table):
    return V.fails(V.checked(_outputs(table), "kind", "doc", {"order": _SCHEMA})).select("task", "rule")


def _findings(table) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    basis = F.when(n % 3 == 0, "history").otherwise("declaration")
    item = F.struct(F.lit("fact").alias("fact"), basis.alias("basis"), F.array(F.concat(F.lit("r"), F.col("l_suppkey").cast("string"))).alias("refs"))
    lines = table("lineitem").groupBy(k.alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("evidence"), F.array_sort(F.collect_set(basis)).alias("bases"))
    o = F.col("o_orderkey")
    doc = F.struct(
        F.concat(F.lit("finding-"), (o - F.when((o % 31 == 0) & (o > 0), 1).otherwise(0)).cast("string")).alias("finding_id"), F.lit("c").alias("claim"), F.lit("l").alias("lens"), F.lit("low").alias("priority"), F.when(o % 2 == 0, "high").otherwise("low").alias("confidence"),
        F.array(F.concat(F.lit("m"), (F.col("o_custkey") % 40).cast("string"))).alias("affected_modules"), F.when(o % 9 == 0, F.array(F.lit("history"))).otherwise(F.col("bases")).alias("evidence_basis"), "evidence",
    )
    return table("orders").join(lines, "o_orderkey").select(F.lit("run").alias("run"), o.alias("no"), F.to_variant_object(doc).alias("doc"))


@query("""WITH l AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN 'history' ELSE 'declaration' END AS basis, 'r' || l_suppkey AS ref, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 'history' ELSE 'declaration' END, 'r' || l_suppkey) - 1 AS i FROM lineitem),
g AS (SELECT k, count(*) AS n, list_sort(list(DISTINCT basis)) AS bases, count(DISTINCT l_suppkey % 4) FILTER (l_suppkey % 11 > 0) AS origins, bool_or(l_suppkey % 11 = 0) AS open FROM l GROUP BY k),
o AS (SELECT o_orderkey AS k, 'finding-' || (o_orderkey - CASE WHEN o_orderkey % 31 = 0 AND o_orderkey > 0 THEN 1 ELSE 0 END) AS finding, o_custkey % 40 AS m, g.* EXCLUDE (k) FROM orders JOIN g ON k = o_orderkey)
SELECT k AS no, finding, '$.finding_id' AS path, 'duplicate' AS rule, finding AS detail FROM (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY k) AS t FROM o) WHERE t > 1
UNION ALL SELECT k, finding, '$.affected_modules', 'unknown module', 'm' || m FROM o WHERE m >= 25 UNION ALL SELECT DISTINCT k, finding, '$.evidence[' || i || '].refs', 'unknown reference', ref FROM l JOIN o USING (k) WHERE l_suppkey % 11 = 0
UNION ALL SELECT k, finding, '$.evidence_basis', 'bases differ', array_to_string(bases, ',') FROM o WHERE k % 9 = 0 AND bases <> ['history'] UNION ALL SELECT k, finding, '$.confidence', 'two signals needed', origins::VARCHAR FROM o WHERE k % 2 = 0 AND NOT open AND (n < 2 OR origins < 2)""")
def findings_problems(table):
    modules = table("nation").select(F.lit("run").alias("run"), F.concat(F.lit("m"), "n_nationkey").alias("module_id"))
    s = F.col("s_suppkey")
    references = table("supplier").filter(s % 11 > 0).select(F.lit("run").alias("run"), F.concat(F.lit("r"), s.cast("string")).alias("ref"), (s % 4).cast("string").alias("origin"))
    return V.findings_problems(_findings(table), modules, references).drop("run")
