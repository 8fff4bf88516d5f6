"""Queries of readers: files that Spark writes from the tables in the formats read, and the SQL that gives the rows from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.operators import dependencies
from strataline.operators.graph import ready
from strataline.plans.registry import query
from strataline.sources import readers


def _saved(rows: DataFrame, value: Column, name: str, separator: str = "\n") -> str:
    """The folder of a text of each row's value, one after the other, in the checkpoint folder, which all executors share."""
    spark = rows.sparkSession
    ready(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    rows.select(value).write.option("lineSep", separator).text(path)
    return path


@query("""SELECT event_id, user_id, 'a}"{' || event_type || '\\' || props AS note FROM events""")
def json_streams(table):
    e = table("events")
    note = F.concat(F.lit('a}"{'), "event_type", F.lit("\\"), "props")
    value = F.to_json(F.struct("event_id", F.struct("user_id", note.alias("note")).alias("in")))
    path = _saved(e, value, "stream", " ")
    return readers.json_stream(e.sparkSession, path, "event_id long, `in` struct<user_id: long, note: string>").select("event_id", "in.user_id", "in.note")


@query("""SELECT event_id, user_id, event_type AS event FROM events""")
def ledger_lines(table):
    e = table("events")
    path = _saved(e, F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("event"))), "ledger")
    return readers.json_lines(e.sparkSession, path, "event_id long, user_id long, event string", strict=True)


@query("""SELECT 'd' || l_returnflag AS dyn, 'n' AS descr, 'f' || l_partkey AS caller_sym, 'p' || l_suppkey AS caller_pkg, 'x.go:' || l_linenumber AS caller_decl, 'x.go:' || l_quantity::INT AS callsite, 'g' AS callee_sym, '' AS callee_pkg, 'y.go:1' AS callee_decl FROM lineitem WHERE l_linenumber <> 3""")
def call_tables(table):
    t = table("lineitem")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    columns = [text("d", F.col("l_returnflag")), F.lit("n"), text("f", F.col("l_partkey")), text("p", F.col("l_suppkey")), text("x.go:", F.col("l_linenumber")), text("x.go:", F.col("l_quantity").cast("int")), F.lit("g"), F.lit(""), F.lit("y.go:1")]
    # a third of the lines lacks columns
    value = F.when(F.col("l_linenumber") == 3, F.concat_ws("\t", *columns[:5])).otherwise(F.concat_ws("\t", *columns))
    return readers.callgraph(t.sparkSession, _saved(t, value, "calls"))


@query("""SELECT 'C' || o_custkey AS name, 'c' || o_custkey || '@x' AS email, l_linenumber::BIGINT AS added, CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity::BIGINT END AS deleted,
  CASE l_returnflag WHEN 'A' THEN 'src/new' || l_partkey || '/f.go' WHEN 'R' THEN 'b' || l_partkey ELSE 'f' || l_partkey END AS path
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey % 7 > 0""")
def commit_logs(table):
    part, flag = F.col("l_partkey").cast("string"), F.col("l_returnflag")
    path = F.when(flag == "A", F.concat(F.lit("src/{old => new"), part, F.lit("}/f.go"))).when(flag == "R", F.concat(F.lit("a => b"), part)).otherwise(F.concat(F.lit("f"), part))
    line = F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.when(flag == "N", "-").otherwise(F.col("l_quantity").cast("int").cast("string")), path)
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    who = F.col("o_custkey").cast("string")
    name = F.when(F.col("o_custkey") % 7 == 0, "dependabot[bot]").otherwise(F.concat(F.lit("C"), who))
    header = F.concat_ws("\t", F.lit("@@"), name, F.concat(F.lit("c"), who, F.lit("@x")), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    commits = table("orders").join(lines, "o_orderkey", "left")
    log = _saved(commits, F.concat_ws("\n", header, "lines", F.lit("")), "log")
    return readers.numstat(commits.sparkSession, log, bots=False, since="1996-01-01T00:00:00Z").drop("file", "commit_no")


@query("""SELECT 'go' AS format, (l_quantity::INT) AS span, 'a' || l_partkey || '.go' AS a_file, l_linenumber AS a_from, l_linenumber + l_quantity::INT AS a_to, 'b' || l_suppkey || '.go' AS b_file, 7 AS b_from, 9 AS b_to FROM lineitem""")
def clone_reports(table):
    t = table("lineitem")
    begin, long = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    value = F.concat(F.lit("Clone found (go):\n - a"), "l_partkey", F.lit(".go ["), begin, F.lit(":1 - "), begin + long, F.lit(":2] ("), long, F.lit(" lines)\n   b"), "l_suppkey", F.lit(".go [7:1 - 9:2]\n"))
    return readers.clone_pairs(t.sparkSession, _saved(t, value, "clones"))


@query("""SELECT page_id, count(*) AS words FROM (SELECT page_id, unnest(range(page_id % 7 + 1)) FROM pages) GROUP BY page_id""")
def report_sections(table):
    # each page's rows stand between two headers of one report
    pages = table("pages").select("page_id", F.explode(F.sequence(F.lit(1), F.col("page_id") % 7 + 1)).alias("i"))
    rows = pages.select(F.lit(1).alias("k"), "page_id", F.col("i").cast("long").alias("i"), F.concat_ws(" ", "page_id", "i").alias("line"))
    other = pages.sparkSession.createDataFrame([(0, 0, 0, "Other:"), (0, 0, 1, "9 9"), (0, 0, 2, ""), (0, 0, 3, "Words:"), (2, 0, 0, " "), (2, 0, 1, "8 8")], "k int, page_id long, i long, line string")
    lines = rows.unionByName(other).select(F.struct("k", "page_id", "i").alias("at"), "line")
    found = readers.section(lines, "at", "line", "Words:")
    return found.groupBy(F.split("line", " ")[0].cast("long").alias("page_id")).agg(F.count("*").alias("words"))


@query("""SELECT p_brand, sum(p_size)::BIGINT AS n FROM part GROUP BY 1""")
def language_order(table):
    totals = table("part").groupBy("p_brand").agg(F.sum("p_size").alias("n"))
    return dependencies.language_order(totals, "n", "p_brand")
