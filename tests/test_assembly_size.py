"""Equal parts are made one before anything is worked out of them, and an edge's evidence crosses the network once after that."""

import re

from pyspark.sql import functions as F
from strataline import plans
from strataline.operators import assembly as A


def test_equal_parts_are_one(spark):
    df = spark.range(1000).select(F.concat(F.lit("r"), F.col("id") % 2).alias("r"), F.format_string("%04d", F.col("id")).alias("at"))
    part = A.node("repository", [F.col("r")], label=F.col("r"), producer="p", evidence=F.array(F.lit("e")), attrs={"a": F.lit(1)})
    rows = A._rows([A._parts(df, F.col("at"), [part], [])], "nodes")
    assert sorted((r["kind"], r["key"][0], r["order"]["at"]) for r in rows.collect()) == [("repository", "r0", "0000"), ("repository", "r1", "0001")]


def test_edges_are_merged_in_one_shuffle(spark):
    plan = plans.QUERIES["assembled_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(id#", plan)) == 1
