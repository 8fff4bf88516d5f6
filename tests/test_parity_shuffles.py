"""Both runs' documents come from one shuffle of the orders; shapes without wildcards are compared as texts."""

import pytest
from pyspark.sql import functions as F
from strataline import plans
from strataline.operators import parity as P


@pytest.mark.parametrize("name", ["fact_entries", "run_verdict"])
def test_orders_are_shuffled_once_for_both_runs(spark, name):
    found = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert sum("Exchange hashpartitioning(o_custkey#" in x and "ReusedExchange" not in x for x in plan.split("\n")) == 1, plan


def test_patterns(spark):
    df = spark.createDataFrame([("/a[]/b",), ("/a[]/bc",), ("/axx",), ("/a.b",), ("/aXb",)], "s string")
    got = {p: [r["s"] for r in df.filter(P._matches(p, F.col("s"))).collect()] for p in (r"/a\[\]/b", "/axx", r"/a\.b", "/a.b", "/a.*", ".*", "/axx|/aXb")}
    assert got == {r"/a\[\]/b": ["/a[]/b"], "/axx": ["/axx"], r"/a\.b": ["/a.b"], "/a.b": ["/a.b", "/aXb"], "/a.*": [r["s"] for r in df.collect()], ".*": [r["s"] for r in df.collect()], "/axx|/aXb": ["/axx", "/aXb"]}
