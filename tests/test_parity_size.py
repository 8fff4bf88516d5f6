"""Comparing runs writes no intermediate tables, shuffles facts whole, and loses nothing of documents that are deeper than said."""

import json
import os
import re
from urllib.parse import urlparse

import pytest
from strataline import plans
from strataline.operators import parity as P

SF = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame([("a.json", t) for t in texts], "artifact string, doc string").selectExpr("artifact", "parse_json(doc) AS doc")


def checkpoints(spark):
    folder = urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path
    return {os.path.join(d, f) for d, _, files in os.walk(folder) for f in files}


@pytest.mark.parametrize("name", ["fact_entries", "run_verdict"])
def test_nothing_is_written_on_the_way(spark, name):
    P.levels_of(docs(spark, "{}"))
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    before = checkpoints(spark)
    found = plans.QUERIES[name](spark, SF)
    found.collect()
    assert checkpoints(spark) == before
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    # both runs share the shuffles that make their documents
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(artifact#\w+, fact#", plan)) == 1
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(l_orderkey#", plan)) == 1, plan


def test_levels(spark):
    deep = json.dumps({"a": [{"b": '}"]{[\\'}, [], {}]})
    assert P.levels_of(docs(spark, deep, "1")) == 3 and P.levels_of(docs(spark, "1")) == 0 and P.levels_of(docs(spark)) == 0
    flat = [P.flattened(docs(spark, t), [], levels=3) for t in (deep, deep.replace("{}]", "0]"))]
    assert [tuple(r) for r in P.fact_diff(*flat).collect()] == [("a.json", "/a[2]", "changed", [""])]
    with pytest.raises(Exception, match="more than 2 levels"):
        P.fact_diff(*[P.flattened(docs(spark, deep), [], levels=2)] * 2).collect()


def test_how_often_a_value_is_given_counts(spark):
    keys = [P.Keyed("/n", ("k",)), P.Keyed("/n[]/e", (P.VALUE,))]
    flat = [P.flattened(docs(spark, json.dumps({"n": [{"k": 1, "e": list(e), "o\0p": 1}]})), keys) for e in ("xxy", "xyy", "yxx")]
    assert [r["fields"] for r in P.fact_diff(flat[0], flat[1]).collect()] == [['/e["x"]', '/e["y"]']] and P.fact_diff(flat[0], flat[2]).isEmpty()
