"""Rows of a source are worked out once: places once for each pair of symbol and citation, ends only where no loader gives them, calls in columns."""

import re

import pytest
from pyspark.sql import functions as F
from strataline import plans
from strataline.functions.text import cited_repository, parse_citation
from strataline.operators import assembly as A

CALL = "lang string, resolution string, kind string, caller_symbol string, caller_citation string, callee_symbol string, callee_citation string, callsite_citation string"


def test_places_are_given_once(spark):
    rows = [("go", "observed", "static", "f", "r@h:a.go:1", "g", "r@h:b.go:2", f"r@h:a.go:{i % 3 + 5}") for i in range(90)]
    parts = A.calls(spark.createDataFrame(rows, CALL))
    assert parts.filter(F.size("nodes") > 0).count() == 5
    edges = A.assembled_edges([parts]).groupBy("type").count().collect()
    assert sorted(map(tuple, edges)) == [("call", 3), ("containment", 4)]


def test_edges_are_not_shuffled_to_find_their_ends(spark):
    plan = plans.QUERIES["assembled_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Exchange hashpartitioning\((?:src|dst)#", plan)


@pytest.mark.parametrize("sent", [-1, 1000])
def test_missing_ends_are_told_however_many(spark, monkeypatch, sent):
    monkeypatch.setattr(A, "MAX_SENT", sent)
    rows = [("go", "x", "k", "f", "r1@h:a.go:1", "g", "r2@h:b.go:2", "r1@h:a.go:5")]
    repos = spark.createDataFrame([("r1", "One", "h")], "repository string, name string, head string").withColumn("attrs", F.parse_json(F.lit("{}")))
    edges = A.assembled_edges([A.repositories(repos), A.calls(spark.createDataFrame(rows, CALL))]).collect()
    assert sorted((e["type"], e["status"]) for e in edges) == [("call", "inferred"), ("containment", "observed"), ("containment", "observed"), ("containment", "observed"), ("containment", "unresolved")]


def test_attrs_of_an_edge_are_as_a_variant_has_them(spark):
    odd = {"b": F.lit('a"\\\n\t\u00e9\u2028</x>'), "a": F.lit(None).cast("string"), "c": F.lit(True), "B": F.lit("")}
    row = spark.range(1).select(A._written(odd).alias("text"), F.to_json(A._open(odd)).alias("variant"), A._written(None).alias("none")).first()
    assert row["text"] == row["variant"] and row["none"] == "{}"


def test_a_repository_is_cited_alike(spark):
    cited = ["r@h:a.go:1:2", "r@:a", "a@b@c:d", "a@b:c@d", "a@b:c@d:e", "bad", "", "@:", "r@h", "r@h:", "a\n@h:p", "r@h:p\n", "r@h:p\nq", "r@h\nx:p", "r@h:\u2028", None, ":@:", "a@@:x"]
    df = spark.createDataFrame([(c,) for c in cited], "c string").select("c", cited_repository(F.col("c")).alias("short"), parse_citation(F.col("c"))["repo"].alias("full"))
    assert [r for r in df.collect() if r["short"] != r["full"]] == []
