"""Findings are read once, whatever is checked of them."""

from strataline import plans


def test_findings_are_read_once(spark):
    plan = plans.QUERIES["findings_problems"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(f"sf0.001/{table}.parquet") for table in ("orders", "lineitem", "supplier")] == [1, 1, 1]
