"""Pieces of a JSON stream stay in the task that reads them: only sums and what crosses splits is shuffled."""

import json
import re

from strataline.sources import readers


def test_pieces_are_not_shuffled(spark, tmp_path):
    rows = [{"n": i, "s": 'a}"{\\' * (i % 5), "in": {"x": [{}] * (i % 3)}} for i in range(300)]
    (tmp_path / "a.json").write_text(" ".join(map(json.dumps, rows)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = readers.json_stream(spark, str(tmp_path / "a.json"), "n long, s string")
        assert [(r["n"], r["s"]) for r in found.collect()] == [(r["n"], r["s"]) for r in rows]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(file#\w+, block#", plan)
