"""The machine's rules one by one; a stream in any cutting, with restarts, against the fold of the whole log."""

import random

import pytest
from strataline.streaming import task_machine as M

SCHEMA = "task long, seq long, event string, digest string, attempt long, ok boolean"


def log(seed, n, tasks=7):
    r = random.Random(seed)
    return [(r.randrange(tasks), i, r.choice(["created", "claimed", "claimed", "submitted", "submitted", "released", "cascaded", "noise"]) if r.random() < 0.97 else "created", r.choice("ab"), r.choice([None, None, 1, 2]), r.random() < 0.3) for i in range(n)]


def expected(rows, most=3):
    """Written down plainly, a dictionary for each task."""
    tasks, out = {}, []
    for task, seq, event, digest, attempt, ok in sorted(rows, key=lambda x: x[1]):
        t = tasks.setdefault(task, {"generation": 0, "attempts": 0})
        why = None
        final = t.get("done") or t.get("dead")
        if event == "created":
            if t["generation"] and t["digest"] == digest:
                why = "="
            else:
                tasks[task] = t = {"generation": t["generation"] + 1, "digest": digest, "attempts": 0, "failed": 0}
        elif event == "noise":
            why = "unknown event"
        elif not t["generation"]:
            why = "unknown task"
        elif final:
            why = "done" if t.get("done") else "failed for good"
        elif event == "cascaded":
            t["dead"], t["open"] = True, False
        elif event == "claimed":
            if t.get("open"):
                why = "already claimed"
            else:
                t["open"], t["attempts"] = True, t["attempts"] + 1
        elif not t.get("open"):
            why = "no open claim"
        elif attempt not in (None, t["attempts"]):
            why = "another attempt"
        else:
            t["open"] = False
            if event == "submitted" and ok:
                t["done"] = True
            elif event == "submitted":
                t["failed"] += 1
                t["dead"] = t["failed"] >= most
        state = "unknown" if not t["generation"] else "validated" if t.get("done") else "failed" if t.get("dead") else "claimed" if t.get("open") else "pending"
        out.append((task, seq, event, "unchanged" if why == "=" else "rejected" if why else "accepted", None if why == "=" else why, t["generation"], t["attempts"], state))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 3])
def test_a_whole_log(spark, most):
    rows = log(most, 3000)
    got = sorted(map(tuple, M.transitions(spark.createDataFrame(rows, SCHEMA), most).collect()))
    assert got == expected(rows, most)
    assert {x[4] for x in got} >= {"unknown event", "done", "failed for good", "already claimed", "no open claim", "another attempt"}


def test_stale_and_missing(spark):
    rows = [(1, 5, "created", "a", None, None), (1, 5, "created", "b", None, None), (1, None, "claimed", None, None, None), (None, 1, "created", "a", None, None), (None, 2, "claimed", "a", None, None), (2, 1, None, None, None, None), (3, 1, "created", None, None, None), (3, 2, "created", None, None, None)]
    got = sorted(((r["task"], r["seq"], r["outcome"], r["reason"], r["state"]) for r in M.transitions(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(1, 5, "accepted", None, "pending"), (1, 5, "rejected", "stale", "pending"), (1, None, "rejected", "stale", "pending"), (None, 1, "rejected", "no task", "unknown"), (None, 2, "rejected", "no task", "unknown"), (2, 1, "rejected", "unknown event", "unknown"), (3, 1, "accepted", None, "pending"), (3, 2, "unchanged", None, "pending")], key=repr)
    assert M.transitions(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("cuts", [[400], [7, 150, 151, 400]])
def test_a_stream_in_batches_with_restarts(spark, tmp_path, cuts):
    rows, begin = log(9, 400), 0
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for end in cuts:
        # each run ends, and the next goes on from the checkpoint; the last events are delivered again
        part = rows[begin:end] + (rows[max(0, begin - 3) : begin] if begin else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        M.run_available(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        begin = end
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    again = [x for x in got if x[4] == "stale"]
    assert sorted(x for x in got if x[4] != "stale") == expected(rows) and len(again) == 3 * (len(cuts) - 1)
    states = sorted(map(tuple, M.task_states(spark.createDataFrame([x for x in got if x[4] != "stale"], M.RESULT)).collect()))
    assert states == sorted(map(tuple, M.task_states(M.transitions(spark.createDataFrame(rows, SCHEMA))).collect()))
