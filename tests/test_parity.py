"""Runs compared fact by fact: one change is one entry, noise is none, and matching is one to one."""

import copy
import json
import random

import pytest
from strataline.operators import parity as P

KEYS = [P.Keyed("/nodes", ("kind", "label")), P.Keyed("/nodes[]/evidence", (P.VALUE,)), P.Keyed("/repos", ("ref",), "coverage/.*")]
NOISE = [P.Noise("/scan_date"), P.Noise(r"/nodes\[\]/path", "scrub")]


def model():
    nodes = [{"kind": k, "label": f"n{i}", "status": "observed", "path": f"/home/a/src/{i}", "evidence": ["e1", "e2"], "attrs": {"x/y": i, "deep": {"list": [1, {"z": None}]}}} for i in range(4) for k in ("file", "route")]
    return {"model.json": {"scan_date": "2024", "project": "p", "nodes": nodes, "stats": {"n": 8, "none": [], "empty": {}}}, "coverage/repos.json": {"repos": [{"ref": "r1", "lanes": 3}, {"ref": "r2", "lanes": 4}]}}


@pytest.fixture
def compared(spark, tmp_path):
    def save(run, docs):
        for name, doc in docs.items():
            (tmp_path / run / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / run / name).write_text(json.dumps(doc, indent=1))
        return P.read_run(spark, str(tmp_path / run))

    def compare(base, candidate, run="candidate"):
        a, b = save(f"base-{run}", base), save(run, candidate)
        flat = [P.flattened(x, KEYS, NOISE, {"/home/a": "$HOME", "/root/b": "$HOME"}) for x in (a, b)]
        entries = P.fact_diff(*flat)
        rows = sorted((r["artifact"], r["fact"], r["change"], tuple(r["fields"])) for r in entries.collect())
        return rows, P.verdict(entries, P.presence(a, b)).first().asDict()

    return compare


def test_noise_order_and_roots_are_no_difference(compared):
    other = copy.deepcopy(model())
    other["model.json"]["scan_date"] = "2025"
    random.Random(1).shuffle(other["model.json"]["nodes"])
    for n in other["model.json"]["nodes"]:
        n["path"], n["evidence"] = n["path"].replace("/home/a", "/root/b"), n["evidence"][::-1]
    rows, verdict = compared(model(), other)
    assert rows == [] and verdict["same"] and verdict["missing"] == 0


node = lambda docs, i: docs["model.json"]["nodes"][i]
FACT = "/nodes[kind=file,label=n1]"


@pytest.mark.parametrize(
    ("change", "entry"),
    [
        (lambda d: node(d, 2).update(status="inferred"), (FACT, "reclassified", ("/status",))),
        (lambda d: node(d, 2)["attrs"].update({"x/y": 77}), (FACT, "changed", ("/attrs/x~1y",))),
        (lambda d: (node(d, 2)["attrs"].update({"x/y": 77}), node(d, 2).update(status="inferred")), (FACT, "changed", ("/attrs/x~1y", "/status"))),
        (lambda d: node(d, 2)["attrs"]["deep"]["list"][1].update(z=0), (FACT, "changed", ("/attrs/deep/list[1]/z",))),
        (lambda d: node(d, 2)["evidence"].append("e3"), (FACT, "changed", ('/evidence["e3"]',))),
        (lambda d: node(d, 2).pop("path"), (FACT, "changed", ("/path",))),
        (lambda d: d["model.json"]["nodes"].pop(2), (FACT, "removed", None)),
        (lambda d: d["model.json"]["nodes"].append({"kind": "file", "label": "new"}), ("/nodes[kind=file,label=new]", "added", None)),
        (lambda d: d["model.json"]["nodes"].append(copy.deepcopy(node(d, 2))), (FACT, "changed", None)),
        (lambda d: d["model.json"]["stats"].update(n=9), ("/stats/n", "changed", ("",))),
        (lambda d: d["model.json"]["stats"].update(none=None), ("/stats/none", "changed", ("",))),
        (lambda d: d["model.json"].update(project=None), ("/project", "changed", ("",))),
    ],
)
def test_one_change_is_one_entry(compared, change, entry):
    other = copy.deepcopy(model())
    change(other)
    rows, verdict = compared(model(), other)
    assert len(rows) == 1 and rows[0][:3] == ("model.json", *entry[:2]) and entry[2] in (None, rows[0][3])
    assert not verdict["same"] and verdict[entry[1]] == 1 and sum(verdict[c] for c in ("added", "removed", "changed", "reclassified")) == 1


def test_a_missing_document(compared):
    other = model()
    del other["coverage/repos.json"]
    rows, verdict = compared(model(), other)
    assert [r[:3] for r in rows] == [("coverage/repos.json", "/repos[ref=r1]", "removed"), ("coverage/repos.json", "/repos[ref=r2]", "removed")]
    assert (verdict["missing"], verdict["removed"], verdict["same"]) == (1, 2, False)


def test_findings_are_matched_by_evidence(spark):
    schema = "finding string, lens string, priority string, confidence string, modules array<string>, evidence array<struct<repository: string, file: string, first: int, last: int>>"
    base = [("b1", "dup", "P1", "high", ["m1", "m2"], [("r", "a.go", 1, 20), ("r", "b.go", 5, 5)]), ("b2", "dup", "P2", "low", None, [("r", "a.go", 15, 30)]), ("b3", "risk", "P1", "high", [], [("r", "a.go", 1, 99)]), ("b4", "dup", "P1", "high", [], [])]
    candidate = [("c1", "dup", "P1", "low", ["m2", "m1", "m1"], [("r", "a.go", 18, 19), ("r", "b.go", 1, 400)]), ("c2", "dup", "P2", "low", [], [("r", "a.go", 30, 31)]), ("c3", "dup", "P2", "low", [], [("q", "a.go", 1, 99)])]
    got = {(r["base_finding"], r["candidate_finding"], r["overlap"], tuple(r["deltas"])) for r in P.matched_findings(spark.createDataFrame(base, schema), spark.createDataFrame(candidate, schema)).collect()}
    assert got == {("b1", "c1", 2, ("confidence",)), ("b2", "c2", 1, ()), ("b3", None, 0, ()), ("b4", None, 0, ()), (None, "c3", 0, ())}
    none = spark.createDataFrame([], "module_id string")
    parts = P.substance_verdict(P.matched_findings(spark.createDataFrame(base, schema), spark.createDataFrame(candidate, schema)), none, none, none, none).collect()
    assert [(r["section"], r["differences"], r["same"]) for r in parts][:2] == [("findings", 4, False), ("module map", 0, True)]
