"""Coverage of any set of producers in any order; technologies by rules that are rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from strataline.operators import coverage as C
from strataline.operators import fingerprints as P

OBSERVED = "run string, partition string, repository string, state string, found long, unresolved long, capped boolean"


def worst(states):
    if not states:
        return "unavailable"
    if "failed" in states:
        return "failed"
    active = [s for s in states if s != "not-applicable"]
    if not active:
        return "not-applicable"
    if set(active) == {"unavailable"}:
        return "unavailable"
    return "partial" if {"partial", "unavailable"} & set(active) else "complete"


def test_worst_state_of_every_small_set(spark):
    sets = [c for n in range(4) for c in itertools.combinations_with_replacement(C.STATES, n)]
    df = spark.createDataFrame([(i, *[c.count(s) for s in C.STATES]) for i, c in enumerate(sets)], ["i", *(f"n{k}" for k in range(len(C.STATES)))])
    got = {r["i"]: r["w"] for r in df.select("i", C.worst_state({s: F.col(f"n{k}") for k, s in enumerate(C.STATES)}).alias("w")).collect()}
    assert got == {i: worst(c) for i, c in enumerate(sets)}


def statuses(spark, observed, eligible=(), repositories=2):
    runs = spark.createDataFrame([("r", repositories)], "run string, repositories long")
    random.Random(len(observed)).shuffle(observed)
    rows = C.coverage_partitions(runs, spark.createDataFrame(observed, OBSERVED), spark.createDataFrame(list(eligible), "run string, partition string, repository string")).collect()
    assert len(rows) == 10
    return {r["partition"]: (r["status"], r["reason"]) for r in rows}


def test_nothing_was_seen(spark):
    got = statuses(spark, [])
    assert got["files"] == ("complete", "") and got["modules"] == ("unavailable", "artifact-absent") and got["symbols_and_calls"] == ("not-applicable", "nothing-eligible")
    assert got["routes"] == ("not-applicable", "nothing-eligible") and got["external_boundaries"] == ("partial", "artifact-absent") and got["access_model"] == ("unavailable", "artifact-absent")


def test_absent_is_not_empty(spark):
    eligible = [("r", p, x) for p in ("symbols_and_calls", "dependency_imports") for x in ("a", "b")]
    row = lambda p, x, state="complete", found=0, unresolved=0, capped=False: ("r", p, x, state, found, unresolved, capped)
    absent, empty = statuses(spark, [], eligible), statuses(spark, [row("symbols_and_calls", "a"), row("symbols_and_calls", "b"), row("dependency_imports", "a"), row("routes", "a")], eligible)
    assert absent["symbols_and_calls"] == ("unavailable", "artifact-absent") and empty["symbols_and_calls"] == ("complete", "")
    assert absent["dependency_imports"] == ("partial", "artifact-absent") and empty["dependency_imports"] == ("partial", "repositories-missing")
    assert empty["routes"] == ("complete", "")
    rest = statuses(spark, [row("routes", "a", "unavailable", 3), row("access_model", "a"), row("access_model", "b", capped=True), row("external_boundaries", "a"), row("external_boundaries", "b"), row("deployable_units", "a", capped=True), row("tables", "a", "failed"), row("tables", "a"), row("modules", "a")])
    assert (rest["routes"], rest["access_model"], rest["external_boundaries"], rest["deployable_units"], rest["tables"], rest["modules"]) == (("partial", "producer-partial"), ("partial", "cap-hit"), ("complete", ""), ("partial", "cap-hit"), ("failed", "producer-failed"), ("complete", ""))


RULES = [("language.go", "language", "manifest-file", "go.mod"), ("language.go", "language", "source-extension", ".go"), ("language.ts", "language", "source-extension", ".ts"), ("language.js", "language", "manifest-default", "package.json"), ("ecosystem.node", "ecosystem", "manifest-file", "package.json"), ("framework.x", "framework", "package-dependency", "x"), ("ci", "trait", "config-file", ".ci/main.yml")]


@pytest.fixture
def found(spark):
    files = [("a", p) for p in ("package.json", "src/i.ts", "lib/j.ts", "yarn.lock", "package-lock.json", ".ci/main.yml", "node_modules/k.go")] + [("b", p) for p in ("sub/go.mod", "sub/x.GO", "deep/er/est/go.mod", "web/package.json", "web/i.css")] + [("c", "notes.txt"), ("c", None)]
    files = spark.createDataFrame(files, "repository string, path string")
    packages = spark.createDataFrame([("a", "package.json", "x"), ("b", "web/package.json", "y"), ("b", "web/package.json", None)], "repository string, path string, package string")
    none = spark.createDataFrame([], "repository string, path string, package string")
    return files, P.facts(files, packages, none), lambda rules: spark.createDataFrame(rules, "profile string, kind string, shape string, value string")


def test_facets(spark, found):
    files, facts, rules = found
    facets = P.with_unclassified(P.facets(facts, rules(RULES)), files)
    got = {(r["repository"], r["profile"]): (r["scopes"], r["evidence"], r["confidence"]) for r in facets.collect()}
    assert got == {
        ("a", "language.ts"): (["src"], ["lib/j.ts", "src/i.ts"], "medium"), ("a", "ecosystem.node"): (["."], ["package.json"], "high"), ("a", "framework.x"): (["."], ["package.json#dependency:x"], "high"), ("a", "ci"): (["."], [".ci/main.yml"], "high"),
        ("b", "language.go"): (["sub"], ["sub/go.mod", "sub/x.GO"], "high"), ("b", "language.js"): (["web"], ["web/package.json"], "medium"), ("b", "ecosystem.node"): (["web"], ["web/package.json"], "high"),
        ("c", "repository.unclassified"): (["."], ["notes.txt"], "low"),
    }
    # a rule more is a row more
    more = P.facets(facts, rules([*RULES, ("trait.css", "trait", "source-extension", ".css")])).filter("profile = 'trait.css'").collect()
    assert [(r["repository"], r["evidence"]) for r in more] == [("b", ["web/i.css"])]
    declared = spark.createDataFrame([("b", "web/package.json", "pnpm@9")], "repository string, path string, manager string")
    clash = P.conflicting_managers(facets, files, declared).filter("state = 'conflicting'").collect()
    assert [(r["repository"], r["profile"], r["confidence"], r["evidence"]) for r in clash] == [("a", "ecosystem.node", "medium", [".: conflicting package-manager evidence", "package.json"])]
