"""Small fixtures with known results for clusters, evidence and names."""

from pyspark.sql import functions as F
from strataline.functions import names
from strataline.operators import clusters, evidence


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_plan_merges_within_a_repository_and_links_across(spark):
    c = spark.createDataFrame([(i, "a" if i < 40 else "b", "r" if i < 20 else f"s{i}") for i in range(60)], "id int, repo string, root string")
    links = spark.createDataFrame([(20, 0), (50, 55), (3, 50)], "a int, b int")
    plan = clusters.partition_plan(c, links, "id", "repo", "root", "a", "b")
    rows = {r["id"]: (r["component"], r["chunk"]) for r in plan.collect()}
    assert len(rows) == 60 and rows[20] == (0, 1) and rows[15] == (0, 0) and rows[55] == (50, 0) and rows[21] == (21, 0)
    assert got(clusters.boundary_links(plan, links, "id", "repo", "a", "b")) == [(0, 0, 0, 1, False, 1), (0, 0, 50, 0, True, 1)]


def test_containment(spark):
    roots = spark.createDataFrame([("w/api", "api"), ("w/api/ui", "ui"), ("w/app", "app")], "root string, owner string")
    paths = spark.createDataFrame([("w/api/x.go",), ("w/api/ui/y.ts",), ("w/apiary/z",), ("w/app",)], "path string")
    assert got(clusters.containment(paths, roots, "path", "root", "owner")) == [("w/api/ui/y.ts", None, 2, "ambiguous"), ("w/api/x.go", "api", 1, "resolved"), ("w/apiary/z", None, 0, "unresolved"), ("w/app", "app", 1, "resolved")]
    assert got(clusters.nested_roots(roots, "root", "owner")) == [("api", "ui")]


def test_rules_that_overlap_give_none(spark):
    c = spark.createDataFrame([(1, "x", ["a/1"]), (2, "xy", ["b/1"]), (3, "z", []), (4, None, None)], "id int, value string, paths array<string>")
    rules = [("p", [{"value_prefixes": ["x"]}]), ("q", [{"evidence_path_prefixes": ["b/"]}])]
    found = evidence.expand_rules(c, rules, {"value_prefixes": "value", "evidence_path_prefixes": "paths"}, "id", "rest")
    assert got(found) == [(1, "p", 1), (2, None, 2), (3, "rest", 0), (4, "rest", 0)]


def test_shards_fail_closed(spark):
    units = spark.createDataFrame([("t", i, 10) for i in range(7)] + [("big", i, 10) for i in range(400)] + [("one", 0, 5)], "task string, seq int, tokens int")
    dealt = evidence.shards(units, "task", "seq", "tokens", fixed=10, budget=40)
    sizes = {(r["task"], r["shard"], r["shards"]): r["count"] for r in dealt.groupBy("task", "shard", "shards").count().collect()}
    assert sizes == {("t", 0, 3): 3, ("t", 1, 3): 2, ("t", 2, 3): 2, ("big", None, None): 400, ("one", 0, 1): 1}
    assert not evidence.overfull_shards(dealt.filter("task <> 'big'"), "task", "tokens", fixed=10, budget=40).count()


def test_lost_blocks(spark):
    of = lambda text: spark.createDataFrame([(1, text)], "id int, text string")
    before = of("One stays.  Two moves. Three goes!\n| a |  b |\n\n")
    assert got(evidence.lost_blocks(before, of("One stays."), of("x Two   moves. y"), "id", "text")) == [(1, "Three goes!"), (1, "| a | b |")]


def test_merged_findings_keep_order_and_drop_exact_copies(spark):
    f = spark.createDataFrame([("s", "e1", "m", 1), ("s", "e2", "m", 2), ("t", "e2", "m", 1), ("t", "e0", "m", 2)], "finding string, fact string, module string, seq int")
    merges = spark.createDataFrame([("t", "s")], "finding string, into string")
    assert [r["fact"] for r in evidence.merged_findings(f, merges, "finding", "into", "fact", "module", "seq").orderBy("position").collect()] == ["e1", "e2", "e0"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, v string, at int")
    assert not evidence.buckets(none, ["k"], [F.col("at")]).count() + evidence.merged_candidates(none, "k", "v", "at", [F.col("at")]).count() + evidence.short_references(none, "v").count()
    assert got(evidence.zero_filled(none, "v", ["a"])) == [("a", 0)]


def test_names(spark):
    one = lambda text, *cs: tuple(spark.createDataFrame([(text,)], "t string").select(*cs).first())
    t = F.col("t")
    for text in ("a/b:c.", "é?%20+x ", "", "\x01", "plain"):
        assert one(text, names.artifact_reference(names.artifact_key(t))) == (text,)
    assert one("a/b.", names.artifact_key(t)) == ("a%2Fb%2E",)
    for text in ("abc", "ééé", "a😀b😀", "日本語"):
        for most in range(14):
            want = text.encode()[:most].decode(errors="ignore")
            assert one(text, names.byte_prefix(t, most)) == (want,), (text, most)
    assert one("xx ab yab", names.occurrences(t, "ab")) == ([(3, "ab"), (7, "ab")],)
    assert one("1 <b>x</b> 2", names.between(t, "<b>", "</b>")) == ("<b>x</b>",) and one("<b><b></b>", names.between(t, "<b>", "</b>")) == ("",)
    assert one("a\nb\nc\n", names.head(t, 2)) == ("sample: 2 of 3 lines (bound=2)\na\nb\n",)
    assert one("/w/r/x /w", names.scrubbed(t, {"/w": "$W", "/w/r": "$R"})) == ("$R/x $W",)
    assert one("(*mod/p.T).M mod.F", names.short_symbol(t, F.lit("mod"))) == ("(*p.T).M F",)
    assert one("mod/a/b", names.import_folder(t, F.lit("mod")), names.import_folder(F.lit("mod"), F.lit("mod"))) == ("a/b", ".")
    assert one("@s/p/x", names.package_key(t, F.lit(False)), names.package_key(F.lit("g.com/o/r/x"), F.lit(True))) == ("@s/p", "g.com/o/r")
    assert one("r", names.citation(t, F.lit(""), F.lit("a.go"), F.lit(3), F.lit(None)), names.citation(t, F.lit("c"), F.lit("a.go"), F.lit(None).cast("int"), F.lit(2))) == ("r@nogit:a.go:3", "r@c:a.go")
    assert one("1,200 of 3", names.unsupported_numbers(t, F.array(F.lit("3")))) == (["1200"],)
    assert one("2024-01-02T03:04:05Z", names.iso_time(t).isNotNull(), names.iso_time(F.lit("no")).isNull(), names.percent(F.lit(1), F.lit(0)).isNull()) == (True, True, True)
