import random

from pyspark.sql import functions as F
from strataline.functions import sources as S
from strataline.functions import text as T
from strataline.operators import compare, graph, history, ranking, routes
from strataline.operators import extraction as X
from strataline.sources import readers
from strataline.streaming import ledger_stream


def test_rename_cycle_ends_where_it_repeats(spark):
    log = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("x", "y", 3), ("y", "z", 4), ("q", "p", 5), ("p", "a", 6)], "o string, n string, s int")
    assert {tuple(r) for r in history.rename_closure(log, "o", "n", "s").collect()} == {("x", "z"), ("y", "z"), ("p", "a"), ("q", "a")}
    assert history.rename_closure(log.limit(0), "o", "n", "s").count() == 0


def test_long_rename_chains_end_at_their_last_name(spark):
    log = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i) for i in range(68)], "o string, n string, s int").coalesce(1)
    assert {tuple(r) for r in history.rename_closure(log, "o", "n", "s").collect()} == {(f"n{i}", "n68") for i in range(68)}


def test_bulk_transactions_make_no_pairs(spark):
    log = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (4, None)], "t int, i string")
    assert [tuple(r) for r in history.coupling(log, "t", "i", min_shared=1, bulk_limit=2).collect()] == [("a", "b", 2, 3, 3)]
    assert tuple(history.bulk_disclosure(log, "t", "i", 2).first()) == (3, 1)


def test_components_and_cascade_equal_brute_force(spark):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(30)]
    least = {x: x for e in edges for x in e}
    for _ in range(50):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(edges, "a int, b int")
    assert {tuple(x) for x in graph.connected_components(df, "a", "b").collect()} == set(least.items())
    found = {edges[0][0]}
    for _ in range(50):
        found |= {b for a, b in edges if a in found}
    assert {x[0] for x in graph.cascade(df, spark.createDataFrame([(edges[0][0],)], "k int"), "a", "b", "k").collect()} == found


def test_greedy_match_equals_sequential(spark):
    r = random.Random(5)
    scored = [(f"b{i}", f"c{j}", r.randrange(1, 5)) for i in range(6) for j in range(6) if r.random() < 0.6]
    want, left, right = set(), set(), set()
    for b, c, s in sorted(scored, key=lambda x: (-x[2], x[0], x[1])):
        if b not in left and c not in right:
            want.add((b, c, s))
            left.add(b)
            right.add(c)
    df = spark.createDataFrame(scored, "b string, c string, s int")
    assert {tuple(x) for x in graph.greedy_match(df, "b", "c", "s").collect()} == want


def test_self_diff_is_empty(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3)], "k int, x string, y int")
    assert compare.keyed_diff(df, df, ["k"], ["x", "y"], ["y"]).isEmpty()
    changed = df.withColumn("y", F.lit(9))
    assert {r["change"] for r in compare.keyed_diff(df, changed, ["k"], ["x", "y"], ["y"]).collect()} == {"reclassified"}


def test_routes(spark):
    make = lambda *p: spark.createDataFrame([p], "a string, b string").select(T.segments(F.col("a")).alias("a"), T.segments(F.col("b")).alias("b"))
    assert make("/v3/shelves/:no/books", "${main}/v3/shelves/7/books#top").first() == (["shelves", "*", "books"], ["shelves", "7", "books"])
    for a, b, want in (("/shelves", "/shelves/7/books", True), ("/shelves/:no/books", "/shelves/7/books/2", True), ("/shelves/7/books", "/shelves/7", False), ("/loans", "/shelves", False), ("/:a/:b", "/one/two", False)):
        assert make(a, b).select(T.route_matches(F.col("a"), F.col("b"))).first()[0] is want
    r = spark.createDataFrame([("api", m, p, "route") for m, p in (("GET", "/books"), ("PUT", "/books"), ("GET", "/loans/:no"), ("GET", "/unused"), ("GET", "/:any"))], "repo string, method string, path string, kind string")
    c = spark.createDataFrame([("x", "/books", "GET", "e1"), ("x", "/loans/9", "GET", "e2")], "base string, call_path string, call_method string, call_evidence string")
    bases = routes.attribute_bases(r, c)
    assert [tuple(x) for x in bases.collect()] == [("x", "api")]
    found = {(x["method"], x["path"]): x["status"] for x in routes.classify(r, c, bases).collect()}
    assert found == {("GET", "/books"): "ui-called", ("PUT", "/books"): "method-unresolved", ("GET", "/loans/:no"): "ui-called", ("GET", "/unused"): "no-direct-path-match", ("GET", "/:any"): "match-ambiguous"}


def test_redaction(spark):
    cases = {
        "client_secret: 'it\\'s q9', next": "client_secret: '<REDACTED>', next", 'MY-API-KEY="z\ny"': 'MY-API-KEY="<REDACTED>"', "x.session_id=77)": "x.session_id=<REDACTED>)", "basic Zm9v== done": "basic <REDACTED> done",
        "ftp://ann@host/p": "ftp://<REDACTED>@host/p", "git://a:b:c@h": "git://<REDACTED>@h", "mytokens = 5": "mytokens = 5", "authorization=Basic Q1;": "authorization=Basic <REDACTED>;", "no@mail.org": "no@mail.org", 'pwd = "open': 'pwd = "open',
        'token = "' + "q" * 100_000 + '"': 'token = "<REDACTED>"', "secret='" + "\\'" * 50_000 + "'": "secret='<REDACTED>'", "://" + "u" * 100_000: "://" + "u" * 100_000,
    }
    got = [r[0] for r in spark.createDataFrame([(t,) for t in cases], "t string").select(T.redact(F.col("t"))).collect()]
    assert got == list(cases.values())


def test_matches_have_offsets_and_lines(spark):
    text = "ab\n" * 700 + "é😀ab"
    m = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(S.matches(F.col("t"), "ab").alias("m")).collect()
    assert [(x["at"], x["line"], x["found"]) for x in m[0]["m"]] == [(3 * i, i + 1, "ab") for i in range(700)] + [(2102, 701, "ab")]
    assert m[0]["m"][-1]["before"] == text[:-2][-120:] and m[1]["m"] == [] and not m[2]["m"]
    aliases = spark.createDataFrame([("const x = config.one; let y = `${config.two}/v`; var { three, four: x } = config;",)], "t string").select(X.config_aliases(F.col("t"))).first()[0]
    assert [tuple(a) for a in aliases] == [("x", "one"), ("y", "two"), ("three", "three"), ("x", "four")]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(0, 40, 2)], "a int, b int").orderBy(F.hash("a"))
    got = {r["id"]: r["component"] for r in graph.connected_components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(301), 0), **{1000 + i: 1000 + i - i % 2 for i in range(40)}}


def test_citations_and_budget(spark):
    df = spark.createDataFrame([("api@abc:src/a.go:12:3",), ("src/a.go:7",), ("src/a.go",)], "c string")
    assert [tuple(r[0]) for r in df.select(T.parse_citation(F.col("c"))).collect()] == [("api", "abc", "src/a.go", 12, 3), ("", "", "src/a.go", 7, None), ("", "", "src/a.go", None, None)]
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate((5, 9, 4, 1))], "g string, i int, n int")
    assert [r["taken"] for r in ranking.budgeted(rows, "g", "i", "n", 10).orderBy("i").collect()] == [True, False, True, True]


def test_readers(spark, tmp_path):
    (tmp_path / "log.txt").write_text("@@\tAnn\ta@x\n1\t2\tsrc/{old => new}/f.js\n-\t-\tb.png\n@@\tBob\tb@x\n3\t0\ta.go\n")
    got = [tuple(r)[1:] for r in readers.numstat(spark, str(tmp_path / "log.txt")).orderBy("commit_no", "path").collect()]
    assert got == [(1, "Ann", "a@x", 0, 0, "b.png"), (1, "Ann", "a@x", 1, 2, "src/new/f.js"), (2, "Bob", "b@x", 3, 0, "a.go")]
    (tmp_path / "s.json").write_text('{"ImportPath": "a"}{"ImportPath": "b"}\n{\n"ImportPath": "c"}')
    assert [r[0] for r in readers.json_stream(spark, str(tmp_path / "s.json"), "ImportPath string").collect()] == ["a", "b", "c"]
    (tmp_path / "t.json").write_text('{"ImportPath": "x}{y"} {"ImportPath": "a\\\\"}{"ImportPath": "q\\"}{"}')
    assert [r[0] for r in readers.json_stream(spark, str(tmp_path / "t.json"), "ImportPath string").collect()] == ["x}{y", "a\\", 'q"}{']
    (tmp_path / "clones.txt").write_text("Clone found (go):\n - a.go [10:1 - 20:2] (10 lines)\n   b.go [5:1 - 15:2]\n")
    assert [tuple(r) for r in readers.clone_pairs(spark, str(tmp_path / "clones.txt")).collect()] == [("go", "a.go", 10, 20, "b.go", 5, 15, 10)]
    (tmp_path / "cg.tsv").write_text("\t".join("abcdefghi") + "\nshort\trow\n")
    assert readers.callgraph(spark, str(tmp_path / "cg.tsv")).count() == 1
    df = spark.createDataFrame([(2,), (1,), (2,)], "x int")
    readers.write_sorted_lines(df, str(tmp_path / "out"))
    assert readers.json_lines(spark, str(tmp_path / "out"), "x int", strict=True).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 5, ("created", "claimed", "failed")[i % 3]) for i in range(40)]
    spark.createDataFrame(rows, "task int, event string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task int, event string").parquet(str(tmp_path / "in"))
    ledger_stream.start(stream, "task", "event", ["created", "failed"], "states", str(tmp_path / "cp")).awaitTermination(60)
    batch = ledger_stream.running_states(spark.read.parquet(str(tmp_path / "in")), "task", "event", ["created", "failed"])
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, batch.collect()))
