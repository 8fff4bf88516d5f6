"""Near words against patterns of every edit, whole queries against the contract in plain Python."""

import collections
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from strataline.llm import spelling_variants as op

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def neighbours(words):
    """Words that share a pattern with one place left open, or that one deletion leads to."""
    near, open_at = collections.defaultdict(set), collections.defaultdict(list)
    for w in words:
        for i in range(len(w)):
            open_at[w[:i], w[i + 1 :], len(w)].append(w)
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for same in open_at.values():
        for w in same:
            near[w] |= set(same) - {w}
    return near


def expected(n, ratio=10):
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def made(seed, size):
    r, words = random.Random(seed), set()
    stems = ["".join(r.choices("abé", k=r.randrange(1, 12))) for _ in range(40)] + ["interna" + "".join(r.choices("xyzÿ😀", k=r.randrange(9))) for _ in range(40)] + ["q" * 70 + "r" * 30, "z" * 200]
    while len(words) < size:
        w = r.choice(stems)
        for _ in range(r.randrange(4)):
            i = r.randrange(len(w) + 1)
            w = w[:i] + r.choice(["", "a", "b", "é", "x", "ÿ"]) + w[i + r.randrange(2) :]
        words.add(w)
    return {w: r.choice([1, 2, 3, 25, 40, 600, 9000]) for w in words if w}


@pytest.mark.parametrize(("min_chars", "block_rows"), [(1, 4096), (1, 30), (7, 4096), (7, 12)])
def test_variants_of_random_words(spark, min_chars, block_rows):
    n = made(min_chars, 1500)
    df = spark.createDataFrame([(w, k, "x") for w, k in n.items()], "word string, n long, near string")
    got = sorted(map(tuple, op.spelling_variants(df, min_chars=min_chars, block_rows=block_rows).collect()))
    assert got == expected({w: k for w, k in n.items() if len(w) >= min_chars})


def test_blocks_without_division(spark, monkeypatch):
    n = made(3, 600)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    for few in (1, 10_000):
        monkeypatch.setattr(op, "FEW", few)
        assert sorted(map(tuple, op.spelling_variants(df, min_chars=1).collect())) == expected(n)


def test_nulls_repeated_rows_and_chains(spark):
    rows = [("abcdefg", 1), ("abcdefgh", 10), ("abcdefghi", 60), ("abcdefghi", 40), ("abcdefghij", 1000), (None, 5), ("", 7), ("xbcdefg", None), ("short", 9), ("zzzzzzz", 1), ("yzzzzzz", 50), ("zzzzzzy", 50)]
    got = {r["word"]: tuple(r)[1:] for r in op.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij", 1, 1, 10)
    assert got["abcdefghi"] == ("abcdefghij", "abcdefghij", 100, 2, 1000)
    assert got["zzzzzzz"] == ("yzzzzzz", "yzzzzzz", 1, 2, 50)
    assert set(got) == {"abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "zzzzzzz", "yzzzzzz", "zzzzzzy"}
    assert op.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_runs_of_letters(spark):
    texts = [None, "", "Hello-Worlds ÀÉÏabcde_straße×÷ abcdefg9abcdefg Āabcdefg", "A" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS run")
    got = collections.Counter((r["doc_id"], r["run"]) for r in op.letter_runs(df).collect())
    assert got == collections.Counter((i, m.translate(LOWER)) for i, t in enumerate(texts) for m in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(m) >= 7)


def test_query_follows_the_contract(spark):
    counts = collections.Counter()
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        for w in re.findall("[A-Za-zÀ-ÿ]+", (r["text"] or "").translate(LOWER)):
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    got = sorted(map(tuple, op.op13_spelling_variants(spark, SF).collect()))
    assert got == expected({w: n for w, n in counts.items() if n >= 2 and len(w) >= 7})
    assert sum(x[1] is not None for x in got) > 5
