"""Runs against a search of every period, whole queries against the contract in plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from strataline.llm import periodic_runs as op
from strataline.llm.text_arrays import chunks

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w, min_length=24, min_exponent=3):
    best = {}
    ids = np.unique(np.array(w or [""], object), return_inverse=True)[1]
    for q in range(1, len(w) // min_exponent + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids[q:] == ids[:-q], [False]))))
        for i, j in edges.reshape(-1, 2):
            if j + q - i >= max(min_length, min_exponent * q):
                best.setdefault((int(i), int(j + q - i)), q)  # periods grow
    return sorted((s, q, n) for (s, n), q in best.items())


def expected(w):
    runs = all_runs(w)
    text = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
    best = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    return (len(runs), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (text, " ".join(x for i, x in enumerate(w) if i not in gone))))


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def made(r):
    w = []
    for _ in range(r.randrange(6)):
        kind = r.randrange(3)
        if kind == 0:
            w += r.choices("ab", k=r.randrange(60))
        elif kind == 1:
            w += r.choices(["x", "Y", f"é{r.randrange(9)}"], k=r.randrange(1, 15)) * r.randrange(1, 12)
        else:
            w += [f"u{r.randrange(1000)}" for _ in range(r.randrange(30))]
    return w


@pytest.mark.parametrize("limits", [(24, 3), (9, 3), (3, 3), (12, 4), (31, 5)])
def test_runs_of_random_words(limits):
    r = random.Random(sum(limits))
    texts = [" ".join(made(r)) for _ in range(400)]
    for t in chunks(pa.array(texts), 2000):
        start, length, period = op.find_runs(t, *limits)
        for i in range(t.n):
            low, high = t.word_offsets[i : i + 2]
            got = [(s - low, q, n) for s, n, q in zip(start, length, period, strict=True) if low <= s < high]
            assert got == all_runs(texts[t.first + i].split(), *limits)


def test_least_overlap():
    for m in range(3, 80):
        for e in range(3, m + 1):
            assert op.least_overlap(m, e) == min(max(m, e * q) - q for q in range(1, m + 1))
    with pytest.raises(ValueError):
        op.periodic_runs(None, min_exponent=2)


def test_nulls_ties_and_extra_columns(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t", "a", "a " * 23, "a " * 24, "\x0b".join("abc" * 8), "A a " * 12, *("\r\n".join(made(r)) for _ in range(60)), "x " * 24 + "m " + "y " * 24, "long " * 60_000, "w" * 300_000]
    rows = [(i, t, "s", 7) for i, t in enumerate(texts)] + [(None, "a " * 30, "s", 7), (5, "a " * 24, "s", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start long")
    got = sorted(map(tuple, op.run_digests(op.periodic_runs(df)).collect()), key=repr)
    assert got == sorted(((i, *expected(WORD.findall(t or ""))) for i, t, *_ in rows), key=repr)
    assert op.run_digests(op.periodic_runs(df.limit(0))).count() == 0


def test_query_follows_the_contract(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = sorted(map(tuple, op.op11_periodic_runs(spark, SF).collect()))
    assert got == sorted((r["doc_id"], *expected(planted(r["doc_id"], r["text"]))) for r in rows)
    assert sum(x[1] > 0 for x in got) > 5


def test_planting_handles_nulls(spark):
    rows = [(None, "a b c"), (26, None), (26, " "), *((i, " ".join(f"w{j}" for j in range(50))) for i in range(300))]
    got = op.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [WORD.findall(r["text"] or "") for r in got] == [planted(*r) for r in rows]
