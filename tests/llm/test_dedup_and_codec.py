"""Deduplication, the codec and the pipeline against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from strataline.llm import exact_dedup, minhash_dedup, packing, quality_rules, sentencepiece_codec

from tests.llm.test_text_operators import LOWER, WORD, longest, made, table
from tests.oracle import rows, sql_rows

SF = "/root/testdata/sf0.001"


def test_exact_dedup(spark):
    texts = [None, "", "  ", " \n\t", "a  b", "a\nb", *made(7, 30), *made(7, 30), "x" * 5000, "x" * 5000, "x" * 5001, "y " * 3000]
    ids = [*range(len(texts) - 1), 3]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for size in (3, 2048):
        got = exact_dedup.exact_dedup(table(spark, texts, ids), block_chars=size).collect()
        want = [(ids[i], min(ids[j] for j, y in enumerate(norm) if y == x), norm.count(x), hashlib.sha256(x.encode()).hexdigest()) for i, x in enumerate(norm)]
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(want)
    left = exact_dedup.distinct_documents(table(spark, texts, ids))
    assert left.count() == len(set(norm)) and left.columns[1:] == ["text", "spans", "kept", "email"]
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    long = "é😀 x" * 100_000
    assert [r["group_size"] for r in exact_dedup.exact_dedup(table(spark, [long, long, long + "y"])).orderBy("doc_id").collect()] == [2, 2, 1]
    with_null = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (4, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["kept"]) for r in with_null) == [("4", "4", True), ("None", "4", False), ("None", "None", False)]


def near(text, r, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"z{r.randrange(1000)}"
    return " ".join(w)


def brute(texts, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))
    for _ in range(len(texts)):
        moved = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= percent * len(a | b) and parent[i] != parent[j]:
                    parent[i] = parent[j] = min(parent[i], parent[j])
                    moved = True
        if not moved:
            break
    return {i: (len(s), parent[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("limits", [{}, {"node_rows": 4, "component_rows": 6}])
def test_near_duplicates(spark, limits):
    r = random.Random(8)
    texts = [None, "", " ", "one two", "ONE two", "one two three"]
    for _ in range(12):
        origin = " ".join(f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 200)))
        texts += [near(origin, r, r.randrange(4)) for _ in range(r.randrange(1, 9))] + [origin] * r.randrange(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(table(spark, texts), **limits).collect()}
    want = brute(texts, 85)
    assert got == want


@pytest.mark.parametrize("shingles", [1, 3000])
def test_near_duplicates_whatever_a_task_may_hold(spark, monkeypatch, shingles):
    monkeypatch.setattr(minhash_dedup, "TASK_SHINGLES", shingles)
    r = random.Random(31)
    texts = []
    for n in (40, 700, 700):
        texts.append(" ".join(f"w{r.randrange(9000)}" for _ in range(n)))
        texts += [near(r.choice(texts[-3:]), r, n // 60) for _ in range(12)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(table(spark, texts), node_rows=4).collect()}
    assert got == brute(texts, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_large_groups_of_near_duplicates_are_whole(spark, percent):
    r = random.Random(percent)
    texts = []
    for edits in (1, 2, 3):  # chains: each text links with few others, near the threshold
        texts.append(" ".join(f"w{r.randrange(5000)}" for _ in range(100)))
        for _ in range(50):
            texts.append(near(texts[-1], r, edits))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(table(spark, texts), percent=percent, node_rows=2, component_rows=4).collect()}
    assert got == brute(texts, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_trees_follow_from_the_threshold(percent):
    second, trees = minhash_dedup._trees(percent)
    assert second == 100 / percent - 1
    r = np.random.default_rng(percent)
    n, missed = 4000, 0
    values = r.integers(0, 256, (2 * n, 64)).astype(np.uint64)
    values[n:] = np.where(r.random((n, 64)) < percent / 100, values[:n], values[n:] + np.uint64(256))
    shared = np.zeros(n, bool)
    for tree in range(trees):
        rows_, paths = np.arange(2 * n), np.full(2 * n, tree + 1000, np.uint64)
        for _ in range(minhash_dedup.LEVELS):
            rows_, paths = minhash_dedup._branch(rows_, paths, values, second)
        nodes = [set() for _ in range(2 * n)]
        for i, path in zip(rows_.tolist(), paths.tolist()):
            nodes[i].add(path)
        shared |= [bool(nodes[i] & nodes[n + i]) for i in range(n)]
    assert (~shared).sum() == 0


def test_texts_apart_meet_all_others_of_their_group(spark):
    r = random.Random(5)
    members = [(g, g * 1000 + i, r.choice([g, g, g + 50, g * 1000 + i]), r.randrange(50, 120)) for g in range(3) for i in range(60)] + [(9, 9000 + i, 9, 70) for i in range(40)]
    pairs = minhash_dedup._across(spark.createDataFrame(members, "group long, cid long, label long, n_shingles long"), 85, 7).collect()
    keys = {}
    for x in pairs:
        keys.setdefault(x["cid"], set()).add(x["key"])
    for g, a, label, n in members:
        for h, b, other, m in members:
            if g == h and label != other and 100 * min(n, m) >= 85 * max(n, m):
                assert keys[a] & keys[b]
    assert not any(i >= 9000 for i in keys)


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(table(spark, [])).count() == 0
    assert all(r["kept"] for r in minhash_dedup.near_duplicates(table(spark, [None, ""])).collect())


@pytest.mark.parametrize("name", ["op5_near_duplicates", "op8_exact_dedup"])
def test_query_agrees_with_sql(spark, name):
    from strataline.llm import queries

    assert rows(queries.queries()[name](spark, SF).toPandas()) == sql_rows(SF, queries.oracle_sql()[name])


def test_codec_equals_sentencepiece(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.piece_bpe_path())
    r = random.Random(9)
    texts = [None, "", "Hi  there\n you ", "   ", "日本語 😀", "\x00 z\x00", "x" * 300, *["".join(r.choices("aetionrs  \nthé.,0😀", k=r.randrange(40))) for _ in range(500)], *made(9, 30)]
    for x in sentencepiece_codec.encode_table(table(spark, texts), with_ids=True).collect():
        assert x["ids"] == model.encode(texts[x["doc_id"]] or "") and x["decoded_same"]
    assert sentencepiece_codec.encode_table(table(spark, [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as c
    from strataline.llm import pii
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality rules", "exact dedup", "MinHash near-dedup", "PII", "packing"]
    pieces = c.run(spark, SF).collect()
    # quality: its rules written down plainly
    rows_ = docs.toPandas().sort_values("doc_id")
    good = []
    for t in rows_.text:
        w = WORD.findall(t or "")
        at = collections.defaultdict(list)
        for j in range(len(w) - 2):
            at[tuple(w[j : j + 3])].append(j)
        repeated = {j + k for v in at.values() if len(v) > 1 for j in v for k in range(3)}
        fine = len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)
        if fine and len(w) <= 600:
            reach = longest(w)
            fine = len({j + k for j, n in enumerate(reach) if n >= 8 for k in range(n)}) <= 0.4 * len(w) and max(reach) <= max(50, 0.2 * len(w))
        elif fine:  # too long for the plain search
            fine = bool(quality_rules.verdicts(pa.array([t]))["kept"][0])
        good.append(fine)
    kept = c.quality(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == rows_.doc_id[good].tolist()
    first = rows_[good].assign(n=rows_[good].text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t))).drop_duplicates("n")
    component = brute(first.text.tolist(), 80)
    left = {int(d): t for i, (d, t) in enumerate(zip(first.doc_id, first.text)) if component[i][1] == i}
    assert {r["doc_id"] for r in pieces} == set(left)
    # personal data: the spans of the operator, replaced plainly; packing: ids of the tokenizer
    found = pii.pii(spark.createDataFrame(list(left.items()), "doc_id long, text string")).collect()
    changed = 0
    for r in found:
        text, out, at = left[r["doc_id"]], [], 0
        for kind, x, y in (s.split(":") for s in r["spans"].split(",") if s):
            if int(x) >= at:
                out += [text[at : int(x)], f"[{kind.upper()}]"]
            at = max(at, int(y))
        left[r["doc_id"]] = "".join([*out, text[at:]])
        changed += bool(out)
    assert changed
    tokenizer = Tokenizer.from_file(packing.byte_bpe_path())
    own = collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: p["start"]):
        own[p["doc_id"]].append(p)
    for doc_id, text in left.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert sum(p["length"] for p in own[doc_id]) == len(ids) == own[doc_id][0]["doc_tokens"]
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own[doc_id])


def test_pipeline_stages_meet_nulls_copies_and_extra_columns(spark):
    import corpus_pipeline as c

    r = random.Random(3)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(200))
    rows_ = [(1, None, None, 0), (2, "", "x", 0), (3, long, None, 1), (3, long, None, 1), (4, long + " a@b.cc", "x", 2), (None, long + " zz", "x", 3), (5, "z " * 100_000, "x", 4)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, kept string, n_chars long")
    for rows_in in (docs, docs.limit(0)):
        now = rows_in
        for name, stage in c.STAGES:
            now = stage(spark, now, SF)
            if name != "packing":
                assert now.columns == docs.columns
        ids = {x["doc_id"] for x in now.collect()}
        assert ids == (set() if rows_in is not docs else {3, None})  # a text without any id is compared with nothing
