"""A filter that stays in its shards is asked once a piece and group, and gives what a broadcast one gives."""

import numpy as np
import pyarrow as pa
import pytest
from strataline.llm import lm_scoring as L
from strataline.llm.text_arrays import mix


@pytest.fixture
def piece():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, n)) for n in (0, 1, 4000)]
    rows = list(L._piece(7, pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])))
    return pa.RecordBatch.from_arrays([rows[1].column(n) for n in ("row_key", "words", "rows", "times")], ["row_key", "words", "rows", "times"])


def test_a_piece_asks_a_group_once(piece):
    shards, groups = 1200, 4
    asked = pa.Table.from_batches(list(L._asking(shards, groups)(iter([piece])))).to_pylist()
    assert [r["shard"] for r in asked] == [0, 1, 2, 3] and {r["row_key"] for r in asked} == {7}
    once, at, before, _ = L._unpacked(*(piece.column(i)[0].as_py() for i in (1, 2, 3)))
    assert sorted(h for r in asked for h in np.frombuffer(r["words"], np.uint64)) == sorted(once)
    pairs = np.unique(L._pairs(once[before], once[at]))
    said = [(s * groups + r["shard"], h) for r in asked for s, h in zip(np.frombuffer(r["more"], np.uint16).tolist(), np.frombuffer(r["bits"], np.uint32).tolist(), strict=True)]
    assert sorted(said) == sorted(zip((pairs % np.uint64(shards)).tolist(), (pairs >> np.uint64(32)).tolist(), strict=True))


def test_planes():
    x = mix(np.arange(9, dtype=np.uint64))
    assert (L._from_planes(L._planes(x), np.uint64) == x).all() and len(L._from_planes(L._planes(x[:0]), np.uint64)) == 0


@pytest.mark.parametrize("at_once", [1, 1_000_000])
def test_shards_give_the_same_scores(spark, monkeypatch, at_once):
    monkeypatch.setattr(L, "PAIRS_AT_ONCE", at_once)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "a b"), (5, None), (5, "")], "doc_id long, text string"))
    both = [sorted(((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], r["base_score"], r["score"]) for r in L.lm_scores(docs, **limit).collect())) for limit in ({}, {"max_filter_bytes": 0})]
    assert [r[:5] for r in both[0]] == [r[:5] for r in both[1]]
    assert np.allclose([r[5:] for r in both[0]], [r[5:] for r in both[1]], rtol=1e-9)
