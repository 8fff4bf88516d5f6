"""Near-duplicate detection by a chosen-path set similarity join over 5-word shingles.

Texts with the same shingle set (two 64-bit sums over the whole set, and its size) form a class,
and only one member goes on. Of each class 64 minwise values are taken over the whole set. A tree
is descended by choosing, from the hash of the path so far, one coordinate (sometimes two) of
those values; texts go on together where their values there agree. The path is a function of the
text alone, so a tree's LEVELS levels are computed without a shuffle. A node has on average one child
for each threshold's inverse, and there are as many independent trees as a pair at the threshold needs
to share a node in one of them but for one time in a million (``_trees``: both follow from percent).
Nodes of at most ``node_rows`` texts are compared exhaustively on 64-byte sketches; larger ones first in
blocks, then all texts that are still apart with all others (``_across``), so depth costs no recall.

Nodes yield stars, not pairs. Their components hold every true link between their members; each
component's full shingle sets are then compared in one task, where a text needs no comparison
with texts that are already connected to it. Components of more than ``component_rows`` texts or ``TASK_SHINGLES`` shingles
are compared in parts: within nodes, then each text that is still apart with all others of the
component whose size allows a link, in pairs of blocks. That is exact; its work grows with the square
of a group only as far as its texts are not linked. Every reported link is confirmed on full sets.

Copies are never expanded into pairs: rows are proportional to texts times trees. A text of any length is hashed in
one pass; its set has 8 bytes a shingle. Nulls and texts
without words have an empty set, are linked with nothing and are kept. Rows with a null id take the
component of their class (a class without any id is compared with nothing); they are kept only if nothing has an id. Rows of one id with different
texts count as linked. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.graph import connected_components
from strataline.llm.storage import deleted, small_or_shuffled, written
from strataline.llm.text_arrays import chunks, mix, mix_int, release, shingles

COORDINATES, LEVELS = 64, 3
#: A pair at the threshold is missed by all trees at most so often; more trees than MOST_TREES are refused.
MISSED, MOST_TREES = 1e-6, 250
#: Full sets of about so many shingles (8 bytes each) are compared in one task.
TASK_SHINGLES = 4 << 20

_MULTIPLIERS = mix(np.arange(101, 101 + COORDINATES, dtype=np.uint64)) | np.uint64(1)


def _minwise(s: np.ndarray) -> np.ndarray:
    return ((s[:, None] * _MULTIPLIERS) >> np.uint64(32)).min(axis=0) if len(s) < 4096 else np.array([((s * m) >> np.uint64(32)).min() for m in _MULTIPLIERS])


def _trees(percent: int) -> tuple[float, int]:
    """The chance of a second coordinate at a node (1 / threshold coordinates on average) and the number of trees.

    Trees share the pair's values, so what they miss is averaged over how many of those agree.
    """
    t = percent / 100
    second = min(1.0, 1 / t - 1)
    agreeing = np.arange(COORDINATES + 1)
    chance = np.array([math.comb(COORDINATES, m) * t**m * (1 - t) ** (COORDINATES - m) for m in agreeing])
    reached = np.ones(COORDINATES + 1)
    for _ in range(LEVELS):
        lost = 1 - agreeing / COORDINATES * reached
        reached = 1 - (1 - second) * lost - second * lost**2
    for trees in range(1, MOST_TREES + 1):
        if (chance * (1 - reached) ** trees).sum() <= MISSED:
            return second, trees
    raise ValueError(f"{percent} percent needs more than {MOST_TREES} trees")


def _branch(rows: np.ndarray, paths: np.ndarray, values: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of (row, path) nodes as row, path, from values (rows by coordinates)."""
    first = mix(paths + np.uint64(1))
    second = mix(paths + np.uint64(2))
    # the second one is a coordinate other than the first
    other = (first + np.uint64(1) + second % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)
    more = (second >> np.uint64(40)).astype(float) < chance * 2**24
    coordinates = np.concatenate((first % np.uint64(COORDINATES), other[more]))
    rows, paths = np.concatenate((rows, rows[more])), np.concatenate((paths, paths[more]))
    return rows, mix(paths * np.uint64(0x9E3779B97F4A7C15) + mix(values[rows, coordinates.astype(np.int64)].astype(np.uint64) + (coordinates << np.uint64(40))))


def _sketches(percent: int):
    """doc_id, text to doc_id, n_shingles, fp1, fp2, sketch, nodes."""
    chance, trees = _trees(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few texts at once: their values and nodes take a kilobyte each
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            n = batch.num_rows
            sizes, prints, values = np.zeros(n, np.int64), np.zeros((2, n), np.uint64), np.zeros((n, COORDINATES), np.uint64)
            for t in chunks(batch.column(1)):
                words = t.words(fold=True)
                for i in range(t.n):
                    s = shingles(words[t.word_offsets[i] : t.word_offsets[i + 1]])
                    if len(s):
                        k = t.first + i
                        sizes[k], values[k] = len(s), _minwise(s)
                        prints[0, k], prints[1, k] = mix(s).sum(), mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum()
            nodes: list[np.ndarray] = []
            owners: list[np.ndarray] = []
            full = np.flatnonzero(sizes)
            for tree in range(trees):
                rows, paths = full, np.full(len(full), mix_int(tree + 1000), np.uint64)
                for _ in range(LEVELS):
                    rows, paths = _branch(rows, paths, values, chance)
                owners.append(rows)
                nodes.append(paths)
            owner, node = np.concatenate(owners), np.concatenate(nodes)
            by = np.argsort(owner, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
            sketch = (values & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(prints[0].view(np.int64)),
                    pa.array(prints[1].view(np.int64)),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(node[by].view(np.int64))),
                ],
                ["doc_id", "n_shingles", "fp1", "fp2", "sketch", "nodes"],
            )
            release()

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key after another (the first column, sorted); a group's rows are all there is in memory besides a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(0)[0] != batch.column(0)[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _stars(ids: np.ndarray, agree, labels: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Edges (member, least member) of the components, where agree(i, others) says which others link with i.

    Texts of one label are connected. Each text is compared once with all that aren't connected to it yet.
    """
    u: list[int] = []
    v: list[int] = []
    left = np.arange(len(ids))
    while len(left):
        near = left == left[0] if labels is None else labels[left] == labels[left[0]]
        queue, members, left = left[near].tolist(), left[near].tolist(), left[~near]
        while queue and len(left):
            near = agree(queue.pop(), left)
            if labels is not None and near.any():
                near = np.isin(labels[left], labels[left[near]])
            queue.extend(left[near])
            members.extend(left[near])
            left = left[~near]
        if len(members) > 1:
            own = ids[members]
            least = own.min()
            u.extend(own[own != least].tolist())
            v.extend([int(least)] * int((own != least).sum()))
    return u, v


def _labels(rows: pa.Table) -> np.ndarray | None:
    return rows.column("label").to_numpy() if "label" in rows.column_names else None


_EDGES = "u long, v long"


def _edge_batches(found: Iterator[tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
    u: list[int] = []
    v: list[int] = []
    for a, b in found:
        u.extend(a)
        v.extend(b)
        if len(u) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    release()


def _compare_sketches(percent: int):
    # how many sketch bytes must agree for a pair to be compared in full: five standard deviations below the threshold
    t = percent / 100
    least = int(COORDINATES * (t - 5 * (t * (1 - t) / COORDINATES) ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for rows in _groups(batches):
                x = _matrix(rows.column("sketch"))
                yield _stars(rows.column("cid").to_numpy(), lambda i, left, x=x: (x[left] == x[i]).sum(axis=1) >= least, _labels(rows))

        yield from _edge_batches(found())

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, label, keys, text to cid, label, keys, the text's shingle set."""
    for batch in batches:
        out: list[bytes] = []
        for t in chunks(batch.column(3)):
            words = t.words(fold=True)
            out.extend(shingles(words[t.word_offsets[i] : t.word_offsets[i + 1]]).tobytes() for i in range(t.n))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["cid", "label", "keys", "items"])
        del out
        release()


def _compare_sets(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for rows in _groups(batches):
                parts = rows.column("items").to_pylist()
                sizes = np.array([len(x) // 8 for x in parts])
                values, items = np.unique(np.frombuffer(b"".join(parts), np.uint64), return_inverse=True)
                begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                flags = np.zeros(len(values), np.int64)

                def agree(i, left):
                    flags[items[begins[i] : begins[i] + sizes[i]]] = 1
                    if len(left) * 4 > len(sizes):
                        common = np.add.reduceat(flags[items], begins)[left]
                    else:
                        common = np.array([flags[items[begins[j] : begins[j] + sizes[j]]].sum() for j in left])
                    flags[items[begins[i] : begins[i] + sizes[i]]] = 0
                    return 100 * common >= percent * (sizes[i] + sizes[left] - common)

                yield _stars(rows.column("cid").to_numpy(), agree, _labels(rows))

        yield from _edge_batches(found())

    return run


def _counted(rows: DataFrame) -> DataFrame:
    """(node, cid) of nodes that several share, with the node's size."""
    sizes = written(rows.groupBy("node").count().filter("count > 1"), "node-sizes")
    return rows.join(small_or_shuffled(sizes), "node")


def _across(members: DataFrame, percent: int, block_rows: int, block_shingles: int = 1 << 62) -> DataFrame | None:
    """(key, cid, label): for each pair of a group's members (group, cid, label, n_shingles) with different labels and sizes that allow a link, a key that both have.

    A key has at most about twice block_rows members and twice block_shingles shingles, or two members. Members of a group's most frequent label need no comparison among
    themselves, so blocks of the others are paired with blocks of all. Sizes lie in bands as wide as the threshold: links
    are within a band or between neighbours. None if each group has one label.
    """
    width = max(math.log(100 / percent), 0.001) * 1.001
    labels = members.groupBy("group", "label").agg(F.count("*").alias("n"))
    tops = written(labels.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1").select("group", "top"), "apart-groups")
    if tops.isEmpty():
        return None
    every = written(members.join(small_or_shuffled(tops), "group").withColumn("band", F.floor(F.log("n_shingles") / width)), "apart-members")
    apart = every.filter("label <> top").withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    counted = lambda rows, name: rows.groupBy("group", "band").agg(F.least(F.count("*"), F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n_shingles") / block_shingles))).cast("long").alias(name))
    blocks = written(counted(apart, "apart_blocks").join(counted(every, "blocks"), ["group", "band"]), "block-counts")

    def dealt(rows: DataFrame, own: str, other: str, key) -> DataFrame:
        block = F.pmod(F.xxhash64("cid"), F.col(own))
        others = F.sequence(F.lit(0).cast("long"), F.col(other) - 1)
        keys = F.transform(others, lambda x: F.xxhash64("group", "band", *key(block, x)))
        return rows.join(small_or_shuffled(blocks), ["group", "band"]).select(F.explode(keys).alias("key"), "cid", "label")

    return dealt(apart, "apart_blocks", "blocks", lambda own, other: (own, other)).unionByName(dealt(every, "blocks", "apart_blocks", lambda own, other: (other, own)))


def _more_components(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (id, component) with further edges."""
    return connected_components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(edges))


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with the component of their cid so far as label."""
    return members.join(found.select(F.col("id").alias("cid"), F.col("component").alias("label")).hint("merge"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _likely(classes: DataFrame, percent: int, node_rows: int) -> tuple[DataFrame, DataFrame]:
    """Components by sketches, (id, component), and (node, cid) of nodes, or blocks of large nodes, that are small enough to be compared."""
    shared = _counted(classes.select(F.explode("nodes").alias("node"), "cid"))
    rows = written(shared.join(classes.select("cid", "sketch", "n_shingles").hint("merge"), "cid").select("node", "cid", "sketch", "n_shingles", "count"), "node-rows")
    blocks = F.ceil(F.col("count") / node_rows)
    leaves = rows.select(F.when(blocks == 1, F.col("node")).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("node", "cid"), blocks))).alias("node"), "cid", "sketch")
    compared = lambda x, key: x.repartition(key).sortWithinPartitions(key).mapInArrow(_compare_sketches(percent), _EDGES)
    likely = connected_components(compared(leaves, "node"))
    large = rows.filter(F.col("count") > node_rows).select(F.col("node").alias("group"), "cid", "n_shingles")
    if not large.isEmpty():
        # sketches are short, so blocks of several times as many
        pairs = _across(_labelled(large, likely), percent, 4 * node_rows)
        if pairs is not None:
            likely = _more_components(likely, compared(pairs.join(classes.select("cid", "sketch").hint("merge"), "cid").select("key", "cid", "label", "sketch"), "key"))
    return likely, leaves.select("node", "cid")


def near_duplicates(docs: DataFrame, *, percent: int = 85, node_rows: int = 512, component_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: components of links with 100 * intersection >= percent * union."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = written(docs.mapInArrow(_sketches(percent), "doc_id long, n_shingles long, fp1 long, fp2 long, sketch binary, nodes array<long>"), "shingle-sketches")
    same = ["n_shingles", "fp1", "fp2"]
    classes = written(
        sets.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("cid"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes")), "shingle-classes"
    )
    likely, leaves = _likely(classes.filter("cid is not null"), percent, node_rows)
    likely = written(likely.withColumnRenamed("id", "cid").join(classes.select("cid", "n_shingles").hint("merge"), "cid"), "likely-members")
    sizes = likely.groupBy("component").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("shingles"), F.max("n_shingles").alias("widest"))
    # what one task may hold: so many texts, so many shingles
    whole, narrow = (F.col("count") <= component_rows) & (F.col("shingles") <= TASK_SHINGLES), F.col("widest") <= TASK_SHINGLES // node_rows
    sizes = written(sizes.select("component", whole.alias("whole"), narrow.alias("narrow")), "component-sizes")
    likely = written(likely.join(small_or_shuffled(sizes), "component").select("cid", "component", "n_shingles", "whole", "narrow"), "likely-components")
    by_component = likely.filter("whole").select("cid", F.array("component").alias("keys"))
    large = likely.filter("not whole")
    # nodes of wide texts aren't worth their memory: what they would find is found across blocks
    by_node = leaves.join(small_or_shuffled(large.filter("narrow").select("cid", "component"), likely), "cid").groupBy("cid").agg(F.collect_set(F.xxhash64("node", "component")).alias("keys"))

    def compared(keys: DataFrame) -> DataFrame:
        keys = written(keys, "comparison-keys")
        chosen = docs.join(small_or_shuffled(keys), docs.doc_id == keys.cid).select("cid", "label", "keys", "text")
        rows = chosen.mapInArrow(_full_sets, "cid long, label long, keys array<long>, items binary").select(F.explode("keys").alias("key"), "cid", "label", "items")
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare_sets(percent), _EDGES)

    linked = connected_components(compared(by_component.unionByName(by_node).withColumn("label", F.col("cid"))))
    if not large.isEmpty():
        members = large.select(F.col("component").alias("group"), "cid", "n_shingles")
        pairs = _across(_labelled(members, linked), percent, max(1, component_rows // 2), max(1, TASK_SHINGLES // 2))
        if pairs is not None:
            linked = _more_components(linked, compared(pairs.groupBy("cid", "label").agg(F.collect_set("key").alias("keys"))))
    deleted(leaves)
    members = written(classes.select(*same, "cid").join(linked.select(F.col("id").alias("cid"), "component").hint("merge"), "cid", "left").select(*same, F.coalesce("component", "cid").alias("component")), "class-components")
    out = sets.select("doc_id", *same).join(small_or_shuffled(members), same, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text and any others) but those that have a near duplicate with a smaller id."""
    found = near_duplicates(docs.select("doc_id", "text"), percent=percent)
    dropped = written(found.filter("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(small_or_shuffled(dropped), "doc_id", "left_anti").select(*docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id, s.doc_id <= coalesce(min(r.other), s.doc_id) AS kept
FROM s LEFT JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.s)
"""
