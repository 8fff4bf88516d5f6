"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

Counts of words and word pairs in training texts are quantised to levels, 1 + floor(log2 count).
The filter holds an n-gram once for each level up to its own, so a count is read by asking for
level 1, 2, ... until the answer is no; errors can only raise a level. Probabilities interpolate
the pair's relative frequency with the word's smoothed frequency. A word counts as the middle of its
level, and these are divided by their own sum over all training words, so that they sum to one with
the share of unseen words. A pair counts as the least of its level and its first word as the most of
its own, so that shares of a word's pairs sum to at most one; what is missing is lost, not given away.
But for false positives, probabilities of the words that can follow sum to at most one.

Counting: each Arrow batch is counted with numpy, a few megabytes at a time, and packed into one row for
each of P shards of the hash space; a shard's counts are merged in one task, which also makes its part of the filter.
Words and pairs are hashed, so hot ones are merged in their batch and shards are even. The filter
has ``BITS`` bits for each entry, whatever their number. One of at most ``max_filter_bytes`` is sent
to the driver and broadcast. A larger one stays in its shards, which are put into groups: each piece of text, some
megabytes, asks every group once for the levels and counts of its distinct words and the levels of its distinct pairs, and the
answers come back to it. A group looks up the questions of many pieces at once. Both ways give the same scores.

The base score needs exact counts. Words that make up at least one in ``FREQUENT`` of the training
tokens (so at most FREQUENT of them) are broadcast; occurrences of the others go to the shard that
holds their counts and come back as sums for each text.

Words are told apart by 64-bit hashes. Null texts count as empty, and have one token, the end.
Rows with null ids are scored and are not held out. Repeated rows count again. With no training
texts every count is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.storage import deleted, written
from strataline.llm.text_arrays import Texts, chunks, mix, mix_int, release, slices

BITS, PROBES = 8, 5
MAX_FILTER_BYTES = 256 << 20
FREQUENT = 200_000
#: Exact counts of about so many words are looked up in one task.
WORDS_A_GROUP = 1_000_000
#: Where the filter stays in its shards, one task answers for about so many tokens, and looks up about so many pairs at once.
TOKENS_A_GROUP, PAIRS_AT_ONCE = 8_000_000, 1_000_000
#: Pairs after a word seen c times get the weight PAIR_WEIGHT * c / (c + PAIR_PRIOR).
PAIR_WEIGHT, PAIR_PRIOR = 0.5, 20.0

#: In the column shard: a row that holds a piece's tokens.
PIECE = -1

END, BEGIN = np.uint64(mix_int(0xE0F)), np.uint64(mix_int(0xB0F))
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then the end), of each one's predecessor, and where texts begin."""
    tokens = np.insert(t.words(fold=True), t.word_offsets[1:], END)
    offsets = t.word_offsets + np.arange(t.n + 1)
    before = np.concatenate(([BEGIN], tokens[:-1]))
    before[offsets[:-1]] = BEGIN
    return tokens, before, offsets


def _pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _U(0x9E3779B97F4A7C15) + tokens * _U(0xC2B2AE3D27D4EB4F | 1))


def _merge(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their (summed) counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys) if counts is not None else None
    keys = keys[order] if counts is not None else np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts[order], first)


def _entry(shard: np.ndarray | int, short: np.ndarray, kind: int) -> np.ndarray:
    """What the filter knows of an n-gram: its shard and 32 more bits of its hash."""
    return mix((np.asarray(shard).astype(_U) << _U(32) | short.astype(_U)) + _U(mix_int(77 + kind)))


def _middle(levels: np.ndarray) -> np.ndarray:
    """What a word of a level counts as: the middle of the counts it stands for."""
    return np.where(levels > 1, 1.5 * 2.0 ** (levels.astype(float) - 1) - 0.5, levels)


def _place(entry: np.ndarray, level: int, probe: int, size: np.ndarray | int) -> np.ndarray:
    h = mix(entry + _U(mix_int(level)))
    return ((h & _U(0xFFFFFFFF)) + _U(probe) * (h >> _U(32) | _U(1))) % np.asarray(size).astype(_U)


def _count(shards: int):
    """Training doc_id, text to shard, words, word_counts, pairs, pair_counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pairs = np.zeros(0, _U)
            n = m = np.zeros(0, np.int64)
            for part in slices([batch], 0):
                found = [_tokens(t) for t in chunks(part.column(0))]
                h = np.concatenate([_pairs(before, tokens) for tokens, before, _ in found])
                more, times = _merge(np.concatenate([tokens for tokens, _, _ in found]))
                words, n = _merge(np.concatenate((words, more)), np.concatenate((n, times)))
                more, times = _merge((h % _U(shards)) << _U(32) | h >> _U(32))
                del found, h
                pairs, m = _merge(np.concatenate((pairs, more)), np.concatenate((m, times)))
            if not len(words):
                continue
            by = np.argsort(words % _U(shards), kind="stable")
            words, n = words[by], n[by]
            word_cuts = np.searchsorted(words % _U(shards), np.arange(shards + 1))
            pair_cuts = np.searchsorted(pairs, np.arange(shards + 1, dtype=_U) << _U(32))
            short = (pairs & _U(0xFFFFFFFF)).astype(np.uint32)
            out: list[list] = [[], [], [], [], []]
            for s in range(shards):
                a, b, c, d = word_cuts[s], word_cuts[s + 1], pair_cuts[s], pair_cuts[s + 1]
                if a == b and c == d:
                    continue
                # most pairs occur once in a batch: those that do come last and have no count
                once = m[c:d] == 1
                keys = np.concatenate((short[c:d][~once], short[c:d][once]))
                values = (s, words[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes(), keys.tobytes(), m[c:d][~once].astype(np.uint32).tobytes())
                for column, x in zip(out, values, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["shard", "words", "word_counts", "pairs", "pair_counts"])
            release()

    return run


_SHARD = "shard int, distinct long, total long, mass double, words binary, word_counts binary, size long, bits binary"


def _shard_rows(bits_an_entry: int):
    """Sorted packed rows to one row for each shard: exact word counts, and the shard's part of the filter."""

    def made(shard: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda name, kind: [np.frombuffer(x, kind) for r in rows for x in r.column(name).to_pylist()]
        words, counts = _merge(np.concatenate(column("words", _U)), np.concatenate(column("word_counts", np.uint32)).astype(np.int64))
        keys = column("pairs", np.uint32)
        times = [np.concatenate((c, np.ones(len(k) - len(c), np.uint32))) for k, c in zip(keys, column("pair_counts", np.uint32), strict=True)]
        pairs, pair_counts = _merge(np.concatenate(keys), np.concatenate(times).astype(np.int64))
        entries = np.concatenate((_entry(shard, words >> _U(32), 1), _entry(shard, pairs, 2)))
        levels = np.frexp(np.concatenate((counts, pair_counts)).astype(float))[1]
        size = max(64, bits_an_entry * int(levels.sum()))
        size += -size % 8
        bits = np.zeros(size, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = entries[levels >= level]
            for probe in range(PROBES):
                bits[_place(own, level, probe, size)] = True
        values = ([shard], [len(words)], [int(counts.sum())], [float(_middle(levels[: len(words)]).sum())], [words.tobytes()], [counts.tobytes()], [size], [np.packbits(bits, bitorder="little").tobytes()])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], [x.split()[0] for x in _SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if now is not None and now != key[a]:
                    yield made(int(now), held)
                    held = []
                    release()
                now = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield made(int(now), held)
        release()

    return run


@dataclass
class Filter:
    """The filter's shards, one after the other in bits; bits is None if they stay where they are."""

    shards: int
    bits: np.ndarray | None
    begins: np.ndarray
    sizes: np.ndarray
    tokens: int
    distinct: int
    mass: float
    frequent: np.ndarray
    frequent_counts: np.ndarray

    def levels(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        return self.levels_of((hashes % _U(self.shards)).astype(np.int64), hashes >> _U(32), kind)

    def levels_of(self, shard: np.ndarray, short: np.ndarray, kind: int) -> np.ndarray:
        entry, size, begin = _entry(shard, short, kind), self.sizes[shard], self.begins[shard]
        levels, left, level = np.zeros(len(shard), np.int64), np.flatnonzero(size), 0
        while len(left):
            level += 1
            for probe in range(PROBES):
                at = begin[left] + _place(entry[left], level, probe, size[left]).astype(np.int64)
                left = left[self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
            levels[left] = level
            if level == 40:
                break
        return levels

    def scores(self, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of each token after its predecessor."""
        words, where = np.unique(np.concatenate((tokens, before)), return_inverse=True)
        return self.scores_of(self.levels(words, 1), where, self.levels(_pairs(before, tokens), 2))

    def scores_of(self, words: np.ndarray, where: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The same from levels: of distinct words, with where tokens and predecessors are among them, and of each pair."""
        n = len(pairs)
        single = (_middle(words) + 0.5) / (self.mass + 0.5 * (self.distinct + 1))
        most = 2.0 ** words[where[n:]] - 1
        share = PAIR_WEIGHT * most / (most + PAIR_PRIOR)
        least = np.where(pairs > 0, 2.0 ** (pairs.astype(float) - 1), 0)
        return np.log10(share * np.minimum(least / np.maximum(most, 1.0), 1.0) + (1 - share) * single[where[:n]])


_SCORED = "row_key long, doc_id long, n_tokens long, base double, known long, score double, shard int, words binary, rows binary, times binary"
_SCORED_NAMES = [x.split()[0] for x in _SCORED.split(", ")]


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: those that are zero take no room when compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _piece(start: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of a slice of texts: a row for each, and one with its distinct words, each token's place among them, and where texts begin."""
    found = [_tokens(t) for t in chunks(batch.column(1))]
    if not found:
        return
    lengths = np.concatenate([np.diff(offsets) for _, _, offsets in found])
    once, where = np.unique(np.concatenate([tokens for tokens, _, _ in found]), return_inverse=True)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    n, empty = len(lengths), lambda k, kinds: [pa.nulls(k, kind) for kind in kinds]
    real = (pa.float64(), pa.int64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(start + np.arange(n)), batch.column(0), pa.array(lengths), *empty(n, (*real, pa.int32(), *[pa.binary()] * 3))], _SCORED_NAMES)
    yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), *empty(1, (pa.int64(), pa.int64(), *real)), pa.array([PIECE], pa.int32()), *(pa.array([x], pa.binary()) for x in (once.tobytes(), _planes(where.astype(np.uint32)), offsets.astype(np.int64).tobytes()))], _SCORED_NAMES)


def _score(model, groups: int):
    """doc_id, text to a row for each text, and rows of packed occurrences of words that aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Filter = model.value
        denominator = np.log10(f.tokens + 0.5 * (f.distinct + 1)) if f.tokens else np.log10(0.5)
        done = TaskContext.get().partitionId() << 40
        logs = np.log10(f.frequent_counts + 0.5)
        for batch in slices(batches, 1):
            n, parts = batch.num_rows, []
            if f.bits is None:
                yield from _piece(done, batch)
                done += n
                continue
            length, base, known, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
            for t in chunks(batch.column(1)):
                tokens, before, offsets = _tokens(t)
                here = slice(t.first, t.first + t.n)
                length[here] = np.diff(offsets)
                score[here] = np.add.reduceat(f.scores(tokens, before), offsets[:-1])
                text = np.repeat(np.arange(t.first, t.first + t.n), np.diff(offsets))
                at = np.minimum(np.searchsorted(f.frequent, tokens), max(len(f.frequent) - 1, 0))
                found = f.frequent[at] == tokens if len(f.frequent) else np.zeros(len(tokens), bool)
                base += np.bincount(text[found], logs[at[found]], minlength=n) if found.any() else 0
                known += np.bincount(text[found], minlength=n)
                rare, owner = tokens[~found], text[~found]
                if len(rare):
                    by = np.lexsort((rare, owner))
                    rare, owner = rare[by], owner[by]
                    first = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1]))))
                    parts.append((rare[first], owner[first].astype(np.uint32), np.diff(np.append(first, len(rare))).astype(np.uint32)))
            base -= length * denominator
            empty = pa.nulls(n, pa.binary())
            columns = [pa.array(done + np.arange(n)), batch.column(0), pa.array(length), pa.array(base), pa.array(known), pa.array(score), pa.nulls(n, pa.int32()), empty, empty, empty]
            names = _SCORED_NAMES
            yield pa.RecordBatch.from_arrays(columns, names)
            if parts:
                words, owner, times = (np.concatenate(x) for x in zip(*parts, strict=True))
                group = (words % _U(f.shards) % _U(groups)).astype(np.int64)
                by = np.argsort(group, kind="stable")
                cuts = np.searchsorted(group[by], np.arange(groups + 1))
                packed = [(g, by[cuts[g] : cuts[g + 1]]) for g in range(groups) if cuts[g] < cuts[g + 1]]
                k = len(packed)
                binary = [pa.array([x[i].tobytes() for _, i in packed], pa.binary()) for x in (words, owner, times)]
                nothing = [pa.nulls(k, kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([done] * k, pa.int64()), *nothing, pa.array([g for g, _ in packed], pa.int32()), *binary], names)
            done += n

    return run


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's word counts (first) and its packed occurrences to sums for each text."""
    now, words, counts = None, np.zeros(0, _U), np.zeros(0)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for group, start, keys, rows, values in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if group != now:
                now, held, words = group, [], None
            if rows is None:
                held.append((np.frombuffer(keys, _U), np.frombuffer(values, np.int64)))
                words = None
                continue
            if words is None:
                words = np.concatenate([x[0] for x in held]) if held else np.zeros(0, _U)
                order = np.argsort(words)
                words, counts = words[order], (np.concatenate([x[1] for x in held]) if held else np.zeros(0, np.int64))[order]
            key, owner, times = np.frombuffer(keys, _U), np.frombuffer(rows, np.uint32).astype(np.int64), np.frombuffer(values, np.uint32)
            at = np.minimum(np.searchsorted(words, key), max(len(words) - 1, 0))
            found = words[at] == key if len(words) else np.zeros(len(key), bool)
            c = np.where(found, counts[at] if len(words) else 0, 0)
            base, known = np.bincount(owner, times * np.log10(c + 0.5)), np.bincount(owner, times * found)
            touched = np.unique(owner)
            packed = (touched.astype(np.uint32), base[touched], known[touched].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([start]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["row_key", "rows", "base", "known"])
        release()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sums of all groups for a scored batch (rows sorted by its first key) to a row for each text."""

    def row_batch(start: int, base: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(start + np.arange(len(base))), pa.array(base), pa.array(known)], ["row_key", "more_base", "more_known"])

    now, base, known = None, np.zeros(0), np.zeros(0, np.int64)
    for batch in batches:
        for start, rows, more, seen in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if start != now:
                if now is not None:
                    yield row_batch(now, base, known)
                now, base, known = start, np.zeros(0), np.zeros(0, np.int64)
            at = np.frombuffer(rows, np.uint32)
            if len(base) <= at.max():
                base, known = (np.concatenate((x, np.zeros(int(at.max()) + 1 - len(x), x.dtype))) for x in (base, known))
            base[at] += np.frombuffer(more, float)
            known[at] += np.frombuffer(seen, np.uint32)
        release()
    if now is not None:
        yield row_batch(now, base, known)


def _unpacked(words: bytes, where: bytes, offsets: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A piece's distinct words, the places of its tokens and of their predecessors among them (BEGIN is put last), and where texts begin."""
    once, offsets = np.append(np.frombuffer(words, _U), BEGIN), np.frombuffer(offsets, np.int64)
    at = _from_planes(where, np.uint32).astype(np.int64)
    before = np.concatenate(([len(once) - 1], at[:-1]))
    before[offsets[:-1]] = len(once) - 1
    return once, at, before, offsets


def _by_group(hashes: np.ndarray, shards: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of distinct hashes by group and shard, where groups begin in it, and the hashes' shards in that order."""
    shard = (hashes % _U(shards)).astype(np.int64)
    by = np.argsort(shard % groups * shards + shard, kind="stable")
    return by, np.searchsorted((shard % groups)[by], np.arange(groups + 1)), shard[by]


_ASKED = "shard int, row_key long, kind int, part int, size long, words binary, more binary, bits binary"
_ASKED_NAMES = [x.split()[0] for x in _ASKED.split(", ")]


def _asking(shards: int, groups: int):
    """Pieces (row_key, words, rows, times) to what they ask each group: words, and of pairs their shards and 32 more bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, *piece = (batch.column(c)[i].as_py() for c in range(4))
                once, at, before, _ = _unpacked(*piece)
                by, cuts, _ = _by_group(once, shards, groups)
                pairs = np.unique(_pairs(once[before], once[at]))
                pair_by, pair_cuts, shard = _by_group(pairs, shards, groups)
                once, short, shard = once[by], (pairs[pair_by] >> _U(32)).astype(np.uint32), (shard // groups).astype(np.uint16)
                asked = [g for g in range(groups) if cuts[g] < cuts[g + 1] or pair_cuts[g] < pair_cuts[g + 1]]
                k, cut = len(asked), lambda x, c: pa.array([x[c[g] : c[g + 1]].tobytes() for g in asked], pa.binary())  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array([start] * k, pa.int64()), pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), cut(once, cuts), cut(shard, pair_cuts), cut(short, pair_cuts)], _ASKED_NAMES)
            release()

    return run


def _answered(shards: int, groups: int):
    """A group's shards (kind 0, first) and what it is asked to levels, a byte each, and word counts. Without shards all are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables, asked, waiting, known = None, [], [], 0, None

        def model() -> tuple[Filter, np.ndarray, np.ndarray]:
            sizes, begins = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
            bits = np.frombuffer(b"".join(t[4] for t in tables), np.uint8)
            for t, begin in zip(tables, np.cumsum([0, *(len(t[4]) for t in tables)]), strict=False):
                sizes[t[0]], begins[t[0]] = t[1], 8 * begin
            words, counts = (np.frombuffer(b"".join(t[i] for t in tables), kind) for i, kind in ((2, _U), (3, np.int64)))
            order = np.argsort(words)
            return Filter(shards, bits, begins, sizes, 0, 0, 0.0, np.zeros(0, _U), np.zeros(0, np.int64)), words[order], counts[order]

        def answers() -> pa.RecordBatch:
            f, words, counts = known
            hashes, short = (np.frombuffer(b"".join(x[i] for x in asked), kind) for i, kind in ((1, _U), (3, np.uint32)))
            shard = np.frombuffer(b"".join(x[2] for x in asked), np.uint16).astype(np.int64) * groups + now
            at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
            n = np.where(words[at] == hashes, counts[at], 0) if len(words) else np.zeros(len(hashes), np.int64)
            levels, pairs = f.levels(hashes, 1).astype(np.uint8), f.levels_of(shard, short, 2).astype(np.uint8)
            a, b = np.cumsum([0, *(len(x[1]) // 8 for x in asked)]), np.cumsum([0, *(len(x[3]) // 4 for x in asked)])
            cut = lambda x, c: pa.array([x[i:j].tobytes() for i, j in zip(c[:-1], c[1:], strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in asked], pa.int64()), pa.array([now] * len(asked), pa.int32()), cut(levels, a), pa.array([_planes(n[i:j]) for i, j in zip(a[:-1], a[1:], strict=True)], pa.binary()), cut(pairs, b)], ["row_key", "shard", "words", "rows", "times"])

        for batch in batches:
            for i in range(batch.num_rows):
                group, start, kind, part, size, words, more, bits = (batch.column(c)[i].as_py() for c in range(8))
                if group != now:
                    if asked:
                        yield answers()
                    now, tables, asked, waiting, known = group, [], [], 0, None
                if kind == 0:
                    tables.append((part, size, words, more, bits))
                    continue
                known = known or model()
                asked.append((start, words, more, bits))
                waiting += len(bits) // 4
                if waiting >= PAIRS_AT_ONCE:
                    yield answers()
                    asked, waiting = [], 0
            release()
        if asked:
            yield answers()

    return run


def _piece_scores(shards: int, groups: int, tokens: int, distinct: int, mass: float):
    """A piece (first) and all answers to it, by group, to a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(shards, None, np.zeros(0), np.zeros(0), tokens, distinct, mass, np.zeros(0, _U), np.zeros(0, np.int64))
        denominator = np.log10(tokens + 0.5 * (distinct + 1)) if tokens else np.log10(0.5)

        def scored(start: int, piece: tuple, answers: list[tuple]) -> pa.RecordBatch:
            once, at, before, offsets = _unpacked(*piece)
            by, _, _ = _by_group(once, shards, groups)
            pairs, pair_at = np.unique(_pairs(once[before], once[at]), return_inverse=True)
            pair_by, _, _ = _by_group(pairs, shards, groups)
            seen, counts, pair = np.zeros(len(once), np.uint8), np.zeros(len(once), np.int64), np.zeros(len(pairs), np.uint8)
            seen[by], pair[pair_by] = (np.frombuffer(b"".join(x[i] for x in answers), np.uint8) for i in (0, 2))
            counts[by] = np.concatenate([_from_planes(x[1], np.int64) for x in answers])
            score = np.add.reduceat(f.scores_of(seen, np.concatenate((at, before)), pair[pair_at]), offsets[:-1])
            base = np.add.reduceat(np.log10(counts + 0.5)[at], offsets[:-1]) - np.diff(offsets) * denominator
            known = np.add.reduceat((counts > 0).astype(np.int64)[at], offsets[:-1])
            return pa.RecordBatch.from_arrays([pa.array(start + np.arange(len(score))), pa.array(score), pa.array(base), pa.array(known)], ["row_key", "score", "base", "known"])

        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                start, kind, *binary = (batch.column(c)[i].as_py() for c in (0, 1, 2, 3, 4))
                if kind == PIECE:
                    if held:
                        yield scored(*held)
                        release()
                    held = (start, binary, [])
                else:
                    held[2].append(binary)
        if held:
            yield scored(*held)

    return run


def _scores_by_shard(scored: DataFrame, table: DataFrame, shards: int, groups: int, tokens: int, distinct: int, mass: float) -> DataFrame:
    """row_key, score, base, known of the texts of all pieces, by a filter and counts that stay in their shards."""
    pieces = scored.filter(F.col("shard") == PIECE).select("row_key", "shard", "words", "rows", "times")
    int_ = lambda c: c.cast("int")
    filters = table.select(int_(F.expr(f"shard % {groups}")).alias("shard"), F.lit(-1).cast("long").alias("row_key"), int_(F.lit(0)).alias("kind"), F.col("shard").alias("part"), "size", "words", F.col("word_counts").alias("more"), "bits")
    asked = pieces.select("row_key", "words", "rows", "times").mapInArrow(_asking(shards, groups), _ASKED)
    answers = filters.unionByName(asked).repartition(groups, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_answered(shards, groups), "row_key long, shard int, words binary, rows binary, times binary")
    return pieces.unionByName(answers).repartition("row_key").sortWithinPartitions("row_key", "shard").mapInArrow(_piece_scores(shards, groups, tokens, distinct, mass), "row_key long, score double, base double, known long")


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w, c = np.frombuffer(words, _U), np.frombuffer(counts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w[c >= least].view(np.int64)), pa.array(c[c >= least])], ["word", "n"])

    return run


def lm_scores(docs: DataFrame, *, max_filter_bytes: int = MAX_FILTER_BYTES, bits_an_entry: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 2 * partitions
    packed = docs.filter(~held_out(F.col("doc_id"))).select("text").mapInArrow(_count(shards), "shard int, words binary, word_counts binary, pairs binary, pair_counts binary")
    made = packed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_shard_rows(bits_an_entry), _SHARD)
    table = written(made, "ngram-shards")
    tokens, distinct, mass = table.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "mass")]).first()
    # a group's exact counts are in one worker's memory: as many groups as keep them small
    groups = min(shards, max(4, partitions // 4, -(-distinct // WORDS_A_GROUP)))
    frequent = table.select("words", "word_counts").mapInArrow(_frequent(max(1, -(-tokens // FREQUENT))), "word long, n long").toPandas()
    words = frequent["word"].to_numpy(np.int64).view(_U)
    order = np.argsort(words)
    sent = (table.agg(F.sum("size")).first()[0] or 0) <= 8 * max_filter_bytes
    parts = {r["shard"]: r["bits"] for r in table.select("shard", "bits").collect()} if sent else {}
    sizes = np.array([8 * len(parts.get(s, b"")) for s in range(shards)], np.int64)
    bits = np.frombuffer(b"".join(parts.get(s, b"") for s in range(shards)), np.uint8) if sent else None
    model = spark.sparkContext.broadcast(Filter(shards, bits, np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes, tokens, distinct, float(mass), words[order], frequent["n"].to_numpy(np.int64)[order]))
    scored = written(docs.mapInArrow(_score(model, groups), _SCORED), "lm-scored")
    if not sent:
        # as many groups as keep what a group is asked small
        groups = min(shards, max(groups, -(-tokens // TOKENS_A_GROUP)))
        found = _scores_by_shard(scored, table, shards, groups, tokens, distinct, float(mass))
        out = scored.filter("shard is null").select("row_key", "doc_id", "n_tokens").join(found.hint("merge"), "row_key")
        return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
    group = F.expr(f"cast(shard % {groups} as int)")
    known = table.select(group.alias("shard"), F.lit(0).cast("long").alias("row_key"), "words", F.lit(None).cast("binary").alias("rows"), F.col("word_counts").alias("times"))
    asked = scored.filter("shard >= 0").select("shard", "row_key", "words", "rows", "times")
    both = known.unionByName(asked).repartition(groups, "shard").sortWithinPartitions("shard", F.col("rows").isNotNull())
    parts = both.mapInArrow(_look_up, "row_key long, rows binary, base binary, known binary").repartition("row_key").sortWithinPartitions("row_key")
    sums = parts.mapInArrow(_added, "row_key long, more_base double, more_known long")
    out = scored.filter("shard is null").select("row_key", "doc_id", "n_tokens", "base", "known", "score").join(sums.hint("merge"), "row_key", "left")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
