"""SentencePiece (BPE type) encoding and decoding by suffix-array matching.

The distinct words of a batch (a word is a space mark and what follows up to the next space) are
joined into one index text, and a suffix array is sorted over its characters, to the length of the
longest piece. Every piece is binary-searched for the range of suffixes that begin with it; each
occurrence is an edge from its first to past its last character. Edges are sorted by their end and
relaxed from left to right: an edge extends the encoding of the prefix before it if its piece stands
next to that encoding's last piece, that is, if merging the two texts in the order of the
vocabulary leaves the two pieces as they are. Merging gives every prefix exactly one encoding, so
this finds the same pieces as merging itself. Characters without a piece become byte pieces.

Words are encoded once in a worker (up to ``CACHED`` are kept); texts then are rows of word numbers.
No shuffle, memory bounded by a batch. Null texts count as empty and have no ids. Decoding gives
the text back exactly, but that a literal space mark (U+2581) comes back as a space, as the format has it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
CACHED, NEIGHBOURS, INDEX_CHARS = 500_000, 1_000_000, 1_000_000
SCHEMA = "doc_id long, n_ids long, ids_crc32 long, n_chars long, decoded_same boolean"


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a SentencePiece model file, with their ranks (merged first: 0)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = np.array([p.score for p in model.pieces])
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.neighbours: dict[int, bool] = {}
        # Single characters come before all merges; the others are merged in the order of their scores.
        by = sorted(self.ids.values(), key=lambda i: (len(self.pieces[i]) > 1, -self.scores[i], i))
        self.rank = {i: r for r, i in enumerate(by)}
        self.halves: dict[int, tuple[int, int]] = {}
        self._points = {i: np.array([*map(ord, p)], np.uint32) for p, i in self.ids.items()}

    def normalise(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def merged(self, word: str) -> list[int | str]:
        """Piece ids (or single characters without one) of a short text, by merging the best pair again and again."""
        parts: list[str] = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, p) for p in parts]

    def _halves(self, k: int) -> tuple[int, int]:
        """The pieces whose merge made piece k; k itself for a single character."""
        found = self.halves.get(k)
        if found is None:
            word, found = self.pieces[k], (k, k)
            for i in range(1, len(word)):
                left, right = self.ids.get(word[:i]), self.ids.get(word[i:])
                if left is not None and right is not None and self.merged(word[:i]) == [left] and self.merged(word[i:]) == [right] and self._apart(left, right, self.rank[k]):
                    found = left, right
                    break
            self.halves[k] = found
        return found

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge before the one of rank limit reaches across the two pieces: walks back
        through the merges that made them, latest first, looking at what touches the boundary."""
        pieces, ids, rank = self.pieces, self.ids, self.rank
        while True:
            both = ids.get(pieces[left] + pieces[right])
            if both is not None and rank[both] < limit:
                return False
            a, b = rank[left], rank[right]
            inner_left, inner_right = self._halves(left)[1], self._halves(right)[0]
            if inner_left == left and inner_right == right:
                return True
            if inner_right == right or (inner_left != left and a > b):
                limit, left = min(limit, a), inner_left
            else:
                limit, right = min(limit, b + 1), inner_right

    def stand(self, left: int, right: int) -> bool:
        """Whether two pieces next to each other stay as they are."""
        key = left << 20 | right
        known = self.neighbours.get(key)
        if known is None:
            if set(self.pieces[left] + self.pieces[right]) == {MARK}:  # runs of marks have equal scores
                known = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
            else:
                known = self._apart(left, right, len(self.rank) + 1)
            if len(self.neighbours) < NEIGHBOURS:
                self.neighbours[key] = known
        return known


def suffix_order(points: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first depth characters (prefix doubling)."""
    n = len(points)
    _, ranks = np.unique(points, return_inverse=True)
    ranks = ranks.astype(np.int64) + 1
    width = 1
    order = np.argsort(ranks, kind="stable")
    while width < depth:
        second = np.zeros(n, np.int64)
        second[: max(n - width, 0)] = ranks[width:]
        key = ranks << 32 | second
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
        ranks = np.empty(n, np.int64)
        ranks[order] = np.cumsum(new) + 1
        width *= 2
    return order


def occurrences(points: np.ndarray, order: np.ndarray, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, the range of order whose suffixes begin with it: binary searches, all pieces at once."""
    n, longest = len(points), max((len(p) for p in pieces), default=0)
    table = np.zeros((len(pieces), longest), np.int64)
    sizes = np.array([len(p) for p in pieces])
    for i, p in enumerate(pieces):
        table[i, : len(p)] = p
    padded = np.concatenate((points.astype(np.int64), np.full(longest, -1)))

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
        while (low < high).any():
            open_ = low < high
            middle = (low + high) >> 1
            at = order[np.minimum(middle, n - 1)]
            sign = np.zeros(len(pieces), np.int64)
            for j in range(longest):
                sign = np.where((sign == 0) & (j < sizes), np.sign(padded[at + j] - table[:, j]), sign)
            less = (sign < 0) | (after & (sign == 0))
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    return bound(False), bound(True)


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (sizes[0] of them), begins[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


class Encoder:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.order = sorted(self.v.ids.values())
        self.points = [self.v._points[i] for i in self.order]
        self.cut = _cutter(self.v.ids)
        raw = [bytes([self.v.byte_of[i]]) if i in self.v.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.v.pieces)]
        self.raw, self.raw_sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([*map(len, raw)])
        self.raw_begins = np.cumsum(self.raw_sizes) - self.raw_sizes
        self._forget()

    def _forget(self) -> None:
        """Known words: their number in index, and ids in flat from begins, sizes many."""
        self.index: dict[str, int] = {}
        self.flat, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encodes distinct words through one index text."""
        v = self.v
        text = "\x00".join(words)
        if not text:
            return
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        present = set(np.unique(points).tolist())
        usable = [(i, p) for i, p in zip(self.order, self.points, strict=True) if present.issuperset(p.tolist())]
        order = suffix_order(points, v.longest)
        edges: list[np.ndarray] = []
        if usable:
            low, high = occurrences(points, order, [p for _, p in usable])
            counts = high - low
            which = np.repeat(np.arange(len(usable)), counts)
            begin = order.astype(np.int32)[np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))]
            sizes = np.array([len(p) for _, p in usable], np.int32)[which]
            ids = np.array([i for i, _ in usable], np.int32)[which]
            edges = [begin, begin + sizes, ids]
        lengths = np.array([*map(len, words)])
        starts = np.cumsum(lengths + 1) - lengths - 1
        self._relax(words, points, starts, lengths, edges)

    def _relax(self, words: list[str], points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, edges: list[np.ndarray]) -> None:
        """Edges sorted by how far into their word they end, all words' edges of one end at once."""
        v, n = self.v, len(points)
        inside = np.repeat(np.arange(len(words)), lengths + 1)[:n]
        offset = np.arange(n) - starts[inside]
        begins, ends, pieces = edges if edges else [np.zeros(0, np.int32)] * 3
        depth = offset[ends - 1] + 1 if len(ends) else ends
        by = np.argsort(depth, kind="stable")
        begins, ends, pieces, depth = begins[by], ends[by], pieces[by], depth[by]
        without = ~np.isin(points, np.array([ord(p) for p in v.ids if len(p) == 1], np.uint32))
        lone = np.flatnonzero(without & (offset < lengths[inside]))
        lone = lone[np.argsort(offset[lone], kind="stable")]
        lone_depth = offset[lone] + 1
        # last[p]: last piece of the encoding of a word up to p (-1: a character without a piece, -2: none, -3: the word's begin)
        last, back = np.full(n + 1, -2, np.int32), np.zeros(n + 1, np.int32)
        last[starts] = -3
        for d in range(1, int(lengths.max(initial=0)) + 1):
            a, b = np.searchsorted(depth, [d, d + 1])
            left, right = last[begins[a:b]], pieces[a:b]
            good = (left == -1) | (left == -3)
            ask = np.flatnonzero(left >= 0)
            if len(ask):
                keys, where = np.unique(left[ask].astype(np.int64) << 20 | right[ask], return_inverse=True)
                answers = np.array([v.stand(k >> 20, k & 0xFFFFF) for k in keys.tolist()], bool)
                good[ask] = answers[where]
            to = ends[a:b][good]
            last[to], back[to] = right[good], begins[a:b][good]
            c, e = np.searchsorted(lone_depth, [d, d + 1])
            last[lone[c:e] + 1], back[lone[c:e] + 1] = -1, lone[c:e]
        at, low, found, sizes_out = (starts + lengths).tolist(), starts.tolist(), [], []
        last_list, back_list = last.tolist(), back.tolist()
        for word, p, start in zip(words, at, low, strict=True):
            out: list[int] = []
            while p > start:
                b = back_list[p]
                if last_list[p] < 0:
                    out.extend(v.bytes[x] for x in reversed(chr(points[b]).encode()))
                else:
                    out.append(last_list[p])
                p = b
            found.extend(out[::-1])
            sizes_out.append(len(out))
            self.index[word] = len(self.index)
        sizes = np.array(sizes_out, np.int64)
        self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, np.array(found, np.int32)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        cut = [self.cut(self.v.normalise(t)) for t in texts]
        fresh = {w for ws in cut for w in ws}.difference(self.index)
        words, size = [], 0
        for w in sorted(fresh):
            words.append(w)
            size += len(w)
            if size > INDEX_CHARS:
                self._learn(words)
                words, size = [], 0
        if words:
            self._learn(words)
        index = self.index
        numbers = np.array([index[w] for ws in cut for w in ws], np.int64)
        sizes = self.sizes[numbers]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[_ragged(self.begins[numbers], sizes)]
        if len(index) > CACHED:  # the words learnt first, so the common ones, stay
            for w in fresh:
                if index[w] >= CACHED:
                    del index[w]
            self.flat = self.flat[: self.begins[CACHED]].copy()
            self.begins, self.sizes = self.begins[:CACHED].copy(), self.sizes[:CACHED].copy()
        return ids, ends[np.concatenate(([0], np.cumsum([*map(len, cut)], dtype=np.int64)))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 of each text."""
        sizes = self.raw_sizes[ids]
        data = self.raw[_ragged(self.raw_begins[ids], sizes)].tobytes()
        at = np.concatenate(([0], np.cumsum(sizes)))[offsets].tolist()
        skip = int(self.v.prefix)
        return [data[a + skip : b] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


def _cutter(ids: dict[str, int]):
    """A function that cuts a text where no piece can reach across: before runs of marks, around
    characters without a piece, and before signs that no piece has after anything but marks and such signs."""
    single = {p for p in ids if len(p) == 1}
    signs = {c for c in single if not c.isalnum() and c != MARK}
    before: dict[str, set[str]] = {}
    for p in ids:
        for x, y in zip(p, p[1:], strict=False):
            before.setdefault(y, set()).add(x)
    while (kept := {c for c in signs if before.get(c, set()) <= signs | {MARK}}) != signs:
        signs = kept
    # pieces with a mark after another character hold nothing but marks, so marks go with what follows them
    assert all(not set(p[1:]) & {MARK} or set(p) == {MARK} for p in ids)
    chosen = "".join(map(re.escape, sorted(signs)))
    return re.compile(rf"\n|{MARK}*[^{MARK}\n{chosen}]+|{MARK}*[{chosen}][^{MARK}\n]*|{MARK}+").findall if "\n" not in single else re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+").findall


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """Kept in the worker process: words learnt by one task serve the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_table(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """SCHEMA for each row of docs, and with_ids the ids. decoded_same: decoding gives the text."""
    path = path or piece_bpe_path()
    schema = SCHEMA + ", ids array<int>" * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2500):
                part = batch.slice(at, 2500)
                texts = pc.fill_null(part.column(1), "").to_pylist()
                ids, offsets = codec.encode(texts)
                raw = ids.astype("<u4").tobytes()
                cuts = offsets.tolist()
                columns = [
                    part.column(0),
                    pa.array(np.diff(offsets)),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([x == t.replace(MARK, " ").encode() for x, t in zip(codec.decode(ids, offsets), texts, strict=True)]),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
