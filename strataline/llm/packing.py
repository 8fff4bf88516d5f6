"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Lengths fall into reciprocal-capacity classes: a document of length l is in class
floor(capacity / l), and each bin of class k takes exactly k documents of it, so bins fill
independently, in every task for itself, with no shuffle. A class-k bin leaves less than
capacity / (k + 1) free; longer documents are cut to fill those gaps and then whole sequences.
Documents of unfinished bins are carried to the next batch, and what is left at a task's end is
cut into sequences whose lengths are powers of two, which need no padding. So all sequences are
full.

Memory is bounded by one Arrow batch and fewer than capacity carried tokens for each class.
Null or empty texts give the end token alone; repeated rows are packed again; an empty table gives
no pieces; extra columns are ignored. A very long text is held as an array of four bytes an id. Sequence ids hold the task's partition number, so they are unique and a retried task
gives the same ones.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.text_arrays import release

#: Fixed value: the token that ends a document.
END_ID = 1
#: The smallest class takes documents of at most capacity / MOST tokens, MOST to a bin.
MOST = 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_bpe(path: str) -> Callable[[list[str]], list[list[int]]]:
    """An encoder for the byte-level BPE vocabulary in the JSON file at path; the string of an added token is that token.

    The vocabulary and pattern of the file are run by tiktoken, which gives the same ids as
    tokenizers with add_special_tokens=False several times as fast (tests compare them).
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    # byte-level vocabularies write bytes that aren't printable as the characters from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    added, every = list(special), set(special)
    return lambda texts: [encoding.encode(x, allowed_special=every) if any(s in x for s in added) else encoding.encode_ordinary(x) for x in texts]


class Packer:
    """Packs documents, given as (key, ids), into sequences of exactly capacity ids.

    Pieces are (key, start, ids, document length, sequence number, offset). An item is a document
    and the range of its ids that has yet to be placed.
    """

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.waiting: dict[int, list[tuple]] = {}
        self.filler: deque[tuple] = deque()

    def _emit(self, items: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, a, b in items:
            yield doc[0], a, doc[1][a:b], len(doc[1]), self.sequences, at
            at += b - a
        self.sequences += 1

    def _take(self, n: int) -> list[tuple]:
        """The filler's next n ids."""
        taken = []
        while n:
            doc, a, b = self.filler.popleft()
            cut = min(b, a + n)
            taken.append((doc, a, cut))
            n -= cut - a
            if cut < b:
                self.filler.appendleft((doc, cut, b))
        return taken

    def _whole(self) -> Iterator[tuple]:
        left = sum(b - a for _, a, b in self.filler)
        while left >= self.capacity:
            yield from self._emit(self._take(self.capacity))
            left -= self.capacity

    def add(self, docs: list[tuple]) -> Iterator[tuple]:
        """The pieces of the sequences that these documents complete."""
        bins: deque[list[tuple]] = deque()
        for doc in docs:
            n = len(doc[1])
            if n > self.capacity:
                self.filler.append((doc, 0, n))
                continue
            k = min(self.capacity // n, MOST)
            bin_ = self.waiting.setdefault(k, [])
            bin_.append((doc, 0, n))
            if len(bin_) == k:
                bins.append(self.waiting.pop(k))
        free = sum(b - a for _, a, b in self.filler)
        while bins:
            items = bins.popleft()
            gap = self.capacity - sum(b - a for _, a, b in items)
            while free < gap and (self.waiting or bins):
                # no longer documents are left to cut: take those of unfinished bins, then of the last bins
                more = self.waiting.popitem()[1] if self.waiting else bins.pop()
                self.filler.extend(more)
                free += sum(b - a for _, a, b in more)
            if free < gap:
                self.filler.extend(items)
                break
            free -= gap
            yield from self._emit(items + self._take(gap))
        yield from self._whole()

    def finish(self) -> Iterator[tuple]:
        """The pieces of what is left, in sequences of powers of two."""
        for items in self.waiting.values():
            self.filler.extend(items)
        self.waiting = {}
        yield from self._whole()
        left = sum(b - a for _, a, b in self.filler)
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                yield from self._emit(self._take(1 << bit))


def pack(docs: DataFrame, *, path: str | None = None, capacity: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: SCHEMA, and with_ids also the ids themselves. path: a byte-level BPE vocabulary (JSON)."""
    path = path or byte_bpe_path()
    schema = SCHEMA + ", ids array<int>" * with_ids

    def table(pieces: list[tuple], task: int) -> pa.RecordBatch:
        ids = [p[2] for p in pieces]
        longs = [
            [p[0] for p in pieces],
            [p[1] for p in pieces],
            [len(x) for x in ids],
            [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
            [p[3] for p in pieces],
            [(task << 40) + p[4] for p in pieces],
            [p[5] for p in pieces],
        ]
        columns = [pa.array(x, pa.int64()) for x in longs]
        if with_ids:
            columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, task = byte_bpe(path), Packer(capacity), TaskContext.get().partitionId()
        for batch in batches:
            docs = []
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                # lists of ids take nine times as much memory as arrays, so few texts have them at once
                ids = [np.array([*x, END_ID], np.uint32) for x in encode(pc.fill_null(part.column(1), "").to_pylist())]
                docs.extend(zip(part.column(0).to_pylist(), ids, strict=True))
                if len(docs) >= 2000 or at + 100 >= batch.num_rows:
                    yield table(list(packer.add(docs)), task)
                    docs = []
            release()
        yield table(list(packer.finish()), task)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
