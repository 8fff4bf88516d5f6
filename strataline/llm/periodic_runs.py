"""Runs of repeated words: stretches with a period that occurs three times or more.

A run is a stretch of consecutive words in which words a period apart are identical, of at least
``min_length`` words and ``min_exponent`` periods, that no neighbouring word extends. Its words but the
first period repeat what was said, and are left out of the collapsed text.

Repeated k-gram masking: a run of length L and period q overlaps itself by L - q words, so each of its
words lies in a k-gram that the text has again, for any k up to the least overlap that the limits allow
(16 for 24 words and three periods). Words outside such k-grams cannot join a run. The stretches left
are searched with Main and Lorentz's division: a run of at least three periods that crosses the middle
of a block holds more than a period on one side of it, so for each period the words at and one period
from the middle must agree, and the run follows from the longest agreement to both sides. All blocks
of a size, of all texts of a slice, are searched at once; agreements are lengthened by halving
steps, compared by two hashes of 31 bits. The least period of a stretch is the smallest one found for it.

A text's words never leave its task: no shuffle, memory bounded by a slice of a few megabytes (or one
longer text), work n log n in a text's repeated words whatever they are. A null or empty text has no runs and an
empty collapsed text; a null id stays null; repeated rows give repeated results; an empty table gives
an empty result; other columns are ignored. Of runs with equal exponents the first is the strongest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.text_arrays import Texts, chunks, mix, slices

MIN_LENGTH, MIN_EXPONENT = 24, 3

SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

#: Two primes under 2**31 and a base for each: products fit into 62 bits.
_FIELDS = ((2147483647, 1103515245), (2147483629, 1812433253))


def least_overlap(min_length: int, min_exponent: int) -> int:
    """The fewest words by which a run can overlap itself one period on."""
    q = min_length // min_exponent
    return min(min_length - q, (min_exponent - 1) * (q + 1))


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k words in a row, put together from powers of two."""
    found, width, level, step = None, 0, words, 1
    while width < k:
        if k & step:
            n = len(words) - width - step + 1
            found = level[:n] if found is None else mix(found[:n] * np.uint64(3) + mix(level[width : width + n]))
            width += step
        n = len(level) - step
        level, step = mix(level[: max(n, 0)] * np.uint64(3) + mix(level[step:])), step * 2
    return found


def repeated(words: np.ndarray, texts: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in k words in a row that their text has twice or more. words: hashes; texts: each word's text."""
    n = len(words)
    steps = np.zeros(n + 1, np.int64)
    if n > k:
        at = np.flatnonzero(texts[k - 1 :] == texts[: n - k + 1])
        keys = mix(_grams(words, k)[at] + texts[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = np.concatenate(([False], keys[order][1:] == keys[order][:-1]))[: len(at)]
        again = at[order[same | np.concatenate((same[1:], [False]))[: len(at)]]]
        np.add.at(steps, again, 1)
        np.add.at(steps, again + k, -1)
    return np.cumsum(steps[:-1]) > 0


class Agreements:
    """How far words agree with those some way on."""

    def __init__(self, words: np.ndarray, longest: int):
        self.words, self.steps = words, [1 << b for b in reversed(range(max(longest, 1).bit_length()))]
        self.fields = []
        for prime, base in _FIELDS:
            powers = np.ones(1, np.int64)
            while len(powers) <= len(words):
                powers = np.concatenate((powers, powers * pow(base, len(powers), prime) % prime))
            sums = np.zeros(len(words) + 1, np.int64)
            np.cumsum((words % np.uint64(prime)).astype(np.int64) * powers[: len(words)] % prime, out=sums[1:])
            self.fields.append((prime, powers, sums % prime))

    def _equal(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether n words from a and from b (a < b) are the same."""
        out = np.ones(len(a), bool)
        for prime, powers, sums in self.fields:
            out &= (sums[a + n] - sums[a]) % prime * powers[b - a] % prime == (sums[b + n] - sums[b]) % prime
        return out

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on (a < b)."""
        length = np.zeros(len(a), np.int64)
        for step in self.steps:
            on = np.flatnonzero(b + length + step <= len(self.words))
            on = on[self._equal(a[on] + length[on], b[on] + length[on], step)]
            length[on] += step
        return length

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b (a < b)."""
        length = np.zeros(len(a), np.int64)
        for step in self.steps:
            on = np.flatnonzero(a - length - step >= 0)
            on = on[self._equal(a[on] - length[on] - step, b[on] - length[on] - step, step)]
            length[on] += step
        return length


def runs_of(words: np.ndarray, longest: int, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs in a sequence in which none is longer than longest."""
    n, found = len(words), []
    reach = Agreements(words, longest)
    half = 1
    while half < n:
        most = min(2 * half, longest) // min_exponent
        if 2 * half >= min_length and most:
            middles = np.arange(half, n, 2 * half)
            # blocks times periods, some at a time
            for low in range(1, most + 1, max(1, (4 << 20) // len(middles))):
                periods = np.arange(low, min(most + 1, low + max(1, (4 << 20) // len(middles))))
                mid, p = (x.ravel() for x in np.broadcast_arrays(middles[:, None], periods[None, :]))
                for a in (mid, mid - p):
                    ok = (a >= 0) & (a + p < n) if a is mid else a >= 1
                    at = np.flatnonzero(ok)
                    # of a run with more than a period to one side of the middle, these agree
                    at = at[words[a[at]] == words[a[at] + p[at]]] if a is mid else at[words[a[at] - 1] == words[mid[at] - 1]]
                    first, q = a[at], p[at]
                    start, end = first - reach.backward(first, first + q), first + q + reach.forward(first, first + q)
                    full = end - start >= np.maximum(min_length, min_exponent * q)
                    found.append((start[full], end[full], q[full]))
        half *= 2
    start, end, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))[: len(start)]
    start, end, q = start[least], end[least], q[least]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def find_runs(t: Texts, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of some texts, by start and period; starts count the words of all of them."""
    words, texts = t.words(), t.word_texts()
    mask = repeated(words, texts, least_overlap(min_length, min_exponent))
    # stretches of such words that lie in one text
    edge = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (texts[1:] != texts[:-1]), [True]))) if len(words) else np.zeros(1, np.int64)
    begin, size = edge[:-1], np.diff(edge)
    keep = mask[begin] & (size >= min_length)
    begin, size = begin[keep], size[keep]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3
    # side by side, a value of its own after each
    place = np.concatenate(([0], np.cumsum(size + 1)))
    within = np.arange(place[-1]) - np.repeat(place[:-1], size + 1)
    at = np.repeat(begin, size + 1) + within
    joined = np.where(within == np.repeat(size, size + 1), mix(np.arange(place[-1], dtype=np.uint64)), words[np.minimum(at, len(words) - 1)])
    start, end, period = runs_of(joined, int(size.max()), min_length, min_exponent)
    return at[start], end - start, period


def _described(t: Texts, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of each text."""
    start, length, period = find_runs(t, min_length, min_exponent)
    steps = np.zeros(len(t.starts) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    keep = np.cumsum(steps[:-1]) == 0
    raw, collapsed = t.data.tobytes(), []
    for a, b, low, high in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), t.word_offsets[:-1].tolist(), t.word_offsets[1:].tolist(), strict=True):
        words = raw[a:b].split()  # by the six separators, as in Texts
        some = keep[low:high]
        collapsed.append(b" ".join(words if some.all() else [words[i] for i in np.flatnonzero(some).tolist()]))
    text = np.searchsorted(t.word_offsets, start, "right") - 1
    items = pa.StructArray.from_arrays([pa.array(x) for x in (start - t.word_offsets[text], length, period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, t.word_offsets), pa.int32()), items)
    return runs, pa.array(collapsed, pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs its id, its runs by start and period (in words, from 0), and its text without their repetitions."""
    if min_exponent < 3 or min_length < min_exponent:
        raise ValueError("runs must have at least three periods")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for t in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), *_described(t, min_length, min_exponent)], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the first."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """What periodic_runs() found, as one line of numbers and digests for each row."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, where a tenth of the texts end in repetitions.

    By h, the crc32 of the id: if 10 divides it, the words from a = g % n on (g = h // 10, n words) repeat
    the p = 1 + (n - a) // (3 + g % 8) words from a, to the text's length.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    n = F.size("words").cast("long")
    at = split.select("*", n.alias("n"), F.when(n > 0, F.col("g") % n).alias("a")).select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    unit = F.slice("words", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    tail = F.flatten(F.array_repeat(unit, F.expr("(n - a) div p + 1").cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), F.lit(1), F.col("n").cast("int")), " ")
    return at.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
