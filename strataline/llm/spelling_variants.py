"""Spelling variants: words that one edit of a code point apart from each other, and the form each is a variant of.

Forward and reversed sorted dictionaries: one edit leaves a half of a word intact. Each word enters a
forward dictionary by its first half and a reversed one by its last half, for words of its own length
(replaced code points) and for words longer or shorter by one. Dictionaries are dealt out by ranges of their
sorted keys, so words that share a prefix (or suffix) stand side by side in one task, which scans its
range block by block. Skewed blocks are divided: of the part that isn't shared yet, again one half
is intact, so a block falls into blocks that share more of the prefix and blocks that share a suffix
too, until it is small or one place is left. Blocks of over ``block_rows`` words are divided by Spark
before the scan, smaller ones within it. Every pair belongs to one block, by where its words begin to differ, and is
verified on all code points; so no pair is found twice and none is missed.

No task holds more than a few blocks; counts of a frequent word are summed in each task first; a word
with very many variants is pre-aggregated likewise. Words of any length are compared whole.

Null texts have no words; null or empty words are none; of words given twice the counts add up. A null id deletes nothing.
Ties of counts go to the smaller word in the order of code points. A word without a near word has itself as root. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.storage import deleted, small_or_shuffled, written
from strataline.llm.text_arrays import mix, release

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: Rows of a block that one task may hold; rows scanned at once; rows of a block that are compared pair by pair.
BLOCK_ROWS, SCAN_ROWS, FEW = 4096, 40_000, 16
#: Longer words are compared one pair at a time.
WIDE = 64

#: A block: words that may pair with others of the same length (kind 0) or, where the shorter one has size code points, of one more (kind 1).
#: They share the first p and the last s code points; pairs differ first before code point cap. side and key: the dictionary and the place in it.
BLOCK = ["side", "kind", "size", "key"]
ENTRY = [*BLOCK, "p", "s", "cap", "word", "n"]


def _entries(words: DataFrame, min_chars: int) -> DataFrame:
    """Each word's places in both dictionaries."""
    size, half = F.length("word"), lambda n: F.ceil(n / 2).cast("int")
    roles = F.array(*(F.struct(F.lit(kind).alias("kind"), n.alias("size")) for kind, n in ((0, size), (1, size), (1, size - 1))))
    each = words.select("word", "n", F.explode(roles).alias("role")).select("word", "n", "role.*").filter(F.col("size") >= max(min_chars, 1))
    a, b = half(F.col("size")), (F.col("size") - half(F.col("size")) + F.col("kind")).cast("int")
    ahead = F.struct(F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), a).alias("key"), a.alias("p"), F.lit(0).alias("s"), (F.col("size") + 1).alias("cap"))
    back = F.struct(F.lit(1).alias("side"), F.substring(F.reverse("word"), F.lit(1), b).alias("key"), F.lit(0).alias("p"), b.alias("s"), a.alias("cap"))
    return each.select("*", F.explode(F.array(ahead, back)).alias("at")).select("at.side", "kind", "size", "at.key", "at.p", "at.s", "at.cap", "word", "n")


def _divided(entries: DataFrame) -> DataFrame:
    """The entries of large blocks, once for each half of what they don't share yet."""
    rest = F.col("size") - F.col("p") - F.col("s")
    a = F.ceil(rest / 2).cast("int")
    more = (rest - a + F.col("kind")).cast("int")
    ahead = F.struct(F.concat("key", F.lit("\0"), F.substring(F.col("word"), F.col("p") + 1, a)).alias("key"), (F.col("p") + a).alias("p"), F.col("s").alias("s"), F.col("cap").alias("cap"))
    back = F.struct(F.concat("key", F.lit("\1"), F.substring(F.reverse("word"), F.col("s") + 1, more)).alias("key"), F.col("p").alias("p"), (F.col("s") + more).alias("s"), (F.col("p") + a).alias("cap"))
    return entries.select("side", "kind", "size", "word", "n", F.explode(F.array(ahead, back)).alias("at")).select("side", "kind", "size", "at.key", "at.p", "at.s", "at.cap", "word", "n")


class Words:
    """Some words as code points."""

    def __init__(self, column: pa.Array):
        self.column, self.size = column, pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        places = np.arange(len(self.codes), dtype=np.uint64)
        # odd powers times a value for each code point: a sum over a part, divided by the power of its begin, tells parts apart
        self.powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(places), 0x9E3779B97F4A7C15, np.uint64))), dtype=np.uint64)
        self.inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(places), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))), dtype=np.uint64)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(self.codes.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], dtype=np.uint64)))
        short = self.size <= WIDE + 1
        self.table = np.zeros((len(self.size), int(self.size[short].max(initial=0)) + 2), np.uint32)
        row = np.repeat(np.arange(len(self.size)), self.size)
        column_at = np.arange(len(row)) - self.at[row]
        fits = short[row]
        self.table[row[fits], column_at[fits]] = self.codes[fits] + 1

    def parts(self, w: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of code points begin to end of the words w."""
        low, high = self.at[w] + begin, self.at[w] + end
        return mix((self.sums[high] - self.sums[low]) * self.inverse[low])

    def near(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """Which pairs (x not the longer) are one edit apart and differ first before cap."""
        out = np.zeros(len(x), bool)
        fits = self.size[y] <= WIDE + 1
        step = max(1, (8 << 20) // max(self.table.shape[1], 1))
        where = np.flatnonzero(fits)
        for k in range(0, len(where), step):
            on = where[k : k + step]
            a, b = self.table[x[on]], self.table[y[on]]
            differ = a != b
            first = np.argmax(differ, 1)
            # after the first difference: equal where replaced, equal to what is one further on where inserted
            replaced = differ.sum(1) == 1
            moved = a[:, :-1] != b[:, 1:]
            moved &= np.arange(moved.shape[1]) >= first[:, None]
            out[on] = np.where(kind[on] == 0, replaced, ~moved.any(1)) & (first < cap[on])
        for k in np.flatnonzero(~fits):
            a, b = (self.codes[self.at[w] : self.at[w + 1]] for w in (x[k], y[k]))
            first = int(np.argmax(np.append(a != b[: len(a)], True)))
            out[k] = first < cap[k] and first < len(b) and np.array_equal(a[first + 1 - kind[k] :], b[first + 1 :])
        return out


def near_pairs(words: Words, block: np.ndarray, kind: np.ndarray, size: np.ndarray, p: np.ndarray, s: np.ndarray, cap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of some entries (block: a number for each block) that are one edit apart."""
    w = np.arange(len(block))
    while len(w):
        order = np.lexsort((words.size[w], block))
        w, block, kind, size, p, s, cap = (x[order] for x in (w, block, kind, size, p, s, cap))
        edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        rows = np.repeat(np.diff(edge), np.diff(edge))
        rest = size - p - s
        whole = (rows <= FEW) | (rest <= 1 - kind)
        done = np.flatnonzero(whole & (rows > 1))
        last = np.repeat(edge[1:], np.diff(edge))
        for d in range(1, int(rows[done].max(initial=1))):
            done = done[done + d < last[done]]
            # shorter words come first in a block; of kind 1 both lengths are needed, of kind 0 there is one
            i = done[(words.size[w[done + d]] - words.size[w[done]] == kind[done])]
            i = i[words.near(w[i], w[i + d], kind[i], cap[i])]
            yield w[i], w[i + d]
        on = np.flatnonzero(~whole)
        w, block, kind, size, p, s, cap, rest = (x[on] for x in (w, block, kind, size, p, s, cap, rest))
        a = (rest + 1) // 2
        more = rest - a + kind
        ahead = mix(block + np.uint64(1)) ^ words.parts(w, p, p + a)
        back = mix(block + np.uint64(2)) ^ words.parts(w, words.size[w] - s - more, words.size[w] - s)
        w, block, kind, size = np.concatenate((w, w)), np.concatenate((ahead, back)), np.concatenate((kind, kind)), np.concatenate((size, size))
        p, s, cap = np.concatenate((p + a, p)), np.concatenate((s, s + more)), np.concatenate((cap, p + a))


def _scanned(entries: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, of entries sorted by block in each partition."""

    def pairs(held: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = held.combine_chunks().to_batches()[0]
        column = {x: whole.column(x) for x in ENTRY}
        number = {x: column[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("side", "kind", "size", "p", "s", "cap")}
        for i, j in near_pairs(Words(column["word"]), mix(_numbered(whole)), *(number[x] for x in ("kind", "size", "p", "s", "cap"))):
            for a, b in ((i, j), (j, i)):
                if len(a):
                    yield pa.RecordBatch.from_arrays([column["word"].take(pa.array(a)), column["word"].take(pa.array(b)), column["n"].take(pa.array(b))], ["word", "near", "near_n"])

    def _edges(batch: pa.RecordBatch) -> np.ndarray:
        """Which rows begin a block."""
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for x in BLOCK:
            c = batch.column(x)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return new

    def _numbered(batch: pa.RecordBatch) -> np.ndarray:
        return np.cumsum(_edges(batch)).astype(np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < SCAN_ROWS and sum(x.nbytes for x in held) < 32 << 20:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(_edges(whole))[-1])
            if last:  # the last block may go on
                yield from pairs(pa.Table.from_batches([whole.slice(0, last)]))
            held = [whole.slice(last)]
            release()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return entries.mapInArrow(scan, "word string, near string, near_n long")


def near_words(words: DataFrame, *, min_chars: int = MIN_CHARS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """(word, near, near_n) for each ordered pair of distinct words (word, n) one edit apart, and the tables to delete when it was read."""
    now, small, old = _entries(words, min_chars), [], []
    while True:
        sizes = now.filter(F.col("size") - F.col("p") - F.col("s") > 1 - F.col("kind")).groupBy(*BLOCK).count()
        large = written(sizes.filter(F.col("count") > block_rows).drop("count"), "large-blocks")
        old.append(large)
        if large.isEmpty():
            small.append(now)
            break
        keys = small_or_shuffled(large)
        small.append(now.join(keys, BLOCK, "left_anti").select(ENTRY))
        now = written(_divided(now.join(keys, BLOCK, "left_semi")), "block-halves")
        old.append(now)
    dealt = reduce(DataFrame.unionByName, small).repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK)
    return _scanned(dealt.select(ENTRY)), old


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): the last form that a word leads to. Each round goes twice as far."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("on")), "roots")
    while not now.filter("on").isEmpty():
        ahead = small_or_shuffled(now.select(F.col("word").alias("root"), F.col("root").alias("next")), now)
        after = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        deleted(now)
        now = after
    return now


def spelling_variants(words: DataFrame, *, ratio: float = RATIO, min_chars: int = MIN_CHARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each distinct word of (word, n) of at least min_chars code points.

    Near words differ by one inserted, deleted or replaced code point. form: the near word of largest n,
    if that n is at least ratio times the word's own. root: where following forms ends.
    """
    counted = words.filter((F.length("word") >= max(min_chars, 1)) & F.col("n").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted, "words")
    pairs, old = near_words(counted, min_chars=min_chars, block_rows=block_rows)
    # a word's own row and those of its near words meet in one aggregation
    rows = counted.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).unionByName(pairs.select("word", F.lit(None).cast("long").alias("n"), "near", "near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    merged = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    near = written(merged.select("word", "n", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")), "near-words")
    deleted(*old)
    forms = near.filter("best IS NOT NULL").select("word", F.col("best.near").alias("form"))
    roots = _roots(forms)
    out = near.join(roots.select("word", "root").hint("merge"), "word", "left")
    return out.select("word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n"))


def folded(word: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(word)


def letter_runs(docs: DataFrame, *, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run) for each maximal run of at least min_chars letters A-Z, a-z and U+00C0 to U+00FF, folded."""
    pattern = rf"([A-Za-zÀ-ÿ]{{{min_chars},}})"
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(pattern), F.lit(1))).alias("run"))
    return runs.select("doc_id", folded(F.col("run")).alias("run"))


def with_typos(runs: DataFrame) -> DataFrame:
    """(word) of (doc_id, run): where 31 divides h, the crc32 of "doc_id:run", without code point h % length."""
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("doc_id").isNotNull() & (h % 31 == 0), shorter).otherwise(F.col("run")).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = with_typos(letter_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    counts = words.filter(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)
    return spelling_variants(counts)


ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY b) AS steps FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(b))
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS x FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT doc_id, run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h FROM counted, steps
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN doc_id IS NOT NULL AND h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS go FROM forms
  UNION ALL SELECT k.word, f.form, true FROM walk k JOIN forms f ON k.root = f.word WHERE k.go AND f.form IS NOT NULL
), roots AS (SELECT k.word, k.root FROM walk k JOIN forms f ON k.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
