"""Quality rules: suffix-array repetition, beside counts of symbols, repeated lines and words.

For every text a suffix array over its words is built by prefix doubling. Neighbours in suffix
order share their longest common prefix, so the longer prefix a suffix shares with either
neighbour is the longest repeated substring that starts there; these are the maximal members of
the longest-common-prefix intervals. The spans of at least ``min_repeat`` words are united, and a
text fails if they cover too large a fraction of its words or if one of them is too long.

A text's rows never leave its task: no shuffle, memory bounded by one Arrow batch (or one longer
text). Nulls count as empty texts; texts without words fail; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.text_arrays import Texts, chunks, mix, release

SYMBOLS = b"[#*$%&|<>]"[1:-1]

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "covered_words long, longest_repeat long"
)


def longest_repeats(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word, the length in words of the longest substring that starts there and occurs
    again in the same text. words: hashes; words of text i are offsets[i] to offsets[i + 1].

    A rank is the number of smaller suffixes, so suffixes with equal first words share one. Each
    round sorts only suffixes that still share theirs, by the rank of what follows the compared
    words, and doubles the width.
    """
    n = len(words)
    found = np.zeros(n, np.int64)
    if n < 2:
        return found
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    keys = mix(words + text * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    active, keys = order, keys[order]
    past = n  # ranks[past]: after the last word
    ranks = np.full(n + 1, -1, np.int64)
    before = np.zeros(n, np.int64)
    levels, width = [], 1
    place = np.arange(n)
    while True:
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        old = np.concatenate(([True], before[1:] != before[:-1]))
        index = np.arange(len(active))
        group = np.maximum.accumulate(np.where(new, index, 0))
        ranks = ranks.copy()
        ranks[active] = before + group - np.maximum.accumulate(np.where(old, index, 0))
        order[place] = active
        levels.append(ranks)
        alone = new & np.concatenate((new[1:], [True]))
        active, place = active[~alone], place[~alone]
        if not len(active):
            break
        before = ranks[active]
        following = active + width
        keys = before.astype(np.uint64) << np.uint64(32) | (ranks[np.minimum(following, past)] + 1).astype(np.uint64)
        width *= 2
        by = np.argsort(keys, kind="stable")
        active, keys = active[by], keys[by]
        before = before[by]
    # Longest common prefix of neighbours in suffix order, by halving widths.
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[pairs], order[pairs + 1]
    length = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        at, to = np.minimum(a + length, past), np.minimum(b + length, past)
        length += (1 << level) * ((levels[level][at] == levels[level][to]) & (at < past) & (to < past))
    with_next = np.zeros(n + 1, np.int64)
    with_next[pairs + 1] = length
    found[order] = np.maximum(with_next[:-1], with_next[1:])
    return found


def _cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """Which keys have an equal one, and which have an equal one earlier."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[1:] = keys[order][1:] == keys[order][:-1]
    both, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = again
    both[order] = again | np.concatenate((again[1:], [False])) if len(keys) else again
    return np.stack((both, later))


_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def measures(t: Texts, min_repeat: int) -> dict[str, np.ndarray]:
    """All counts of some texts, one value for each text."""
    words, offsets = t.words(), t.word_offsets
    salt = t.word_texts().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = {"n_words": t.n_words.astype(np.int64), "word_chars": t.count(t.inside & ((t.data & 0xC0) != 0x80)), "n_symbols": t.count(_IS_SYMBOL[t.data])}

    # lines: from each begin to the next \n or the end of the text
    ends = t.data == 10
    begins = np.unique(np.concatenate((t.offsets[:-1], np.flatnonzero(ends) + 1)))
    begins = begins[begins < len(t.data)]
    line_text = np.searchsorted(t.offsets, begins, "right") - 1
    breaks = np.concatenate((np.flatnonzero(ends), [len(t.data)]))
    line_ends = np.minimum(breaks[np.searchsorted(breaks, begins)], t.offsets[1:][line_text])
    inside = np.concatenate(([0], np.cumsum(t.inside)))
    full = inside[line_ends] > inside[begins]
    begins, line_ends, line_text = begins[full], line_ends[full], line_text[full]
    _, later = _seen_before(mix(t.hashes(begins, line_ends) + line_text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    out["n_dup_lines"] = np.bincount(line_text[later], minlength=t.n)

    # words in windows of three that occur twice or more in the text
    n = len(words)
    covered = np.zeros(n, bool)
    if n >= 3:
        own = np.flatnonzero((t.word_texts()[2:] == t.word_texts()[:-2]))
        window = mix(words[own] + np.uint64(3) * mix(words[own + 1]) + np.uint64(7) * mix(words[own + 2] + np.uint64(1)) + salt[own])
        both, _ = _seen_before(window)
        covered = _cover(own[both], np.full(int(both.sum()), 3), n)
    out["n_repeat_words"] = _per_text(covered, offsets)

    repeats = longest_repeats(words, offsets)
    at = np.flatnonzero(repeats >= min_repeat)
    out["covered_words"] = _per_text(_cover(at, repeats[at], n), offsets)
    longest = np.zeros(t.n, np.int64)
    np.maximum.at(longest, t.word_texts(), repeats)
    out["longest_repeat"] = longest
    return out


MIN_REPEAT, MAX_COVERED, MAX_LONGEST, LONGEST_FLOOR = 8, 0.4, 0.2, 50


def verdicts(texts: pa.Array, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, longest_floor: int = LONGEST_FLOOR) -> dict[str, np.ndarray]:
    """The counts of some texts with base_failed and kept.

    A text is kept if it has at least 50 words, at most half of them in repeated three-word
    windows, at most max_covered of them in repeated substrings of min_repeat words or more, and
    no repeated substring longer than both longest_floor words and max_longest of the text.
    """
    parts = [measures(t, min_repeat) for t in chunks(texts)] or [measures(Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), 0), min_repeat)]
    m = {k: np.concatenate([p[k] for p in parts]).astype(np.int64) for k in parts[0]}
    n = m["n_words"]
    m["base_failed"] = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
    m["kept"] = ~m["base_failed"] & (m["covered_words"] <= max_covered * n) & (m["longest_repeat"] <= np.maximum(longest_floor, max_longest * n))
    return m


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """One row for each row of docs, in SCHEMA; limits are those of verdicts()."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            columns = {k: pa.array(v) for k, v in verdicts(batch.column(1), **limits).items()} | {"doc_id": batch.column(0)}
            yield pa.RecordBatch.from_arrays([columns[k] for k in names], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, SCHEMA)


def good_documents(docs: DataFrame, *, text_col: str = "text", **limits: float) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # in parts: a batch of whole documents and its copy would be large
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array(verdicts(part.column(text_col), **limits)["kept"]))
            release()

    return docs.mapInArrow(rows, docs.schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
