"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, fullwidth) and digits or signs used as letters, and turns what separates words
into single spaces. Entries are whole words or word beginnings; their weights are the
log odds of toxic labels among training documents that contain them. Hits inside an exception
phrase don't count: phrases given by the caller, and two-word phrases around an entry that
training documents use mostly harmlessly. Of learnt entries and phrases the ``MAX_ENTRIES`` with the most
evidence are kept: weight times the root of the toxic documents, and harmless documents. The score is a logistic function of the weight found,
of its density per 100 words and of the strongest hit, fitted on the same training rows.

Only a bounded sample of labelled rows is learnt from: the ``max_train`` labels with the smallest
hashes of their ids. Scoring is one pass over whole texts with no shuffle. Null and empty texts
get the score of a text without hits; repeated rows are scored again, a null id is not held out, extra
columns are ignored, an empty table gives no rows. Work is linear in a text's length but for sorting its hits. Label rows with nulls are ignored; with no usable labels
every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.storage import deleted, written

# Cyrillic and Greek letters that look like Latin ones, and digits used for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x"} | {
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: Used for letters only before another one.
SIGNS = {"$": "s", "@": "a"}

#: Labelled rows to learn from at most, entries of the lexicon at most, the least number of training documents with an entry, and its least weight.
MAX_TRAIN, MAX_ENTRIES, MIN_DOCUMENTS, MIN_WEIGHT = 12_000, 4096, 10, 2.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

FULLWIDTH = {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
FOLDS = HOMOGLYPHS | DIGITS | FULLWIDTH
_FOLD_TABLE = str.maketrans(FOLDS)
_SIGN_TABLES = [(re.compile(rf"{re.escape(a)}(?=[^\W\d_])"), b) for a, b in SIGNS.items()]
_SEPARATORS = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The folded words of a text in one string, a single space around each."""
    text = text.lower().translate(_FOLD_TABLE)
    for sign, (pattern, letter) in zip(SIGNS, _SIGN_TABLES, strict=True):
        if sign in text:
            text = pattern.sub(letter, text)
    return f" {_SEPARATORS.sub(' ', text)} "


def folded_words(text: Column) -> Column:
    """The same words as an array, on the JVM, for learning."""
    plain = F.translate(F.lower(text), "".join(FOLDS), "".join(FOLDS.values()))
    for sign, letter in SIGNS.items():
        plain = F.regexp_replace(plain, rf"\{sign}(?=\p{{L}})", letter)
    return F.filter(F.split(plain, r"[^\p{L}\p{M}]+"), lambda w: w != "")


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    coefficients: list[float]


def _features(lexicon: Lexicon):
    """text to (weight of distinct hits, weight per 100 words, strongest hit)."""
    automaton = ahocorasick.Automaton()
    for entry, weight in lexicon.weights.items():
        automaton.add_word(entry, (len(entry), weight))
    for phrase in lexicon.exceptions:
        automaton.add_word(phrase, (len(phrase), None))
    empty = not len(automaton)
    if not empty:
        automaton.make_automaton()

    def of(text: str) -> tuple[float, float, float]:
        if empty or not text:
            return 0.0, 0.0, 0.0
        line = fold(text)
        hits: dict[int, tuple[float, int]] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(line):
            start = end - length + 1
            if weight is None:
                excused.append((start, end))
            elif weight > hits.get(start, (0.0, 0))[0]:
                hits[start] = weight, end
        if excused:
            # both in order of their begins: reach is the furthest end of the phrases that have begun
            left, reach, excused = {}, -1, deque(sorted(excused))
            for s in sorted(hits):
                while excused and excused[0][0] <= s:
                    reach = max(reach, excused.popleft()[1])
                if s + 1 >= reach:
                    left[s] = hits[s]
            hits = left
        if not hits:
            return 0.0, 0.0, 0.0
        total = sum(w for w, _ in hits.values())
        distinct: dict[str, float] = {}
        for s, (w, _) in hits.items():
            word = line[s : line.index(" ", s + 1)]
            distinct[word] = max(w, distinct.get(word, 0.0))
        return sum(distinct.values()), 100 * total / max(line.count(" ") - 1, 20), max(distinct.values())

    return of


def _scale(x: np.ndarray) -> np.ndarray:
    """Features as the logistic function takes them: bounded growth, with a constant."""
    return np.column_stack((np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(x[:, 1]), x[:, 2] / 5))


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps with a small ridge."""
    x, b = _scale(x), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), x.T @ (y - p) - 0.1 * b)
    return b.tolist()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), max_train: int = MAX_TRAIN) -> Lexicon:
    """A lexicon and its calibration from docs (doc_id, text) and labels (doc_id, toxic)."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    usable = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # at most max_train rows of 12 bytes are broadcast
    train = written(docs.join(F.broadcast(sample), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "toxic"]), "toxicity-train")
    total, toxic = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == total:
        return Lexicon({}, [], [-30.0, 0.0, 0.0, 0.0])
    words = train.select("toxic", folded_words(F.col("text")).alias("w"))
    whole = F.transform("w", lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    begins = [F.transform(F.filter("w", lambda w, n=n: F.length(w) >= n), lambda w, n=n: F.concat(F.lit(" "), F.substring(w, 1, n))) for n in PREFIXES]
    pairs = F.transform(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.size("w")).alias("b")), lambda p: F.concat(F.lit(" "), p["a"], F.lit(" "), p["b"], F.lit(" ")))
    terms = words.select("toxic", F.explode(F.array_distinct(F.concat(whole, *begins, pairs))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= MIN_DOCUMENTS)
    base = math.log((toxic + 0.5) / (total - toxic + 0.5))
    weight = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5)) - base
    counts = written(counts.withColumn("weight", weight).withColumn("words", F.size(F.split(F.trim("term"), " "))), "toxicity-terms")
    top = counts.filter((F.col("words") == 1) & (F.col("weight") >= MIN_WEIGHT)).orderBy(F.desc(F.col("weight") * F.sqrt("t")), "term").limit(MAX_ENTRIES).collect()
    weights = {r["term"]: r["weight"] for r in top}
    # at most MAX_ENTRIES words are broadcast
    entries = docs.sparkSession.createDataFrame([(k.strip(),) for k in weights if k.endswith(" ")], "word string")
    harmless = counts.filter((F.col("words") == 2) & (F.col("weight") <= 0.5)).withColumn("word", F.explode(F.split(F.trim("term"), " "))).join(F.broadcast(entries), "word", "left_semi")
    harmless = harmless.groupBy("term").agg(F.max(F.col("n") - F.col("t")).alias("evidence")).orderBy(F.desc("evidence"), "term").limit(MAX_ENTRIES)
    learnt = [r["term"] for r in harmless.collect()]
    lexicon = Lexicon(weights, sorted({*learnt, *(fold(x) for x in exceptions)}), [])
    rows = train.mapInArrow(_rows(lexicon, ["toxic"]), "toxic int, x0 double, x1 double, x2 double").toPandas()
    lexicon.coefficients = _fit(rows[["x0", "x1", "x2"]].to_numpy(), rows["toxic"].to_numpy(float))
    deleted(train, counts)
    return lexicon


def _rows(lexicon: Lexicon, keep: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _features(lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = np.array([of(t) for t in pc.fill_null(part.column("text"), "").to_pylist()], float).reshape(-1, 3)
                columns = [part.column(k) for k in keep] + [pa.array(x[:, i]) for i in range(3)]
                names = [*keep, "x0", "x1", "x2"]
                if lexicon.coefficients:
                    score = 1 / (1 + np.exp(-np.clip(_scale(x) @ np.array(lexicon.coefficients), -30, 30)))
                    columns.append(pa.array(score))
                    names.append("score")
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows


def toxicity(docs: DataFrame, labels: DataFrame, *, exceptions: tuple[str, ...] = (), max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and lexicon_weight for each row of docs."""
    docs = _texts(docs, id_col, text_col)
    lexicon = learn(docs, labels, exceptions, max_train)
    scored = docs.mapInArrow(_rows(lexicon, ["doc_id"]), "doc_id long, x0 double, x1 double, x2 double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("x0").alias("lexicon_weight"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
