"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A text (white space runs replaced by one space) is cut into blocks of ``block_chars`` characters.
Grouping the blocks of a position by their content brings equal ones together, and each distinct
block gets an integer name: the smallest number of a document that has it there. Then adjacent
pairs of names are named in the same way, level by level, until every document has one name. Names are integers taken from the data, so they don't depend on how rows are dealt out or on
a retry. Two documents have the same number of blocks and the same name if and only if all their
blocks are equal, so an identity has no collisions.

Each block's text is shuffled once, after copies within a task are merged. Occurrences find their
names through a 64-bit hash of the block; hashes that stand for two different blocks (none, in
practice) are found while naming, and occurrences with such a hash are looked up by their text.
Lookups are sort-merge joins, whose hot keys Spark splits at run time; naming pre-aggregates. So
one group of copies may hold any part of the rows.

Nulls count as empty texts, which are all equal. Rows with equal doc_id are rows of their own with
the same keep_id; a null doc_id is ordered last; of a group
without any id no row is marked as kept here, as none can be named (``distinct_documents`` keeps one). Extra columns are ignored (kept by ``distinct_documents``, whatever their names). An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.storage import deleted, small_or_shuffled, written

BLOCK_CHARS = 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(texts: DataFrame, size: int) -> DataFrame:
    """(row, n, text) to (row, n, pos, block). At least one block each; one pass cuts a text, whatever its length."""
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    return texts.select("row", "n", F.posexplode(cut).alias("pos", "block"))


def _named(occurrences: DataFrame, *content: str) -> DataFrame:
    """A name for each distinct content of a position: the smallest number of a row that has it."""
    return occurrences.groupBy("pos", *content).agg(F.min("row").alias("name"))


def _first_names(blocks: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(row, n, pos, name) of every block, and the tables to delete later."""
    hashed = blocks.withColumn("h", F.xxhash64("pos", "block"))
    names = _named(blocks, "block").select(F.xxhash64("pos", "block").alias("h"), "name")
    by_hash = written(names.groupBy("h").agg(F.min("name").alias("name"), F.count("*").alias("contents")), "block-names")
    found = hashed.drop("block").join(by_hash.filter("contents = 1").hint("merge").drop("contents"), "h").drop("h")
    clashing = by_hash.filter("contents > 1")
    if not clashing.isEmpty():
        texts = hashed.join(clashing.select("h").hint("merge"), "h", "left_semi").drop("h")
        found = found.unionByName(texts.join(_named(texts, "block").hint("merge"), ["pos", "block"]).drop("block"))
    return written(found, "block-level"), [by_hash]


def identities(texts: DataFrame, size: int = BLOCK_CHARS) -> tuple[DataFrame, list[DataFrame]]:
    """(row long, text) to (row, n, name): (n, name) is equal where the texts are equal."""
    sized = texts.withColumn("n", F.greatest(F.ceil(F.length("text") / size), F.lit(1)).cast("int"))
    level, old = _first_names(_blocks(sized, size))
    done = []
    width = 1
    while True:
        # documents whose blocks have become one name leave the recursion
        done.append(level.filter(F.col("n") <= width).select("row", "n", "name"))
        rest = level.filter(F.col("n") > width)
        old.append(level)
        if rest.isEmpty():
            break
        half = F.shiftright("pos", 1)
        pairs = rest.groupBy("row", "n", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = written(pairs, "block-pairs")
        old.append(pairs)
        names = written(_named(pairs, "a", "b"), "pair-names")
        old.append(names)
        level = written(pairs.join(names.hint("merge"), ["pos", "a", "b"]).select("row", "n", "pos", "name"), "block-level")
        width *= 2
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out, old


def exact_dedup(docs: DataFrame, *, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    numbered = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col).cast("string")).alias("text"))
    # Numbers for the rows, whatever the ids are; writing them fixes them.
    rows = written(numbered.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), "text"), "dedup-texts")
    named, old = identities(rows.select("row", "text"), block_chars)
    named = written(named.join(rows.select("row", "doc_id", "text_sha256").hint("merge"), "row"), "dedup-identities")
    deleted(rows, *old)
    # written, so that the join has an exchange of its own on each side, whose hot keys Spark can split
    groups = written(named.groupBy("n", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-groups")
    joined = named.join(groups.hint("merge"), ["n", "name"])
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others), one of each group of equal texts: that with the smallest id."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("doc")), "dedup-documents")
    named, old = identities(rows.select("row", normalised(F.col("doc.text").cast("string")).alias("text")))
    ids = written(named.join(rows.select("row", "doc_id").hint("merge"), "row"), "dedup-identities")
    deleted(*old)
    # a null id is the last of its group
    first = ids.groupBy("n", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("first"))
    dropped = written(ids.select("row").join(first.select("first.row").hint("merge"), "row", "left_anti"), "dedup-dropped")
    deleted(ids)
    return rows.join(small_or_shuffled(dropped), "row", "left_anti").select("doc.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
