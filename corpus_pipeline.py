"""From raw documents to packed training sequences, in stages.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the next
stage's docs with the columns of documents, the last one the packed pieces. Each stage's rows are
written as Parquet and read again for the next.

Null and empty texts don't pass the quality rules. Of equal or near texts the row with the smallest id
stays (of equal ids, one row; a null id comes last; a text that has no id is compared for near copies with
nothing). Other columns are kept, whatever their names. No
documents give no pieces. A very long text stays whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataline.llm.exact_dedup import distinct_documents
from strataline.llm.minhash_dedup import one_of_each
from strataline.llm.packing import pack
from strataline.llm.pii import without_pii
from strataline.llm.quality_rules import good_documents
from strataline.llm.storage import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return good_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shared five-word shingles of 0.8 or more."""
    return one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return without_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("PII", private), ("packing", packing)]

#: Suffix arrays, boosted trees and a tokenizer have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
