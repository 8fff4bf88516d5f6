"""Intermediate results, written once to the folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that of setCheckpointDir; only where both are unset in local mode (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and chosen.isDefined():
        folder = chosen.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: computed once, its lineage cut.

    The name is new each time, so a retried or repeated run never reads another run's rows.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of at most so many rows and so many bytes of files are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def _bytes(df: DataFrame) -> int:
    """The size of a written table's files."""
    spark, total = df.sparkSession, 0
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def small_or_shuffled(keys: DataFrame, part_of: DataFrame | None = None) -> DataFrame:
    """A written table of ids, or some rows of one (part_of), for a join: broadcast if its rows and bytes are few, else sort-merge joined."""
    whole = keys if part_of is None else part_of
    return F.broadcast(keys) if _bytes(whole) <= BROADCAST_BYTES and whole.count() <= BROADCAST_ROWS else keys.hint("merge")
