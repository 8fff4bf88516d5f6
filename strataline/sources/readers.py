"""Readers for logs and analyzer outputs, with declared schemas, and writers that refuse to clobber."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.functions.sources import is_bot

CALL_EDGE = "lang string, resolution string, kind string, caller_symbol string, caller_citation string, callee_symbol string, callee_citation string, callsite_citation string"
CALLGRAPH = "dyn string, descr string, caller_sym string, caller_pkg string, caller_decl string, callsite string, callee_sym string, callee_pkg string, callee_decl string"


def json_lines(spark: SparkSession, path: str, schema: str, *, strict: bool = False) -> DataFrame:
    """One object a line; bad lines are dropped, or fail the read if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def callgraph(spark: SparkSession, path: str) -> DataFrame:
    """Nine tab-separated columns; shorter rows are skipped."""
    parts = F.split("value", "\t", -1)
    names = [x.split()[0] for x in CALLGRAPH.split(", ")]
    return spark.read.text(path).filter(F.size(parts) >= len(names)).select(*[parts[i].alias(n) for i, n in enumerate(names)])


def numstat(spark: SparkSession, path: str, marker: str = "@@", *, bots: bool = True, since: str | None = None) -> DataFrame:
    """file, commit_no, name, email, added, deleted, path from `marker<TAB>name<TAB>email` headers and numstat lines; - counts as 0.

    Without bots, commits of automatic committers are left out.
    since keeps commits whose header has a date (a fourth part) that isn't before it.
    A header holds for the lines below it. It is carried within a split of the file, and the last one of earlier splits
    into the lines before a split's first: no task sees more than its split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = lines.withColumn("head", F.col("line").startswith(marker))
    w = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumns({"own_no": F.sum(F.col("head").cast("int")).over(w), "own": F.last(F.when(F.col("head"), F.col("line")), ignorenulls=True).over(w)})
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy("file", "block").agg(F.count_if("head").alias("n"), F.max_by("line", F.when(F.col("head"), F.col("at"))).alias("last"))
    before = ends.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("no_before"), F.last("last", ignorenulls=True).over(earlier).alias("before"))
    held = own.join(before, ["file", "block"]).withColumns({"commit_no": F.col("own_no") + F.col("no_before"), "header": F.coalesce("own", "before")})
    part, head = F.split("line", "\t"), F.split("header", "\t")
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    rows = held.filter(~F.col("head") & (F.size(part) == 3) & F.col("header").isNotNull())
    if not bots:
        rows = rows.filter(~is_bot(head[1], head[2]))
    if since:
        rows = rows.filter(F.try_to_timestamp(F.get(head, F.lit(3))) >= F.lit(since).cast("timestamp"))
    return rows.select("file", "commit_no", head[1].alias("name"), head[2].alias("email"), number(part[0]).alias("added"), number(part[1]).alias("deleted"), renamed(part[2]).alias("path"))


def renamed(path):
    """The new path of `a/{old => new}/b` or `old => new`."""
    braces = F.regexp_replace(F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1"), "//", "/")
    return F.when(path.contains("{") & path.contains(" => "), braces).when(path.contains(" => "), F.element_at(F.split(path, " => "), -1)).otherwise(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Files cut at each closing brace, in the order of each split: file, split, text without its brace.

    For each piece what it does to a reader that is outside strings at its begin, and to one inside: whether
    it ends inside, and by how much it changes the depth of braces.
    """
    meta = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size")
    text = spark.read.option("lineSep", "}").text(path).select(*meta, "value")
    # without escaped characters each quote begins or ends a string
    plain = text.withColumn("plain", F.regexp_replace("value", r"(?s)\\.", ""))
    odd = (F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit("")))) % 2
    outside = lambda c: F.regexp_replace(c, r'"[^"]*(?:"|$)', "")
    opened = lambda c: F.length(c) - F.length(F.replace(c, F.lit("{"), F.lit("")))
    depth = lambda c, inside: opened(c) - F.when(inside, 0).otherwise(1)
    return plain.select("file", "block", "size", "value", odd.alias("odd"), depth(outside(F.col("plain")), odd == 1).alias("from_outside"), depth(outside(F.regexp_replace("plain", r'^[^"]*(?:"|$)', "")), odd == 0).alias("from_inside"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Batches cut where a split ends, with their split; a task reads its splits one after the other."""
    for batch in batches:
        # a split's rows stand together, so its file changes only where its begin or its file does
        files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        codes = files.indices.to_numpy()
        at = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1), len(blocks)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if a < b:
                yield (files.dictionary[int(codes[a])].as_py(), int(blocks[a])), batch.slice(a, b - a)


def _steps(batch: pa.RecordBatch, odds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotes up to each piece's end, and what the piece does to the depth if the split begins outside (0) or inside (1) a string."""
    odd, outside, inside = (batch.column(name).to_numpy().astype(np.int64) for name in ("odd", "from_outside", "from_inside"))
    total = odds + np.cumsum(odd)
    before = (total - odd) % 2
    return total, np.where(before == 0, outside, inside), np.where(before == 1, outside, inside)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split."""
    names = ["file", "block", "size", "odds", "sum0", "sum1", "bytes", "n"]
    row = lambda split, held: pa.RecordBatch.from_pylist([dict(zip(names, (*split, *held), strict=True))])
    now, held = None, [0] * 6
    for split, batch in _by_split(batches):
        if split != now:
            if now:
                yield row(now, held)
            now, held = split, [batch.column("size")[0].as_py(), 0, 0, 0, 0, 0]
        total, step0, step1 = _steps(batch, held[1])
        held = [held[0], int(total[-1]), held[2] + int(step0.sum()), held[3] + int(step1.sum()), held[4] + int(batch.column("bytes").to_numpy().sum()), held[5] + batch.num_rows]
    if now:
        yield row(now, held)


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts up to each cut of a split, and what is left after the last one; head: begun in an earlier split, closed: ends with a cut."""
    names = ["file", "block", "i", "head", "closed", "text"]

    def rows(split, first: int, head: bool, texts: list[str], closed: bool) -> pa.RecordBatch:
        n = len(texts)
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        values = ([split[0]] * n, [split[1]] * n, range(first, first + n), [head and first + k == 0 for k in range(n)], [closed] * n, texts)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    now, state, depth, odds, seen, done, head, rest = None, 0, 0, 0, 0, 0, False, []
    for split, batch in _by_split(batches):
        if split != now:
            if rest:
                yield rows(now, done, head, ["}".join(rest)], False)
            state, depth = (batch.column(name)[0].as_py() for name in ("state", "depth"))
            now, odds, seen, done, head, rest = split, 0, 0, 0, state != 0 or depth != 0, []
        total, *steps = _steps(batch, odds)
        after = depth + np.cumsum(steps[state])
        cut = (after == 0) & ((state + total) % 2 == 0)
        if batch.column("cut_off")[0].as_py() and seen + batch.num_rows == batch.column("n")[0].as_py():
            cut[-1] = False  # the brace of a file's last piece is missing
        odds, depth, seen = int(total[-1]), int(after[-1]), seen + batch.num_rows
        values, texts, begin = batch.column("value").to_pylist(), [], 0
        for end in np.flatnonzero(cut):
            texts.append("}".join([*rest, *values[begin : end + 1]]))
            rest, begin = [], end + 1
        rest += values[begin:]
        if texts:
            yield rows(now, done, head, texts, True)
            done += len(texts)
    if rest:
        yield rows(now, done, head, ["}".join(rest)], False)


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects written one after the other, with or without white space between: cut where a brace closes the outermost object, outside strings.

    Files are read in splits. Whether a piece begins inside a string, and at which depth, follows from sums: within a split by a running
    sum for either state at its begin, and over splits from one row for each. So rows are the same for any cutting, work is
    linear, and no task holds more than a batch of its split's pieces and one object. A split's pieces stay in the task that reads them; only
    objects that cross splits are put together by a shuffle. Objects that can't be read, and one that the end of
    a file cuts off, are left out; rows come in the order of the files. (Of a compressed file, whose length isn't known, a last
    object that lacks only its last brace is read.)
    """
    pieces, split = _pieces(spark, path), ["file", "block"]
    sums = pieces.select("file", "block", "size", "odd", "from_outside", "from_inside", (F.octet_length("value") + 1).alias("bytes"))
    ends = sums.mapInArrow(_ends, "file string, block long, size long, odds long, sum0 long, sum1 long, bytes long, n long")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.withColumn("state", F.coalesce(F.sum("odds").over(earlier), F.lit(0)) % 2)
    # bytes without the brace that a file's last piece may lack
    whole = F.sum("bytes").over(Window.partitionBy("file")) <= F.col("size")
    final = F.col("block") == F.max("block").over(Window.partitionBy("file"))
    begins = begins.withColumns({"step": F.when(F.col("state") == 0, F.col("sum0")).otherwise(F.col("sum1")), "cut_off": final & ~whole & ~F.col("file").rlike(r"\.(gz|bz2|zst|zstd|snappy|lz4|deflate)$")})
    begins = begins.select(*split, "state", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("depth"), "cut_off", "n")
    # a row for each split, sent to all tasks, so that pieces keep their order
    texts = pieces.drop("size").join(F.broadcast(begins), split).mapInArrow(_objects, "file string, block long, i long, head boolean, closed boolean, text string")
    # what crosses splits: at most two rows for each; a text belongs to what was open before it
    crossing = texts.filter("head OR NOT closed").withColumn("no", F.coalesce(F.count_if("closed").over(Window.partitionBy("file").orderBy("block", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = crossing.groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("block", "i", "text"))).alias("parts"), F.max("closed").alias("closed")).filter("closed")
    joined = joined.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["i"].alias("i"), F.array_join(F.col("parts")["text"], "}").alias("text"))
    objects = texts.filter("NOT head AND closed").select("file", "block", "i", "text").unionByName(joined)
    return objects.select("file", "block", "i", F.from_json(F.concat("text", F.lit("}")), schema).alias("o")).filter("o is not null").orderBy("file", "block", "i").select("o.*")


def clone_pairs(spark: SparkSession, path: str) -> DataFrame:
    """format, span, a_file, a_from, a_to, b_file, b_from, b_to from a header and two location lines."""
    begin = "Clone found"  # as the end of records, so that large reports are read in splits
    pattern = r"^ \(([^)]*)\)[^\n]*\n\s*-?\s*(\S+) \[(\d+):\d+ - (\d+):\d+\][^\n]*\n\s*-?\s*(\S+) \[(\d+):\d+ - (\d+):\d+\]"
    found = spark.read.option("lineSep", begin).text(path).select(F.regexp_extract("value", pattern, 0).alias("m")).filter("m <> ''")
    group = lambda i: F.regexp_extract("m", pattern, i)
    rows = found.select(group(1).alias("format"), group(2).alias("a_file"), group(3).cast("int").alias("a_from"), group(4).cast("int").alias("a_to"), group(5).alias("b_file"), group(6).cast("int").alias("b_from"), group(7).cast("int").alias("b_to"))
    return rows.withColumn("span", F.col("a_to") - F.col("a_from"))


def section(lines: DataFrame, at: str, line: str, header: str) -> DataFrame:
    """Rows of one text between a header and the next blank line (lines: one file's numbered lines)."""
    begin = lines.filter(F.col(line) == header).agg(F.min(at).alias("_from"))
    after = lines.crossJoin(F.broadcast(begin)).filter(F.col(at) > F.col("_from"))
    end = after.filter(F.trim(line) == "").agg(F.min(at).alias("_to"))
    return after.crossJoin(F.broadcast(end)).filter(F.col("_to").isNull() | (F.col(at) < F.col("_to"))).drop("_from", "_to")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, extension of all files below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"))


def write_once(df: DataFrame, path: str) -> None:
    """Fails if the path exists."""
    df.write.mode("errorifexists").parquet(path)


def write_sorted_lines(df: DataFrame, path: str) -> None:
    """Distinct rows as JSON lines in the total order of all columns: range partitioned, so part files concatenate in order."""
    df.distinct().orderBy(*df.columns).write.mode("errorifexists").json(path)
