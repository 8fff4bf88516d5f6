"""Tasks as state machines: what each event of a ledger does, on a stream or over a whole log.

An event has task, seq, event, digest, attempt and ok. Of a task only a few numbers are kept:

- ``created`` with the digest of the current generation changes nothing; with another it begins a generation.
- ``claimed`` begins an attempt, unless the task is unknown, done, failed for good, or has an attempt open.
- ``released`` and ``submitted`` need an open attempt with the number given (a null number means the open one). A
  submission that is ok ends the task; one that isn't counts as a failed attempt, and ``most_attempts`` of them as a final failure.
- ``cascaded`` says that a dependency failed for good.

Every event gives one row: accepted, unchanged or rejected with a reason, and the task's state after it. Nothing is
raised: a stream must go on. An event whose seq isn't greater than the last one of its task is rejected as stale, so
that a source that delivers again changes nothing. Events without a task or seq are rejected and belong to no task's state.

The same step serves both ways, so results are equal however a log is cut into batches. On a stream the state is
typed, in Spark's state store (it needs the RocksDB store); over a log, tasks are sorted and folded one event after
the other in constant memory, so that one task with very many events is no group held in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

MOST_ATTEMPTS = 3
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT = ["task", "seq", "event", "digest", "attempt", "ok"]
STATE = "seq long, generation long, digest string, attempts long, failed long, open boolean, done boolean, exhausted boolean, cascaded boolean"
RESULT = "task long, seq long, event string, outcome string, reason string, generation long, attempt long, state string"

_ROW = Row(*[x.split(" ")[0] for x in RESULT.split(", ")])

NONE = (-1, 0, None, 0, 0, False, False, False, False)


def step(state: tuple, event: str | None, seq: int | None, digest: str | None, attempt: int | None, ok: bool | None, most_attempts: int) -> tuple[tuple, str, str | None]:
    """The state after an event (in the order of STATE), what became of it, and why it was rejected."""
    last, generation, current, attempts, failed, is_open, done, exhausted, cascaded = state
    if seq is None or seq <= last:
        return state, "rejected", "stale"
    rest = (seq, *state[1:])
    if event == "created":
        if generation and digest == current:
            return rest, "unchanged", None
        return (seq, generation + 1, digest, 0, 0, False, False, False, False), "accepted", None
    if event not in ("claimed", "released", "submitted", "cascaded"):
        return rest, "rejected", "unknown event"
    if not generation:
        return rest, "rejected", "unknown task"
    if done or exhausted or cascaded:
        return rest, "rejected", "done" if done else "failed for good"
    if event == "cascaded":
        return (seq, generation, current, attempts, failed, False, done, exhausted, True), "accepted", None
    if event == "claimed":
        if is_open:
            return rest, "rejected", "already claimed"
        return (seq, generation, current, attempts + 1, failed, True, done, exhausted, cascaded), "accepted", None
    if not is_open:
        return rest, "rejected", "no open claim"
    if attempt is not None and attempt != attempts:
        return rest, "rejected", "another attempt"
    if event == "submitted" and ok:
        return (seq, generation, current, attempts, failed, False, True, exhausted, cascaded), "accepted", None
    failed += event == "submitted"
    return (seq, generation, current, attempts, failed, False, done, failed >= most_attempts, cascaded), "accepted", None


def named(state: tuple) -> str:
    _, generation, _, _, _, is_open, done, exhausted, cascaded = state
    if not generation:
        return "unknown"
    return "validated" if done else "failed" if exhausted or cascaded else "claimed" if is_open else "pending"


def _steps(state: tuple, events: Iterable, most_attempts: int) -> Iterator[tuple[tuple, tuple]]:
    """For events (seq, event, digest, attempt, ok) of a task in order: the state, and (seq, event, outcome, reason, generation, attempt, state's name)."""
    for seq, event, digest, attempt, ok in events:
        state, outcome, reason = step(state, event, seq, digest, attempt, ok, most_attempts)
        yield state, (seq, event, outcome, reason, state[1], state[3], named(state))


_ORDER = lambda e: (e[0] is None, e[0] or 0, e[1] or "", e[2] or "", e[3] or 0, bool(e[4]))


class Machine(StatefulProcessor):
    """The machine of each task, its state in the state store."""

    def __init__(self, most_attempts: int):
        self.most_attempts = most_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("task", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = tuple(self.held.get()) if key[0] is not None and self.held.exists() else NONE
        events = sorted(((r.seq, r.event, r.digest, r.attempt, r.ok) for r in rows), key=_ORDER)
        for after, row in _steps(state, events, self.most_attempts):
            # without a task every event stands alone
            state = after if key[0] is not None else NONE
            yield _ROW(key[0], *(row if key[0] is not None else _no_task(row)))
        if key[0] is not None:
            self.held.update(state)

    def close(self) -> None:
        pass


def _no_task(row: tuple) -> tuple:
    return (row[0], row[1], "rejected", "no task", 0, 0, "unknown")


def _events(df: DataFrame) -> DataFrame:
    return df.select(F.col("task").cast("long"), F.col("seq").cast("long"), "event", "digest", F.col("attempt").cast("long"), "ok")


def transitions(log: DataFrame, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """One row for each event of a log, in RESULT."""
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    arrow = pa.schema([(x, pa.int64() if kind == "long" else pa.string()) for x, kind in (y.split(" ") for y in RESULT.split(", "))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, state = None, NONE
        for batch in batches:
            out = []
            for t, *event in zip(*(batch.column(i).to_pylist() for i in range(len(EVENT))), strict=True):
                seq, kind, digest, attempt, ok = event
                if t is None or t != task:
                    task, state = t, NONE
                (state, row), = _steps(state, [(seq, kind, digest, attempt, ok)], most_attempts)
                out.append((t, *(row if t is not None else _no_task(row))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow], names)

    order = [F.asc_nulls_last("seq"), *[F.coalesce(F.col(c), F.lit(v)).asc() for c, v in (("event", ""), ("digest", ""), ("attempt", 0), ("ok", False))]]
    # what has no task belongs nowhere, and is dealt out
    salt = F.when(F.col("task").isNull(), F.xxhash64("seq", "event", "digest") % 1024)
    return _events(log).withColumn("salt", salt).repartition("task", "salt").sortWithinPartitions("task", *order).select(*EVENT).mapInArrow(fold, RESULT)


def streamed(events: DataFrame, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """The same rows of a stream of events. Batches must come in the order of seq for each task; what comes late is stale."""
    return _events(events).groupBy("task").transformWithState(Machine(most_attempts), RESULT, "Append", "None")


def run_available(events: DataFrame, path: str, checkpoint: str, most_attempts: int = MOST_ATTEMPTS) -> StreamingQuery:
    """Writes what events (a stream) has now to Parquet files at path. Run again with the same checkpoint, it goes on where it ended."""
    with_store(events.sparkSession)
    out = streamed(events, most_attempts).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()


def with_store(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def task_states(rows: DataFrame) -> DataFrame:
    """task, generation, attempts, state after the last accepted event, and how many events were rejected."""
    last = F.max_by(F.struct("generation", "attempt", "state"), F.when(F.col("outcome") == "accepted", F.col("seq")))
    found = rows.filter("task IS NOT NULL").groupBy("task").agg(last.alias("last"), F.count_if(F.col("outcome") == "rejected").alias("rejected"))
    return found.select("task", F.coalesce("last.generation", F.lit(0)).alias("generation"), F.coalesce("last.attempt", F.lit(0)).alias("attempts"), F.coalesce("last.state", F.lit("unknown")).alias("state"), "rejected")
