"""Queries that run as streams or replay a log event by event, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.graph import ready
from strataline.plans.registry import query
from strataline.streaming import task_machine

#: An event's command: signups create a task, with a digest that changes with every third event; clicks claim, purchases and errors submit.
_COMMANDS = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'submitted' WHEN 'error' THEN 'submitted' WHEN 'view' THEN 'released' ELSE 'cascaded' END"


def _log(events: DataFrame) -> DataFrame:
    command = F.expr(_COMMANDS)
    return events.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), command.alias("event"), F.concat(F.lit("d"), F.floor(F.col("event_id") / 3)).alias("digest"), F.when(F.col("event_id") % 5 == 0, F.lit(1)).cast("long").alias("attempt"), (F.col("event_type") == "purchase").alias("ok"))


# one event of every task a round
_REPLAY = f"""WITH RECURSIVE e AS (
  SELECT user_id AS task, event_id AS seq, {_COMMANDS} AS event, 'd' || event_id // 3 AS digest, CASE WHEN event_id % 5 = 0 THEN 1 END AS attempt, event_type = 'purchase' AS ok,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), r AS (
  SELECT task, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS event, NULL::VARCHAR AS why, 0::BIGINT AS generation, NULL::VARCHAR AS digest, 0::BIGINT AS attempt, 0::BIGINT AS failed, false AS open, false AS done, false AS dead FROM (SELECT DISTINCT task FROM e)
  UNION ALL
  SELECT task, i, seq, event, why, CASE WHEN new THEN generation + 1 ELSE generation END, CASE WHEN new THEN d ELSE digest END, CASE WHEN new THEN 0 WHEN yes AND event = 'claimed' THEN attempt + 1 ELSE attempt END,
    CASE WHEN new THEN 0 WHEN bad THEN failed + 1 ELSE failed END, CASE WHEN yes THEN event = 'claimed' ELSE open END, CASE WHEN new THEN false ELSE done OR (yes AND event = 'submitted' AND ok) END, CASE WHEN new THEN false ELSE dead OR (yes AND event = 'cascaded') OR (bad AND failed + 1 >= 3) END
  FROM (SELECT *, why IS NULL AS yes, why IS NULL AND event = 'created' AS new, why IS NULL AND event = 'submitted' AND NOT ok AS bad FROM (
    SELECT r.task, e.i, e.seq, e.event, e.digest AS d, e.ok, r.generation, r.digest, r.attempt, r.failed, r.open, r.done, r.dead,
      CASE WHEN e.event = 'created' THEN CASE WHEN generation > 0 AND e.digest = r.digest THEN '=' END WHEN generation = 0 THEN 'unknown task' WHEN done THEN 'done' WHEN dead THEN 'failed for good' WHEN e.event = 'cascaded' THEN NULL
        WHEN e.event = 'claimed' THEN CASE WHEN open THEN 'already claimed' END WHEN NOT open THEN 'no open claim' WHEN e.attempt <> r.attempt THEN 'another attempt' END AS why
    FROM r JOIN e ON e.task = r.task AND e.i = r.i + 1))
)
SELECT task, seq, event, CASE why WHEN '=' THEN 'unchanged' ELSE CASE WHEN why IS NULL THEN 'accepted' ELSE 'rejected' END END AS outcome, nullif(why, '=') AS reason, generation, attempt,
  CASE WHEN generation = 0 THEN 'unknown' WHEN done THEN 'validated' WHEN dead THEN 'failed' WHEN open THEN 'claimed' ELSE 'pending' END AS state FROM r WHERE i > 0"""


@query(_REPLAY)
def task_transitions(table):
    return task_machine.transitions(_log(table("events")))


@query(_REPLAY)
def streamed_transitions(table):
    events = table("events")
    spark = events.sparkSession
    ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/machine-{uuid.uuid4().hex}"
    _log(events).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(_log(events).schema).parquet(f"{folder}/in")
    task_machine.run_available(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(task_machine.RESULT).parquet(f"{folder}/out")


@query(f"""WITH t AS ({_REPLAY}) SELECT task, coalesce(arg_max(generation, seq) FILTER (outcome = 'accepted'), 0) AS generation, coalesce(arg_max(attempt, seq) FILTER (outcome = 'accepted'), 0) AS attempts, coalesce(arg_max(state, seq) FILTER (outcome = 'accepted'), 'unknown') AS state, count(*) FILTER (outcome = 'rejected') AS rejected FROM t GROUP BY task""")
def machine_states(table):
    return task_machine.task_states(task_machine.transitions(_log(table("events"))))
