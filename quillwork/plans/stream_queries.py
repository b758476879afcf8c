"""Streaming queries: the events file read as a stream to its end; each must agree with its batch form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.plans.catalogue import query
from quillwork.streaming import events as S


def _stream(spark, sf):
    return S.timed(S.file_stream(spark, sf, "events.parquet"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start_at, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    return S.drained(S.tumbling(_stream(spark, sf), "ts", "1 day", "event_type").select(F.col("start_at").cast("timestamp_ntz").alias("start_at"), "event_type", "n"))


@query("SELECT start_at, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS start_at FROM events) GROUP BY 1")
def stream_sliding(spark, sf):
    return S.drained(S.sliding(_stream(spark, sf), "ts", "2 hours", "1 hour").select(F.col("start_at").cast("timestamp_ntz").alias("start_at"), "n"))


@query(
    "WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "b AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start_at, count(*) AS n FROM b GROUP BY user_id, s"
)
def stream_session(spark, sf):
    return S.drained(S.sessions(_stream(spark, sf), "ts", "30 minutes", "user_id").select("user_id", F.col("start_at").cast("timestamp_ntz").alias("start_at"), "n"))


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf):
    """Each event comes twice; one of both stays."""
    e = S.timed(S.file_stream(spark, sf, "events.parquet"), late="60 days").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return S.drained(S.first_of(e, ["event_id"]).select("event_id", "user_id"), "append")


@query()
def op_state_machine(spark, sf):
    """Users as operations: signup starts, purchase finishes, error fails, the rest is noise."""
    kind = F.create_map(*[F.lit(x) for p in (("signup", "start"), ("purchase", "finish"), ("error", "error")) for x in p])
    e = S.file_stream(spark, sf, "events.parquet").select(F.concat(F.lit("op"), "user_id").alias("operation"), F.col("event_id").alias("seq"), F.coalesce(F.try_element_at(kind, "event_type"), F.lit("")).alias("kind"))
    out = S.drained(S.operation_states(e), "update")
    return out.groupBy("operation").agg(F.max_by(F.struct("seq", "state", "history"), "seq").alias("x")).select("operation", "x.*")
