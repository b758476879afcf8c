"""Streams of events: windows, sessions, deduplication, operation states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillwork.sources.files import scratch


def file_stream(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """A stream over the Parquet files of a folder that match a pattern, with the schema of what is there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def timed(events: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as an instant (session zone), with a watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling(events: DataFrame, at: str, length: str, *by: str) -> DataFrame:
    w = F.window(at, length)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start_at"), *by, "n", "total")


def sliding(events: DataFrame, at: str, length: str, step: str, *by: str) -> DataFrame:
    w = F.window(at, length, step)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_at"), *by, "n")


def sessions(events: DataFrame, at: str, gap: str, *by: str) -> DataFrame:
    """Runs of events of a key with no pause as long as the gap."""
    w = F.session_window(at, gap)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_at"), *by, "n")


def first_of(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events without repeats of their keys within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


# What follows an operation's state on each kind of event.
MOVES = {
    ("", "start"): "running",
    ("pending", "start"): "running",
    ("running", "finish"): "succeeded",
    ("running", "error"): "failed",
    ("pending", "cancel"): "canceled",
    ("running", "cancel"): "canceled",
}
OPERATION = "operation string, seq long, state string, history int"


def operation_states(events: DataFrame, history: int = 100) -> DataFrame:
    """(operation, seq, state, history) after each batch of (operation, seq, kind) events.

    Events of one batch are taken in order of seq; kinds that a state doesn't know leave it. history is the
    number of events held, the oldest going first beyond `history`. The state of an operation is one small
    row, so memory follows the number of operations, not of events.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held, last = state.get if state.exists else ("", 0, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, kind in zip(rows["seq"], rows["kind"], strict=True):
            now, held, last = MOVES.get((now, kind), now), min(history, held + 1), max(last, int(seq))
        state.update((now, held, last))
        yield pd.DataFrame({"operation": [key[0]], "seq": [last], "state": [now or "pending"], "history": [held]})

    return events.groupBy("operation").applyInPandasWithState(step, OPERATION, "state string, held int, last long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything there is now, through the stream. Each micro-batch is written as Parquet under its number, so a
    batch that is run again after a failure replaces itself; complete mode keeps the last batch's table only.
    """
    spark = stream.sparkSession
    at = scratch(spark, "stream")
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        folder = f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}"
        batch.write.mode("overwrite").parquet(folder)

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/out")


def event_frame(rows: DataFrame) -> DataFrame:
    """A server-sent event of each row (seq, kind, payload columns)."""
    data = F.to_json(F.struct(*[c for c in rows.columns if c not in ("seq", "kind")]))
    return rows.select(F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\nevent: "), "kind", F.lit("\ndata: "), data, F.lit("\n\n")).alias("frame"))


def heartbeats(events: DataFrame, silence_ms: int = 15_000) -> DataFrame:
    """(operation, kind, seq): each operation's events pass, and a `heartbeat` follows after so much silence in
    processing time. The state of an operation is its last number."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            out = pd.DataFrame({"operation": [key[0]], "kind": ["heartbeat"], "seq": [state.get[0]]})
        else:
            out = pd.concat(list(frames)).sort_values("seq")[["operation", "kind", "seq"]]
            state.update((int(out["seq"].max()),))
        state.setTimeoutDuration(silence_ms)
        yield out

    return events.groupBy("operation").applyInPandasWithState(step, "operation string, kind string, seq long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def progress_listener(put):
    """A listener that hands each micro-batch's progress to put(name, batch, rows)."""
    from pyspark.sql.streaming.listener import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            put(event.progress.name, event.progress.batchId, event.progress.numInputRows)

        def onQueryTerminated(self, event):
            pass

    return Listener()
