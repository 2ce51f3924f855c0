"""Structured Streaming jobs over the same operators, one checkpoint per consumer name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import logstats, state
from ..operators.ordered import SEGMENT_WIDTH
from ..sources import rawlog, ticks
from . import parts


def run_available(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Append everything available to a parquet table and stop; positions survive restarts."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a batch function over everything available and stop."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def consume(raw_stream: DataFrame, pattern: str, folder: str, consumer: str) -> str:
    """Durable read of matching raw records under a consumer name; returns the sink's path.

    The same name resumes where it stopped, different names read independently.
    """
    sink = f"{folder}/{consumer}/data"
    run_available(rawlog.scan(raw_stream, pattern), sink, f"{folder}/{consumer}/checkpoint")
    return sink


def quarantine(stream: DataFrame, folder: str) -> str:
    """Split payloads into good and bad in one pass; bad rows keep their reason.

    The sink is one table partitioned by ``status`` (``good`` or ``bad``).
    """
    checked = ev.guard_payload(stream)
    status = F.when(F.col("reject_reason").isNull(), "good").otherwise("bad")
    run_available(checked.withColumn("status", status), f"{folder}/split", f"{folder}/checkpoint", ["status"])
    return f"{folder}/split"


_ENTRY = "struct<slot: bigint, data: string>"
COMPACTED = parts.Kind(f"entity string, gone bigint, written {_ENTRY}, created {_ENTRY}", lambda rows, oldest: state.combine(rows))


def fold(log_stream: DataFrame, folder: str, width: int = SEGMENT_WIDTH) -> str:
    """Keep a compacted state table up to date from a change-log stream; returns the table's folder.

    Every micro-batch is compacted on its own and added as a part; parts are merged by size while the
    stream runs, so a reader opens a number of parts that grows with the logarithm of the batches.
    A batch that runs twice changes nothing, and a replayed log entry is harmless. There is no per-key
    state in one task: a hot entity is spread over segments as in the batch fold.
    """
    table = f"{folder}/table"

    def write(batch: DataFrame, batch_id: int) -> None:
        known = parts.latest(batch.sparkSession, table)
        if batch_id > known.batch:
            added = {"compacted": parts.write_part(state.compact(batch, width), table, "compacted", batch_id, COMPACTED)}
            parts.commit(batch.sparkSession, table, known, batch_id, added, {"compacted": COMPACTED}, {})

    run_batches(log_stream, write, f"{folder}/checkpoint")
    return table


def folded(spark: SparkSession, table: str) -> DataFrame:
    """Current state of a table that ``fold`` maintains."""
    return state.merge(parts.read(spark, table, "compacted", COMPACTED))


def count_windows(stream: DataFrame, position: str, folder: str, source: str, interval: str, hz: int = ticks.DEFAULT_HZ) -> str:
    """Fire a trigger at every N-th row of a stream; returns the path of the triggers.

    Rows must arrive in the order of ``position`` across micro-batches. The number of rows so far and
    the first time stand in a manifest, from which a batch counts on; one that runs twice writes the same.
    """
    fired, totals = f"{folder}/triggers", f"{folder}/totals"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = parts.latest(spark, totals)
        if batch_id <= known.batch:
            return
        own = batch.agg(F.count("*").alias("rows"), F.unix_micros(F.min("ts")).alias("first")).head()
        if own["rows"]:
            before, first = known.notes.get("rows", 0), min(own["first"], known.notes.get("first", own["first"]))
            numbered = ticks.numbered(batch, position, before)
            rows = ticks.triggers(numbered, source, interval, hz, started=F.timestamp_micros(F.lit(first)))
            rows.write.mode("overwrite").parquet(f"{fired}/batch={batch_id}")
            parts.commit(spark, totals, known, batch_id, {}, {}, {"rows": before + own["rows"], "first": first})

    run_batches(stream, write, f"{folder}/checkpoint")
    return fired


def track_status(updates: DataFrame, position: str, folder: str) -> str:
    """Keep entities up to date from a stream of status events; returns the table's path.

    Each micro-batch leaves one row per entity with its first and last event; see
    ``state.status_entities`` for reading.
    """
    table = f"{folder}/status"

    def write(batch: DataFrame, batch_id: int) -> None:
        state.status_compact(batch, position).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    run_batches(updates, write, f"{folder}/checkpoint")
    return table


def dedupe(log_stream: DataFrame, delay: str) -> DataFrame:
    """Drop repeated slots that arrive within ``delay`` of each other (bounded state)."""
    return log_stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["slot"])


def replay_free(log_stream: DataFrame, folder: str, delay: str) -> str:
    """Append log entries whose slot was not seen within ``delay`` of event time; returns the sink's path.
    Slots are forgotten as the watermark passes, across micro-batches and restarts."""
    run_available(dedupe(log_stream, delay), f"{folder}/entries", f"{folder}/checkpoint")
    return f"{folder}/entries"


def split_late(readings: DataFrame, folder: str, every: str, delay_s: int) -> tuple[str, str]:
    """Part a stream of readings into those that come in time and those whose window is closed already;
    returns both paths.

    A window is closed once it ends ``delay_s`` before the newest time of the micro-batches before. The
    folders of a batch are put in place by renames, so a stream that follows them sees each row once.
    """
    ready, late, notes = f"{folder}/ready", f"{folder}/late", f"{folder}/watermark"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = parts.latest(spark, notes)
        if batch_id <= known.batch:
            return
        closed = known.notes.get("closed_ms")
        ends = F.window("ts", every).getField("end")
        is_late = F.lit(False) if closed is None else F.coalesce(ends <= F.timestamp_millis(F.lit(closed)), F.lit(False))
        marked = batch.withColumn("_late", is_late)
        parts.place(marked.where(~F.col("_late")).drop("_late"), f"{ready}/batch={batch_id}")
        parts.place(marked.where("_late").drop("_late"), f"{late}/batch={batch_id}")
        newest = batch.agg(F.unix_millis(F.max("ts"))).head()[0]
        known_ms = [ms for ms in (closed, None if newest is None else newest - 1000 * delay_s) if ms is not None]
        parts.commit(spark, notes, known, batch_id, {}, {}, {"closed_ms": max(known_ms)} if known_ms else {})

    run_batches(readings, write, f"{folder}/checkpoint-split")
    return ready, late


def alerts(readings: DataFrame, folder: str, key: str, value: str, limit: float, every: str, delay_s: int) -> tuple[str, str]:
    """Window metrics of a stream of readings (``ts``, key, value), each window appended once, when the
    watermark closes it; returns the paths of the windows and of the late readings.

    Late readings are set aside before the windows, by the same rule, so none is lost in silence.
    """
    ready, late = split_late(readings, folder, every, delay_s)
    kept = readings.sparkSession.readStream.schema(readings.schema).parquet(ready)
    metrics = logstats.threshold_metrics(kept.withWatermark("ts", f"{delay_s} seconds"), key, value, limit, every)
    run_available(metrics, f"{folder}/windows", f"{folder}/checkpoint-windows")
    return f"{folder}/windows", late
