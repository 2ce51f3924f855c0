"""Queries that run a stream over a table to completion and return its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load, work_folder
from ..streaming import jobs
from .fixtures import fixture
from .ingest import text
from .registry import query
from .states import SQL_REVISIONS, log


@query("state_fold_stream", "fx_changelog", sql=SQL_REVISIONS + "select entity, data, slot from cur")
def state_fold_stream(spark, folder):
    table = jobs.fold(log(spark, folder, stream=True), work_folder(spark, "fold"))
    return jobs.folded(spark, table)


DELIVERIES = 4


def deliver(spark, rows, base):
    """Append the rows of one ``delivery`` after another to a folder, and hand out a stream over it each time."""
    for k in range(DELIVERIES):
        rows.where(F.col("delivery") == k).write.mode("append").parquet(f"{base}/in")
        yield spark.readStream.schema(rows.schema).parquet(f"{base}/in")


@query("stream_dedupe_replay", "fx_changelog", sql="select slot, entity, action, coalesce(data, '') as data from fx_changelog")
def stream_dedupe_replay(spark, folder):
    """Four deliveries, each of which repeats the second half of the one before; slots are kept for eight
    days of event time."""
    base, entries = work_folder(spark, "replay"), log(spark, folder)
    newest = entries.agg(F.max("slot")).head()[0]
    share = F.col("slot") * DELIVERIES / (newest + 1)
    again = entries.where((share - F.floor(share) >= 0.5) & (share < DELIVERIES - 1))
    rows = entries.withColumn("delivery", F.floor(share)).unionByName(again.withColumn("delivery", F.floor(share) + 1))
    for stream in deliver(spark, rows, base):
        sink = jobs.replay_free(stream, base, "8 days")
    return spark.read.parquet(sink).select("slot", "entity", "action", text("data").alias("data"))


SQL_ARRIVAL = (
    "least(3, floor(event_id * 4 / ((select max(event_id) from events) + 1)) + case when event_id % 97 = 0 then 2 when event_id % 89 = 0 then 1 else 0 end)"
)


@query(
    "threshold_alert_stream",
    sql=f"""
    come as (select *, cast({SQL_ARRIVAL} as bigint) as arrival, time_bucket(interval 1 hour, ts) as start from events),
    marks as (select arrival + 1 as arrival, max(epoch_ms(max(ts))) over (order by arrival) - 5 * 86400000 as closed from come group by arrival),
    judged as (select come.*, coalesce(epoch_ms(start) + 3600000 <= closed, false) as late from come left join marks on come.arrival = marks.arrival)
    select epoch_us(start) as start_us, user_id, count(*) filter (not late) as readings, min(value) filter (not late) as low, max(value) filter (not late) as high,
      cast(count(*) filter (not late and value > 200) as bigint) as over, count(*) filter (not late and value > 200) > 0 as alert, count(*) filter (late) as late
    from judged where epoch_ms(start) + 3600000 <= (select max(closed) from marks) group by 1, 2 having count(*) filter (not late) > 0""",
)
def threshold_alert_stream(spark, folder):
    """Windows as the watermark closes them, over four deliveries with late readings, which are set aside
    and counted beside the window that they missed."""
    base, events = work_folder(spark, "alerts"), load(spark, folder, "events")
    newest = events.agg(F.max("event_id")).head()[0]
    later = F.when(F.col("event_id") % 97 == 0, 2).when(F.col("event_id") % 89 == 0, 1).otherwise(0)
    arrival = F.least(F.lit(3), F.floor(F.col("event_id") * DELIVERIES / (newest + 1)) + later)
    rows = events.select("ts", "user_id", "value", arrival.alias("delivery"))
    for stream in deliver(spark, rows, base):
        windows, late = jobs.alerts(stream, base, "user_id", "value", 200, "1 hour", 5 * 86400)
    missed = spark.read.parquet(late).groupBy(F.window("ts", "1 hour").getField("start").alias("start"), "user_id").agg(F.count("*").alias("late"))
    found = spark.read.parquet(windows).join(missed, ["start", "user_id"], "left")
    return found.withColumns({"late": F.coalesce("late", F.lit(0)), "start_us": F.unix_micros("start")}).drop("start")


@query(
    "stream_checkpointed_read",
    "fx_raw",
    sql="""
    select 'general' as consumer, subject, count(*) as messages, sum(event_id)::bigint as checksum from fx_raw where subject like 'river.general.%' group by subject
    union all select 'all', subject, count(*), sum(event_id)::bigint from fx_raw group by subject""",
)
def stream_checkpointed_read(spark, folder):
    """Two consumers read independently; each runs twice and the second run finds nothing new."""
    base = work_folder(spark, "consumers")
    sinks = {}
    for name, pattern in (("general", "general.>"), ("all", "")):
        for _ in range(2):
            sinks[name] = jobs.consume(fixture(spark, folder, "fx_raw", stream=True), pattern, base, name)
    parts = [spark.read.parquet(path).withColumn("consumer", F.lit(name)) for name, path in sinks.items()]
    return (
        parts[0]
        .unionByName(parts[1])
        .groupBy("consumer", "subject")
        .agg(F.count("*").alias("messages"), F.sum("event_id").alias("checksum"))
    )


@query(
    "stream_quarantine",
    "fx_docs",
    sql="""
    select event_id, case when json_valid(data) and json_type(data) = 'OBJECT' then 'good' else 'bad' end as status,
      case when not json_valid(data) then 'not json' when json_type(data) <> 'OBJECT' then 'not an object' else '' end as reject_reason
    from fx_docs""",
)
def stream_quarantine(spark, folder):
    table = jobs.quarantine(fixture(spark, folder, "fx_docs", stream=True), work_folder(spark, "quarantine"))
    return spark.read.parquet(table).select("event_id", "status", text("reject_reason").alias("reject_reason"))


@query(
    "stream_count_window",
    "fx_raw",
    sql="""
    counted as (select row_number() over (order by event_id) as seq, ts from fx_raw)
    select seq // 180 as trigger, cast(180 as bigint) as beat_count, '2s' as interval, epoch_us(ts) as ts_us from counted where seq % 180 = 0""",
)
def stream_count_window(spark, folder):
    """A trigger at every 180th event of a stream, counted on from batch to batch."""
    rows = fixture(spark, folder, "fx_raw", stream=True).select("event_id", "ts")
    table = jobs.count_windows(rows, "event_id", work_folder(spark, "ticks"), "heartbeat", "2s")
    return spark.read.parquet(table).select("trigger", "beat_count", "interval", F.unix_micros("ts").alias("ts_us"))
