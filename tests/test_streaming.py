"""Streams give the batch results, resume from checkpoints and survive replays."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from eventflow.operators import events, outbox, parsers, reactors, state
from eventflow.operators.routing import fan_out
from eventflow.plans.fixtures import fixture
from eventflow.plans.ingest import general_events, payments
from eventflow.session import work_folder
from eventflow.sources import rawlog, ticks
from eventflow.streaming import jobs

SF = "/root/testdata/sf0.001"
LOG = "slot bigint, entity string, action string, data string"


def drain(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    jobs.run_available(df, path, path + "-checkpoint")
    return spark.read.parquet(path)


def same(a, b):
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_payment_stream_equals_batch(spark, tmp_path):
    keep = ["event_id", "kind", "target", "action", "data"]
    stream = reactors.on_payment(payments(spark, SF, stream=True)).select(keep)
    same(drain(spark, stream, tmp_path, "pay"), reactors.on_payment(payments(spark, SF)).select(keep))


def test_general_stream_equals_batch(spark, tmp_path):
    keep = ["event_id", "subject", "data"]
    stream = general_events(spark, SF, stream=True).select(keep)
    same(drain(spark, stream, tmp_path, "gen"), general_events(spark, SF).select(keep))


def test_routing_stream_equals_batch(spark, tmp_path):
    subs = fixture(spark, SF, "fx_patterns")
    stream = fan_out(fixture(spark, SF, "fx_raw", stream=True).select("event_id", "subject"), subs)
    same(drain(spark, stream, tmp_path, "route"), fan_out(fixture(spark, SF, "fx_raw").select("event_id", "subject"), subs).select(stream.columns))


def test_consumers_resume_and_are_independent(spark, tmp_path):
    source = str(tmp_path / "src")
    schema = "event_id bigint, subject string, data string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    add([(1, "river.a.x", "1"), (2, "river.b.x", "2")])
    stream = spark.readStream.schema(schema).parquet(source)
    base = str(tmp_path / "consumers")
    sink = jobs.consume(stream, "a.>", base, "one")
    assert spark.read.parquet(sink).count() == 1
    add([(3, "river.a.y", "3")])
    jobs.consume(stream, "a.>", base, "one")
    jobs.consume(stream, "a.>", base, "one")
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == [1, 3]
    other = jobs.consume(stream, "", base, "two")
    assert sorted(r.event_id for r in spark.read.parquet(other).collect()) == [1, 2, 3]


def test_fold_over_several_batches(spark, tmp_path):
    source, schema = str(tmp_path / "log"), LOG
    rows = [
        (1, "a", "create", "a1"),
        (2, "b", "create", "b1"),
        (3, "a", "create", "a2"),
        (4, "b", "delete", None),
        (5, "b", "update", "b2"),
        (6, "c", "create", "c1"),
        (7, "c", "delete", None),
    ]
    base = str(tmp_path / "state")
    # Batches also arrive out of order and repeat: the fold depends on slots only.
    for part in (rows[4:], rows[:3], rows[2:5], rows[:2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        table = jobs.fold(stream, base, width=2)
    got = {r.entity: r.data for r in jobs.folded(spark, table).collect()}
    assert got == {"a": "a1", "b": "b2"}
    whole = state.fold(spark.createDataFrame(rows, schema))
    assert got == {r.entity: r.data for r in whole.collect()}


def test_status_table_equals_batch(spark, tmp_path):
    source = str(tmp_path / "s")
    schema = "pos bigint, entity_id string, status string, message string"
    rows = [(i, None if i % 7 == 0 else f"u{i % 4}", f"s{i}", "m") for i in range(60)]
    for cut in (0, 30):
        spark.createDataFrame(rows[cut : cut + 30], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds("pos"))
        table = jobs.track_status(stream, "pos", str(tmp_path / "job"))
    got = state.status_entities(spark.read.parquet(table))
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("pos"))
    newest = state.status_upsert(batch, "pos").groupBy("entity").agg(F.max("pos").alias("pos"))
    want = state.status_upsert(batch, "pos").join(newest, ["entity", "pos"]).select(got.columns)
    same(got, want)


def test_dedupe_within_delay(spark, tmp_path):
    source = str(tmp_path / "d")
    rows = [(1, 10), (2, 11), (1, 12), (3, 13), (2, 14)]
    spark.createDataFrame(rows, "slot bigint, at bigint").write.parquet(source)
    stream = spark.readStream.schema("slot bigint, at bigint").parquet(source).withColumn("ts", F.timestamp_seconds("at"))
    got = drain(spark, jobs.dedupe(stream, "1 minute"), tmp_path, "out")
    assert sorted(r.slot for r in got.collect()) == [1, 2, 3]


def test_quarantine_keeps_every_row(spark, tmp_path):
    table = jobs.quarantine(fixture(spark, SF, "fx_docs", stream=True), str(tmp_path / "q"))
    out = spark.read.parquet(table)
    assert out.count() == fixture(spark, SF, "fx_docs").count()
    assert out.where("status = 'bad' and reject_reason is null").count() == 0


def test_count_windows(spark, tmp_path):
    """Triggers count on from batch to batch and across restarts, over positions with gaps."""
    source = str(tmp_path / "in")
    schema = "pos bigint, ts timestamp"
    seen = []
    for part in range(3):
        rows = [(i * i, datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(part * 7, part * 7 + 7)]
        seen += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        fired = jobs.count_windows(stream, "pos", str(tmp_path / "job"), "beat", "1s", 4)
    got = [(r.trigger, r.ts, r.uptime) for r in spark.read.parquet(fired).orderBy("trigger").collect()]
    assert got == [(k, seen[4 * k - 1][1], f"{4 * k - 1}s") for k in range(1, 6)]


def test_tick_stream_shape(spark):
    stream = ticks.tick_stream(spark, 5)
    assert stream.isStreaming and stream.columns == ["seq", "ts_ns", "hz"]


def test_outbox_delivery(spark, tmp_path):
    source = str(tmp_path / "src")
    schema = "subject string, data string"
    rows = [("song.telegram.1", json.dumps({"platform": "telegram", "chat_id": "1", "text": "hi"}))]
    spark.createDataFrame(rows, schema).write.parquet(source)
    sent = []
    stream = outbox.messages(spark.readStream.schema(schema).parquet(source), "song.>", "telegram")
    outbox.deliver(stream, lambda df, _id: sent.extend(r.text for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    assert sent == ["hi"]


def test_guard_metadata_and_publish_on_streams(spark, tmp_path):
    stream = fixture(spark, SF, "fx_docs", stream=True)
    good = events.add_metadata(events.accepted(events.guard_payload(stream)))
    out = events.publish(good.withColumn("source", F.lit("x"))).select("event_id", "key", "value")
    batch = events.add_metadata(events.accepted(events.guard_payload(fixture(spark, SF, "fx_docs"))))
    same(drain(spark, out, tmp_path, "pub"), events.publish(batch.withColumn("source", F.lit("x"))).select("event_id", "key", "value"))


def test_work_folder_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = work_folder(spark, "x")
    assert shared is None or folder.startswith(shared)
    assert work_folder(spark, "x") != folder
