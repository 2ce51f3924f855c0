"""Tables maintained by streams: parts and manifests, the state table, snapshots, status, windows."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from eventflow.operators import chained, changelog, logstats, ordered, state
from eventflow.streaming import jobs, parts, snapshots, statetable, status

LOG = "slot bigint, entity string, action string, data string"


def random_log(n, seed=5, entities=("hot", "hot", "hot", "a", "b", "c")):
    rng = random.Random(seed)
    rows = []
    for slot in range(1, n + 1):
        action = rng.choice(["create", "update", "update", "delete"])
        rows.append((slot, rng.choice(entities), action, None if action == "delete" else f"v{slot}"))
    return rows


def table_rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def expected_table(spark, rows):
    revised = state.revisions(spark.createDataFrame(rows, LOG), width=64)
    return revised, table_rows(state.current(revised), "entity", "data", "revision")


# --- parts -------------------------------------------------------------------------------------

KIND = parts.Kind("k bigint, n bigint", lambda rows, oldest: rows.groupBy("k").agg(F.sum("n").alias("n")))


def add(spark, folder, batch_id, rows):
    known = parts.latest(spark, folder)
    if batch_id > known.batch:
        df = spark.createDataFrame(rows, KIND.schema).coalesce(1)
        added = {"t": parts.write_part(df, folder, "t", batch_id, KIND)}
        parts.commit(spark, folder, known, batch_id, added, {"t": KIND}, {"rows": known.notes.get("rows", 0) + len(rows)})


def test_parts_grow_with_the_logarithm(spark, tmp_path):
    folder = str(tmp_path)
    for b in range(40):
        add(spark, folder, b, [(b % 3, 1)])
        tiers = [t for _, t in parts.latest(spark, folder).tables["t"]]
        assert tiers == sorted(tiers, reverse=True) and max(map(tiers.count, tiers)) < parts.FANOUT
    assert len(tiers) <= 6
    assert table_rows(parts.read(spark, folder, "t", KIND).groupBy("k").agg(F.sum("n").alias("n")), "k", "n") == [(0, 14), (1, 13), (2, 13)]
    assert parts.latest(spark, folder).notes == {"rows": 40}
    # Merged parts and manifests of long ago are gone, those of the last batches are kept.
    left = [p.name for p in (tmp_path / "t").iterdir()]
    assert len(left) < 25 and len(list((tmp_path / "manifest").glob("[0-9]*.json"))) == parts.KEPT + 1


def test_readers_of_an_earlier_manifest_still_find_its_parts(spark, tmp_path):
    folder = str(tmp_path)
    for b in range(3):
        add(spark, folder, b, [(b, 1)])
    earlier = parts.latest(spark, folder)
    add(spark, folder, 3, [(3, 1)])
    assert len(parts.latest(spark, folder).paths("t")) == 1
    assert table_rows(parts.read(spark, folder, "t", KIND, earlier), "k") == [(0,), (1,), (2,)]


class Cut(Exception):
    pass


def cut_at(monkeypatch, k):
    """Let the k-th write or rename of a batch fail, after or before it took place."""
    left = itertools.count(1)

    def failing(fn, after):
        def run(*args):
            if after:
                out = fn(*args)
            if next(left) == k:
                raise Cut
            return out if after else fn(*args)

        return run

    monkeypatch.setattr(parts, "write_part", failing(parts.write_part, True))
    monkeypatch.setattr(parts, "_put", failing(parts._put, False))
    monkeypatch.setattr(parts, "_remove", failing(parts._remove, False))


def test_cut_off_between_any_two_writes(spark, tmp_path, monkeypatch):
    """The fourth batch, with its merges, is cut off at each of its six writes in turn. Up to the commit
    the table stays as it was; after it, a rerun adds nothing."""
    rows, folder = random_log(80), str(tmp_path)
    cuts = [spark.createDataFrame(rows[i : i + 20], LOG) for i in range(0, 80, 20)]
    for b in range(3):
        statetable.apply(cuts[b], b, folder, buckets=2)
    for k in range(1, 7):
        with monkeypatch.context() as broken:
            cut_at(broken, k)
            with pytest.raises(Cut):
                statetable.apply(cuts[3], 3, folder, buckets=2)
        done = k == 6
        assert parts.latest(spark, folder).batch == 2 + done
        if k in (4, 6):
            revised, want = expected_table(spark, rows[: 60 + 20 * done])
            assert table_rows(statetable.current(spark, folder), "entity", "data", "revision") == want
    statetable.apply(cuts[3], 3, folder, buckets=2)
    assert table_rows(statetable.watch(spark, folder), "revision", "entity", "data") == table_rows(state.watch(revised), "revision", "entity", "data")


def test_place_is_whole_or_not_there(spark, tmp_path):
    path = f"{tmp_path}/x/batch=1"
    parts.place(spark.range(3), path)
    parts.place(spark.range(9), path)  # is there already
    assert spark.read.parquet(path).count() == 3
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["batch=1"]


# --- state table -------------------------------------------------------------------------------


def test_state_table_over_batches_and_replays(spark, tmp_path):
    rows, source = random_log(160), str(tmp_path / "log")
    for k in range(5):
        low = max(0, k * 32 - 10)  # every batch repeats the end of the one before
        spark.createDataFrame(rows[low : k * 32 + 32], LOG).coalesce(1).write.mode("append").parquet(source)
        table = statetable.maintain(spark.readStream.schema(LOG).parquet(source), str(tmp_path / "job"), buckets=4, width=16)
    revised, want = expected_table(spark, rows)
    assert table_rows(statetable.current(spark, table), "entity", "data", "revision") == want
    outcomes = {r.slot: r.outcome for r in state.outcomes(spark.createDataFrame(rows, LOG)).collect()}
    done = parts.read(spark, table, "log", statetable.LOG).collect()
    assert {r.slot: r.outcome for r in done} == outcomes and len(done) == len(rows)
    # The value before each write.
    held, before = {}, {}
    for slot, entity, action, data in rows:
        if outcomes[slot] in ("applied", "created_by_update"):
            before[slot] = held.get(entity)
            held[entity] = data
    assert {r.slot: r.before for r in done if r.revision} == before
    feed = statetable.watch(spark, table, "hot", after=20)
    assert table_rows(feed, "revision", "data") == table_rows(state.watch(revised, "hot").where("revision > 20"), "revision", "data")
    asked = spark.createDataFrame([(e, i) for i, e in enumerate(["hot", "a", "b", "c", "nobody", None, "a"])], "entity string, n int")
    got = {(r.entity, r.n): (r.data, r.revision, r.found) for r in statetable.get_many(spark, table, asked).collect()}
    live = {e: (d, r, True) for e, d, r in want}
    assert got == {(e, n): live.get(e, (None, 0, False)) for e, n in table_rows_of(asked)}
    assert table_rows(statetable.get(spark, table, ["hot", "zzz"]), "entity", "data") == [(e, d) for e, d, _ in want if e == "hot"]


def table_rows_of(df):
    return [tuple(r) for r in df.collect()]


def files(df):
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


def test_lookup_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    rows = [(i, f"user-{i}", "create", f"v{i}") for i in range(1, 301)]
    folder = str(tmp_path)
    statetable.apply(spark.createDataFrame(rows, LOG), 0, folder, buckets=16)
    assert len(files(statetable.current(spark, folder))) == 16
    one = statetable.get(spark, folder, ["user-7"])
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(entity,user-7)" in plan
    assert "Window" not in plan
    many = statetable.get_many(spark, folder, spark.createDataFrame([("user-7",), ("user-8",)], "entity string"))
    assert many.collect()[0].found and "Window" not in many._jdf.queryExecution().toString()
    opened = many._jdf.queryExecution().executedPlan().toString()
    wanted = statetable.bucket_of(F.col("entity"), 16)
    buckets = {r[0] for r in spark.createDataFrame([("user-7",), ("user-8",)], "entity string").select(wanted).collect()}
    assert all(str(b) in opened.split("PartitionFilters")[1][:80] for b in buckets)


def test_deleted_entities_leave_when_no_older_part_holds_them(spark, tmp_path):
    folder = str(tmp_path)
    for b in range(4):
        rows = [(10 * b + 1, f"e{b}", "create", "x"), (10 * b + 2, f"e{b}", "delete", None), (10 * b + 3, "kept", "update", str(b))]
        statetable.apply(spark.createDataFrame(rows, LOG), b, folder, buckets=2)
    stored = parts.read(spark, folder, "state", statetable.STATE)
    assert table_rows(stored, "entity", "data", "revision") == [("kept", "3", 12)]
    statetable.apply(spark.createDataFrame([], LOG), 4, folder)  # an empty batch
    assert parts.latest(spark, folder).notes == {"buckets": 2, "slot": 33, "revision": 12}


# --- compaction of the fold --------------------------------------------------------------------


def test_fold_keeps_few_parts(spark, tmp_path):
    rows, source, base = random_log(90), str(tmp_path / "log"), str(tmp_path / "fold")
    for k in range(9):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], LOG).coalesce(1).write.mode("append").parquet(source)
        table = jobs.fold(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source), base, width=8)
    assert [t for _, t in parts.latest(spark, table).tables["compacted"]] == [1, 1, 0]
    want = table_rows(state.fold(spark.createDataFrame(rows, LOG)), "entity", "data", "slot")
    assert table_rows(jobs.folded(spark, table), "entity", "data", "slot") == want


# --- snapshots ---------------------------------------------------------------------------------


def test_snapshots_serve_reads_far_back(spark, tmp_path):
    rows = random_log(200)
    log_path, folder = str(tmp_path / "log"), str(tmp_path / "snapshots")
    whole = spark.createDataFrame(rows, LOG)
    changelog.write_log(whole, log_path, 10)
    stored = spark.read.parquet(log_path)
    assert table_rows(snapshots.state_at(stored, folder, 57, 10), "entity", "data", "slot") == table_rows(state.state_at(whole, 57), "entity", "data", "slot")
    snapshots.take(stored.where("segment < 9"), folder, every=4, width=10)
    snapshots.take(stored, folder, every=99, width=10)  # goes on at the spacing it began with
    assert parts.latest(spark, folder).notes == {"segment": 20, "every": 4}
    for slot in (1, 40, 41, 83, 200, 900):
        got = snapshots.state_at(stored, folder, slot, 10)
        assert table_rows(got, "entity", "data", "slot") == table_rows(state.state_at(whole, slot), "entity", "data", "slot")
    assert scans(snapshots.state_at(stored, folder, 93, 10)) == ({"8"}, {(">=", "8"), ("<=", "9")})


def scans(df):
    """Snapshots that a plan reads, and the bounds it puts on the segments of the log."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    bounds = set(re.findall(r"\(segment#\d+ ([<>]=) (\d+)\)", " ".join(re.findall(r"PartitionFilters: \[(.*?)\]", plan))))
    return {f.split("/before/")[1].split("/")[0] for f in df.inputFiles() if "/before/" in f}, bounds


def test_reads_as_of_far_back(spark, tmp_path):
    rows = random_log(200, seed=8)
    log_path, folder = str(tmp_path / "log"), str(tmp_path / "snapshots")
    whole = spark.createDataFrame(rows, LOG)
    changelog.write_log(whole, log_path, 10)
    stored = spark.read.parquet(log_path)
    snapshots.take(stored, folder, every=4, width=10)
    asked = [(i, e, s) for i, (e, s) in enumerate(itertools.product(["hot", "a", "b", "nobody"], [125, 126, 133, 140, 149]))]
    reads = spark.createDataFrame(asked, "read_id bigint, entity string, slot bigint")
    got = snapshots.as_of(reads, stored, folder, 10)
    want = state.as_of(reads, whole, 10)
    assert table_rows(got.fillna(""), *want.columns) == table_rows(want.fillna(""), *want.columns)
    assert scans(got) == ({"12"}, {(">=", "12"), ("<=", "14")})


# --- chains of conditional writes ----------------------------------------------------------------


def in_sequence(rows):
    held, out = {}, {}
    for arrival, entity, expected, current in sorted(rows):
        met = held.setdefault(entity, current)
        won = expected == met
        held[entity] = met + won
        kinds = ("created" if expected == 0 else "updated") if won else ("conflict_exists" if expected == 0 else "conflict_revision")
        out[arrival] = (met, kinds)
    return out


CAS = "arrival bigint, entity string, expected_revision bigint, current_revision bigint"


@pytest.mark.parametrize("width", [64, 1 << 18])
def test_chains_equal_a_sequential_run(spark, width):
    rng = random.Random(3)
    starts = {e: rng.randrange(4) for e in "abcdefgh"} | {"hot": 0}
    rows, climb = [], 0
    for arrival in range(6000):
        if rng.random() < 0.6:  # the contended entity: writers mostly know the newest revision
            expected = climb + rng.choice([-1, 0, 0, 0, 1]) if climb else 0
            rows.append((arrival, "hot", max(expected, 0), 0))
            climb += expected == climb
        elif rng.random() < 0.9:
            e = rng.choice("abcdefgh")
            rows.append((arrival, e, rng.randrange(40), starts[e]))
    assert climb > 1500
    got = chained.resolve(spark.createDataFrame(rows, CAS).repartition(5), width).collect()
    assert {r.arrival: (r.met_revision, r.outcome) for r in got} == in_sequence(rows)
    assert len(got) == len(rows)


def test_chains_of_nothing(spark):
    assert chained.resolve(spark.createDataFrame([], CAS)).collect() == []


# --- status ----------------------------------------------------------------------------------


def test_status_stream_and_batch_merge_into_stored_entities(spark, tmp_path):
    stored_rows = [
        ("entity-u1", '{"id":"u1","owner":{"n":1},"credit":12,"created_at":"2020-01-01T00:00:00Z","status":"old"}'),
        ("entity-u2", "[1,2]"),
        ("entity-u9", '{"id":"u9"}'),
    ]
    stored = spark.createDataFrame(stored_rows, "entity string, data string")
    schema = "pos bigint, entity_id string, status string, message string"
    rows = [(i, None if i % 7 == 0 else f"u{i % 4}", None if i == 5 else f"s{i}", "m ü") for i in range(1, 41)]
    source = str(tmp_path / "in")
    for cut in (0, 20):
        spark.createDataFrame(rows[cut : cut + 20], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds("pos"))
        # Restarted from its checkpoint; the stored entities given later no longer count.
        sink = status.keep_status(stream, "pos", stored if not cut else stored.limit(0), str(tmp_path / "job"))
    got = {r.position: (r.entity, r.action, json.loads(r.data)) for r in spark.read.parquet(sink).collect()}
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("pos"))
    want = {r.pos: (r.entity, r.action, json.loads(r.data)) for r in state.status_documents(batch, stored, "pos", width=8).collect()}
    assert got == want and len(got) == sum(r[1] is not None for r in rows)
    first = got[1]
    assert first == ("entity-u1", "update", {"id": "u1", "owner": {"n": 1}, "credit": 12, "created_at": "2020-01-01T00:00:00Z", "status": "s1", "last_update": "1970-01-01T00:00:01Z", "message": "m ü"})
    assert got[3][1:] == ("create", {"id": "u3", "created_at": "1970-01-01T00:00:03Z", "status": "s3", "last_update": "1970-01-01T00:00:03Z", "message": "m ü"})
    assert got[2][1] == "update" and "id" not in got[2][2]


# --- windows and replays in event time --------------------------------------------------------


READINGS = "sensor string, value double, at bigint"


def test_windows_and_late_readings(spark, tmp_path):
    """Every reading is in a closed window, set aside as late, or in a window that is still open."""
    rng = random.Random(6)
    deliveries = [[(rng.choice("ab"), rng.random() * 100, 600 * k + rng.randrange(-900, 600)) for _ in range(60)] for k in range(6)]
    source, base = str(tmp_path / "in"), str(tmp_path / "job")
    closed, on_time, late_rows, newest = None, [], [], None
    for rows in deliveries:
        rows = [(s, v, 10_000 + at) for s, v, at in rows]
        spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(READINGS).parquet(source).withColumn("ts", F.timestamp_seconds("at"))
        windows, late = jobs.alerts(stream, base, "sensor", "value", 90.0, "5 minutes", 300)
        for r in rows:
            end = r[2] // 300 * 300 + 300
            (late_rows if closed is not None and end <= closed else on_time).append(r)
        newest = max([newest or 0, *[r[2] for r in rows]])
        closed = newest - 300
    assert late_rows
    assert table_rows(spark.read.parquet(late), "sensor", "value", "at") == sorted(late_rows)
    ready = spark.createDataFrame([r for r in on_time if r[2] // 300 * 300 + 300 <= closed], READINGS).withColumn("ts", F.timestamp_seconds("at"))
    want = logstats.threshold_metrics(ready, "sensor", "value", 90.0, "5 minutes")
    assert table_rows(spark.read.parquet(windows), *want.columns) == table_rows(want, *want.columns)


def test_slots_are_forgotten_behind_the_watermark(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "slot bigint, at bigint"
    sizes, seen = [], []
    for k in range(8):
        rows = [(i, 1_000_000 + 60 * i) for i in range(100 * k, 100 * k + 100)]
        again = [(i, 1_000_000 + 60 * i) for i in range(max(0, 100 * k - 50), 100 * k)]
        spark.createDataFrame(rows + again, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds("at"))
        query = jobs.dedupe(stream, "2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        seen += rows
    assert table_rows(spark.read.parquet(str(tmp_path / "out")), "slot") == sorted((s,) for s, _ in seen)
    assert max(sizes) <= 400 < len(seen)


def test_no_task_of_the_state_table_grows_with_a_split_or_a_keyless_segment(spark, monkeypatch):
    log = spark.createDataFrame([(i + 1, f"e{i % 5}", "update", f"v{i}") for i in range(100)] + [(7, "e1", "update", "v6")], LOG)
    plan = statetable._unseen(log, 10)._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange") :]
    assert sorted(r.slot for r in statetable._unseen(log, 5).collect()) == list(range(6, 101))
    monkeypatch.setattr(ordered, "KEYLESS_WIDTH", 16)
    numbered = ordered.number_rows(log.dropDuplicates(["slot"]).where("slot % 3 <> 0"), "slot", "n")
    assert re.search(r" div (cast\()?16\b", numbered._jdf.queryExecution().analyzed().toString())
    assert [r.n for r in numbered.orderBy("slot").collect()] == list(range(1, 68))
