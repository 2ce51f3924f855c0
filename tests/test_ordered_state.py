"""Ordered sweeps and state operators against plain sequential code, with hot keys and many segments."""

import random

import pytest
from pyspark.sql import functions as F

from eventflow.operators import changelog, logstats, state
from eventflow.operators.ordered import Running, newest_per_key, number_rows, running

LOG = "slot bigint, entity string, action string, data string, actor string"
WIDTHS = [1, 7, 64, 1 << 22]


def random_log(seed, n=400, odd=True):
    """A third of all entries belong to one entity; slots have gaps; some entries are unusable."""
    rng = random.Random(seed)
    slot, rows = 0, []
    for _ in range(n):
        slot += rng.choice([1, 1, 1, 5])
        entity = "hot" if rng.random() < 0.34 else f"e{rng.randrange(25)}"
        action = rng.choice(["create", "update", "delete"])
        data = None if action == "delete" else f"v{slot}"
        if odd and rng.random() < 0.05:
            action, data = rng.choice([("upsert", "x"), ("create", ""), ("update", None)])
        rows.append((slot, entity, action, data, "a"))
    rng.shuffle(rows)
    return rows


def sequential(rows):
    """The log applied one entry at a time: state, outcome per slot, revision per applied slot."""
    live, outcomes, revisions, versions, revision = {}, {}, {}, [], 0
    for slot, entity, action, data, _ in sorted(rows):
        if action not in ("create", "update", "delete") or (action != "delete" and not data):
            outcomes[slot] = "error"
            continue
        present = entity in live
        if action == "create":
            outcomes[slot] = "rejected_exists" if present else "applied"
        elif action == "update":
            outcomes[slot] = "applied" if present else "created_by_update"
        else:
            outcomes[slot] = "applied" if present else "noop_delete"
        if outcomes[slot] in ("applied", "created_by_update"):
            revision += 1
            revisions[slot] = revision
            if action == "delete":
                del live[entity]
            else:
                live[entity] = (data, slot, revision)
        versions.append((slot, dict(live)))
    return live, outcomes, revisions, versions


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("seed", [1, 2])
def test_fold_outcomes_revisions(spark, seed, width):
    rows = random_log(seed)
    live, outcomes, revisions, _ = sequential(rows)
    log = spark.createDataFrame(rows, LOG).repartition(3)
    got = {r.entity: (r.data, r.slot) for r in state.fold(log, width).collect()}
    assert got == {e: v[:2] for e, v in live.items()}
    assert {r.slot: r.outcome for r in state.outcomes(log, width).collect()} == outcomes
    revised = state.revisions(log, width)
    assert {r.slot: r.revision for r in revised.collect()} == revisions
    current = {r.entity: (r.data, r.revision) for r in state.current(revised).collect()}
    assert current == {e: (v[0], v[2]) for e, v in live.items()}


def test_state_at_any_position(spark):
    rows = random_log(3, n=150)
    _, _, _, versions = sequential(rows)
    log = spark.createDataFrame(rows, LOG)
    for slot, live in versions[::25]:
        got = {r.entity: r.data for r in state.state_at(log, slot, 16).collect()}
        assert got == {e: v[0] for e, v in live.items()}
    position = log.agg(F.floor(F.max("slot") / 2)).scalar()
    middle = spark.createDataFrame(rows, LOG).agg(F.floor(F.max("slot") / 2)).head()[0]
    expect = {e: v[0] for e, v in [live for s, live in versions if s <= middle][-1].items()}
    assert {r.entity: r.data for r in state.state_at(log, position, 16).collect()} == expect


def test_compacted_parts_of_any_split_merge(spark):
    rows = sorted(random_log(4))
    live = sequential(rows)[0]
    for cut in (1, 57, 200, 399):
        parts = [state.compact(spark.createDataFrame(p, LOG), 32) for p in (rows[:cut], rows[cut:])]
        # The first part is delivered twice: a replay must not change anything.
        merged = state.merge(parts[0].unionByName(parts[1]).unionByName(parts[0]))
        assert {r.entity: (r.data, r.slot) for r in merged.collect()} == {e: v[:2] for e, v in live.items()}


@pytest.mark.parametrize("width", [5, 1 << 22])
def test_as_of(spark, width):
    rows = random_log(5, n=200)
    _, _, _, versions = sequential(rows)
    rng = random.Random(9)
    top = max(r[0] for r in rows)
    reads = [(i, rng.choice(["hot", "e1", "e2", "nobody"]), rng.randrange(0, top + 5)) for i in range(150)]
    want = {}
    for i, entity, slot in reads:
        seen = {}
        for s, live in versions:
            if s <= slot:
                seen = live
        hit = seen.get(entity)
        want[i] = (hit[1], hit[0]) if hit else (0, None)
    df = spark.createDataFrame(reads, "read_id bigint, entity string, slot bigint")
    got = state.as_of(df, spark.createDataFrame(rows, LOG), width).collect()
    assert {r.read_id: (r.seen_slot, r.seen_data) for r in got} == want


def test_history_watch_get_lookup(spark):
    rows = random_log(6)
    live, _, revisions, _ = sequential(rows)
    revised = state.revisions(spark.createDataFrame(rows, LOG), 50)
    by_entity = {}
    for slot, entity, action, _, _ in sorted(rows):
        if slot in revisions:
            by_entity.setdefault(entity, []).append((revisions[slot], action))
    kept = {}
    for r in state.history(revised).collect():
        kept.setdefault(r.entity, set()).add(r.revision)
    assert kept == {e: {v for v, _ in vs[-10:]} for e, vs in by_entity.items()}
    watched = {r.revision for r in state.watch(revised, "e1").collect()}
    assert watched == {v for v, a in by_entity["e1"] if a != "delete"}
    table = state.current(revised)
    asked = spark.createDataFrame([("hot",), ("nobody",), ("e1",)], "entity string")
    got = {r.entity: (r.found, r.revision) for r in state.get(table, asked).collect()}
    assert got == {e: (e in live, live[e][2] if e in live else 0) for e in ("hot", "nobody", "e1")}
    joined = state.lookup(asked, table).collect()
    assert {r.entity: r.state_data for r in joined} == {e: live[e][0] if e in live else None for e in ("hot", "nobody", "e1")}


def test_put_delete(spark):
    ops = [(1, "a", "put", "x"), (2, "a", "delete", None), (3, "a", "delete", None), (4, "b", "put", ""), (5, "", "put", "x")]
    df = spark.createDataFrame(ops, "slot bigint, entity string, action string, data string")
    got = {r.slot: r.outcome for r in state.put_delete(df).collect()}
    assert got == {1: "written", 2: "deleted", 3: "not_found", 4: "error", 5: "error"}


def test_compare_and_set(spark):
    rows = [
        (1, "a", 0, 0, "x"),
        (2, "a", 0, 0, "y"),
        (3, "b", 4, 5, "x"),
        (4, "b", 5, 5, "y"),
        (5, "b", 5, 5, "z"),
        (6, "c", 0, 3, "x"),
    ]
    df = spark.createDataFrame(rows, "arrival bigint, entity string, expected_revision bigint, current_revision bigint, data string")
    got = {r.arrival: r.outcome for r in state.compare_and_set(df).collect()}
    assert got == {
        1: "created",
        2: "conflict_exists",
        3: "conflict_revision",
        4: "updated",
        5: "conflict_revision",
        6: "conflict_exists",
    }


@pytest.mark.parametrize("width", [3, 20, 1 << 22])
def test_running_values(spark, width):
    rng = random.Random(width)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}", rng.choice([None, rng.randrange(100)])) for i in range(-30, 170)]
    want = {}
    for i, k, v in rows:
        before = [x for j, kk, x in rows if kk == k and j < i and x is not None]
        after = [x for j, kk, x in rows if kk == k and j > i and x is not None]
        upto = before + ([v] if v is not None else [])
        want[i] = (
            upto[-1] if upto else None,
            before[-1] if before else None,
            upto[0] if upto else None,
            sum(upto),
            max(upto, default=None),
            min(before, default=None),
            after[0] if after else None,
        )
    df = spark.createDataFrame(rows, "i bigint, k string, v bigint").repartition(5)
    v = F.col("v")
    specs = [
        Running("last", v, "last"),
        Running("prev", v, "last", strict=True),
        Running("first", v, "first"),
        Running("total", v, "sum"),
        Running("high", v, "max"),
        Running("low", v, "min", strict=True),
        Running("next", v, "next"),
    ]
    out = running(df, ["k"], "i", specs, width=width)
    got = {r.i: (r.last, r.prev, r.first, r.total, r.high, r.low, r.next) for r in out.collect()}
    assert got == want


def test_number_rows_and_newest(spark):
    slots = sorted(random.Random(1).sample(range(10_000), 300))
    df = spark.createDataFrame([(s, s % 3) for s in slots], "s bigint, k bigint").repartition(4)
    for width in (1, 100, 1 << 22):
        got = {r.s: r.n for r in number_rows(df, "s", "n", start=10, width=width).collect()}
        assert got == {s: 11 + i for i, s in enumerate(slots)}
    top = newest_per_key(df, "k", "s", 4).collect()
    assert {r.s for r in top} == {s for k in range(3) for s in [x for x in slots if x % 3 == k][-4:]}


def test_append_validation_and_slots(spark):
    rows = [
        (1, "n", "e", "create", "x"),
        (2, "", "e", "create", "x"),
        (3, "n", "", "create", "x"),
        (4, "n", "e", "", "x"),
        (5, "n", "e", "invalid", "x"),
        (6, "n", "e", "create", ""),
        (7, "n", "e", "delete", None),
        (8, "n", "e", "update", "y"),
    ]
    df = spark.createDataFrame(rows, "pos bigint, actor string, entity string, action string, data string")
    checked = {r.pos: r.reject_reason for r in changelog.check_entries(df).collect()}
    assert checked == {
        1: None,
        2: "empty actor",
        3: "empty entity",
        4: "empty action",
        5: "unknown action",
        6: "empty data",
        7: None,
        8: None,
    }
    got = [(r.pos, r.slot, r.subject, r.data) for r in changelog.append(df, "pos", last_slot=41).orderBy("slot").collect()]
    assert got == [
        (1, 42, "humus.n.create", "x"),
        (7, 43, "humus.n.delete", "null"),
        (8, 44, "humus.n.update", "y"),
    ]


def test_log_table_prunes_segments(spark, tmp_path):
    rows = random_log(8)
    path = str(tmp_path / "log")
    changelog.write_log(spark.createDataFrame(rows, LOG), path, width=100)
    table = spark.read.parquet(path)
    assert table.count() == len(rows)
    read = changelog.read_log(table, after=200).collect()
    assert [r.slot for r in read] == sorted(r[0] for r in rows if r[0] > 200)


def test_retention_and_order(spark):
    rows = [(i, 1_000 + 10 * i) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "slot bigint, at bigint").withColumn("ts", F.timestamp_seconds("at"))
    assert {r.slot for r in changelog.retain(df, 300, 1000, width=7).collect()} == set(range(70, 101))
    for keep in (0, 1, 7, 12, 99, 100, 101):
        assert {r.slot for r in changelog.retain(df, 10_000, keep, width=7).collect()} == set(range(101 - min(keep, 100), 101))
    assert changelog.retain(df.limit(0), 10_000, 12).collect() == []
    arrived = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 9), (5, 8), (6, 10)], "arrival bigint, slot bigint")
    assert [r.arrival for r in changelog.out_of_order(arrived, "arrival", width=2).orderBy("arrival").collect()] == [3, 5]


def test_status_upsert(spark):
    rows = [(1, "u1", "a"), (2, "u2", "a"), (3, "u1", "b"), (4, None, "x"), (5, "u1", None)]
    df = spark.createDataFrame(rows, "pos bigint, entity_id string, status string").select(
        "*", F.lit("m").alias("message"), F.timestamp_seconds("pos").alias("ts")
    )
    got = [
        (r.pos, r.entity, r.action, r.status, r.created_at.second, r.last_update.second)
        for r in state.status_upsert(df, "pos", width=2).orderBy("pos").collect()
    ]
    assert got == [
        (1, "entity-u1", "create", "a", 1, 1),
        (2, "entity-u2", "create", "a", 2, 2),
        (3, "entity-u1", "update", "b", 1, 3),
        (5, "entity-u1", "update", None, 1, 5),
    ]


def test_reorder_alerts(spark):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(3)}", rng.randrange(20), i, float(rng.randrange(1, 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "part string, day int, line int, qty double")
    want = set()
    for part in {r[0] for r in rows}:
        left = 200.0
        for _, day, line, qty in sorted((r for r in rows if r[0] == part), key=lambda r: (r[1], r[2])):
            crossed = left >= 50 > left - qty
            left -= qty
            if crossed:
                want.add((part, day, line, left))
    got = logstats.reorder_alerts(df, "part", ["day", "line"], "qty", 200.0, 50.0, F.floor(F.col("day") / 4))
    assert {(r.part, r.day, r.line, r.stock) for r in got.collect()} == want
