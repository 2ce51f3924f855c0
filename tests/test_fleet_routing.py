"""Fleet roll-ups and change folding, routing, consumer lag."""

import random

import pytest
from pyspark.sql import functions as F

from eventflow.functions.subjects import subject_match
from eventflow.operators import fleet, logstats, routing

GIB = 1024**3
NODES = "node_id string, hostname string, ram_total bigint, cpu_cores bigint, gpu_vram bigint"
PROCS = "process_id string, node_id string, kind string, ram_allocated bigint"


def test_usage_and_summary(spark):
    nodes = spark.createDataFrame(
        [("n1", "a", 16 * GIB, 8, 0), ("n2", "b", 16 * GIB, 4, 24 * GIB), ("n3", "c", 0, 1, 0)], NODES
    )
    procs = spark.createDataFrame(
        [("p1", "n1", "tree", 4 * GIB), ("p2", "n1", "nim", 2 * GIB), ("p3", "n2", "treehouse", 4 * GIB)], PROCS
    )
    usage = {r.node_id: r for r in fleet.node_usage(nodes, procs).collect()}
    assert (usage["n1"].occupancy, usage["n2"].occupancy, usage["n3"].occupancy) == (37.5, 25.0, 0.0)
    assert (usage["n1"].ram_available, usage["n3"].ram_available, usage["n1"].process_count) == (10 * GIB, 0, 2)
    total = fleet.summary(nodes.where("node_id <> 'n3'"), procs).head()
    assert total.occupancy == 31.25
    assert (total.regular_nodes, total.gpu_nodes, total.tree_count, total.treehouse_ram) == (1, 1, 1, 4 * GIB)
    empty = fleet.summary(nodes.limit(0), procs.limit(0)).head()
    assert (empty.regular_nodes, empty.total_ram, empty.nim_ram, empty.occupancy) == (0, 0, 0, 0.0)


def test_overcommitted_node(spark):
    nodes = spark.createDataFrame([("n1", "a", GIB, 1, 0)], NODES)
    procs = spark.createDataFrame([("p", "n1", "nim", 2 * GIB)], PROCS)
    row = fleet.node_usage(nodes, procs).head()
    assert (row.ram_available, row.occupancy) == (0, 200.0)


def test_attach(spark):
    nodes = spark.createDataFrame([("n2", "a", 1, 1, 0), ("n1", "b", 1, 1, 0)], NODES)
    procs = spark.createDataFrame([("p1", "n2", "nim", 1), ("p2", "gone", "nim", 1), ("p3", None, "nim", 1)], PROCS)
    got = {r.process_id: r.node_id for r in fleet.attach(procs, nodes).collect()}
    assert got == {"p1": "n2", "p2": "n1", "p3": "n1"}
    assert fleet.attach(procs, nodes.limit(0)).collect() == []


def test_detection(spark):
    subs = spark.createDataFrame(
        [("river.general.>", ""), ("river.general.>", ""), ("river.general.>", "q"), ("_INBOX.x", ""), ("", "")],
        "subject string, queue string",
    )
    got = {(r.subject, r.queue): (r.n_subjects, r.process_id) for r in fleet.detect_processes(subs).collect()}
    assert got == {("river.general.>", ""): (2, "tree-general"), ("river.general.>", "q"): (1, "tree-general")}
    consumers = spark.createDataFrame(
        [("S", "c1", "payment.>"), ("S", "", "lead.scored"), ("S", "c3", "")],
        "stream_name string, name string, filter_subject string",
    )
    assert {r.process_id for r in fleet.detect_consumers(consumers).collect()} == {"nim-c1", "treehouse-lead-scored"}


def test_snapshot_fingerprint(spark):
    nodes = spark.createDataFrame([("n1", "a", GIB, 1, 0), ("n2", "b", GIB, 1, 0)], NODES)
    procs = spark.createDataFrame([("p", "n1", "nim", 1)], PROCS)
    before = fleet.fingerprint(fleet.snapshot(nodes, procs))
    assert fleet.changed_since(fleet.snapshot(nodes, procs), None)
    assert not fleet.changed_since(fleet.snapshot(nodes.repartition(3), procs), before)
    assert fleet.changed_since(fleet.snapshot(nodes, procs.withColumn("ram_allocated", F.lit(2).cast("bigint"))), before)


def test_union_nodes_newest_wins(spark):
    schema = "node_id string, hostname string, seen int"
    local = spark.createDataFrame([("n1", "old", 1), ("n2", "x", 1)], schema)
    peers = spark.createDataFrame([("n1", "new", 2), ("n3", "y", 2)], schema)
    assert {r.node_id: r.hostname for r in fleet.union_nodes(local, peers).collect()} == {"n1": "new", "n2": "x", "n3": "y"}


# --- change folding -----------------------------------------------------------------------

CHANGES = "slot bigint, type string, node_id string, process_id string, ram bigint"


def sequential_fleet(rows):
    """Changes applied one at a time, with set semantics on (node, process)."""
    nodes, procs, applied = {}, {}, {}
    for slot, kind, node, process, ram in sorted(rows):
        ok = True
        if kind == "land_added":
            nodes[node] = ram
            procs = {k: v for k, v in procs.items() if k[0] != node}
        elif kind == "land_removed":
            ok = node in nodes
            if ok:
                del nodes[node]
                procs = {k: v for k, v in procs.items() if k[0] != node}
        elif kind == "land_updated":
            ok = node in nodes
            if ok:
                nodes[node] = ram
        elif kind == "process_added":
            ok = node in nodes
            if ok:
                procs[(node, process)] = ram
        elif kind == "process_removed":
            if node is None:
                node = min((n for n, p in procs if p == process), default=None)
            ok = (node, process) in procs
            procs.pop((node, process), None)
        elif kind == "process_updated":
            hit = [k for k in procs if k[1] == process]
            ok = bool(hit)
            for k in hit:
                procs[k] = ram
        else:
            ok = False
        applied[slot] = ok
    return nodes, procs, applied


KINDS = ["land_added", "land_removed", "land_updated", "process_added", "process_added", "process_added", "process_removed", "process_updated", "bogus"]


@pytest.mark.parametrize(("seed", "width"), [(1, 9), (2, 9), (3, 1 << 22), (4, 1)])
def test_fleet_changes(spark, seed, width):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        node = "n0" if rng.random() < 0.4 else f"n{rng.randrange(4)}"
        kind = rng.choice(KINDS)
        if kind == "process_removed" and rng.random() < 0.5:
            node = None
        rows.append((i * 2 + 1, kind, node, f"p{rng.randrange(6)}", rng.randrange(1000)))
    nodes, procs, applied = sequential_fleet(rows)
    df = spark.createDataFrame(rows, CHANGES).repartition(3)
    assert {r.node_id: r.ram for r in fleet.live_nodes(df).collect()} == nodes
    assert {(r.node_id, r.process_id): r.ram for r in fleet.live_processes(df).collect()} == procs
    assert {r.slot: r.applied for r in fleet.change_outcomes(df, width).collect()} == applied
    recent = fleet.recent(fleet.event_feed(df, width), 20).collect()
    assert [r.slot for r in recent] == sorted((s for s, ok in applied.items() if ok), reverse=True)[:20]


def test_removal_without_node(spark):
    rows = [
        (1, "land_added", "n2", None, 1),
        (2, "land_added", "n1", None, 1),
        (3, "process_added", "n2", "p1", 1),
        (4, "process_added", "n1", "p1", 1),
        (5, "process_added", "n1", "p2", 1),
        (6, "process_removed", None, "p1", None),  # the copy on n1
        (7, "process_removed", "n1", "p1", None),  # nothing left there
        (8, "process_removed", None, "p3", None),  # never ran
        (9, "land_removed", "n2", None, None),
        (10, "process_removed", None, "p1", None),  # ended with its node
        (11, "process_removed", None, None, None),
    ]
    df = spark.createDataFrame(rows, CHANGES)
    assert [(r.node_id, r.process_id) for r in fleet.live_processes(df).collect()] == [("n1", "p2")]
    failed = {r.slot for r in fleet.change_outcomes(df, 2).collect() if not r.applied}
    assert failed == {7, 8, 10, 11}


# --- routing ------------------------------------------------------------------------------

TOKENS = ["a", "b", "cc", "d+"]
ODD = ["", ".", ".a", "a.", "a..b", "a.x\ny", "a.x.b\n", "a.*.b", "a.>", "a.>.b", ">", "*"]


def matches(pattern, subject):
    """The rule, token by token."""
    want, have = pattern.split("."), subject.split(".")
    open_end = want[-1] == ">"
    if not open_end and "*" not in want:
        return pattern == subject
    body = want[:-1] if open_end else want
    fits = len(have) > len(body) if open_end else len(have) == len(body)
    return fits and "" not in have and all(w in ("*", h) for w, h in zip(body, have))


def random_subjects(rng, n):
    return sorted({".".join(rng.choice(TOKENS) for _ in range(rng.randrange(1, 6))) for _ in range(n)})


def random_patterns(rng, n):
    out = set()
    for _ in range(n):
        tokens = [rng.choice([*TOKENS, "*"]) for _ in range(rng.randrange(1, 5))]
        out.add(".".join(tokens + ([">"] if rng.random() < 0.4 else [])))
    return sorted(out | {">", "*", "a..b", "a..*", "a.", "a.>.b", "a.*.b", "a.>."})


@pytest.mark.parametrize("size", ["few", "many", "joined"])
def test_routing_follows_the_rule_at_every_size(spark, monkeypatch, size):
    rng = random.Random(11)
    subjects, patterns = [*random_subjects(rng, 200), *ODD], random_patterns(rng, 60)
    rows = [(i, s) for i, s in enumerate(subjects)] + [(1000 + i, subjects[0]) for i in range(300)] + [(2000, None)]
    want = {(i, p) for i, s in rows if s is not None for p in patterns if matches(p, s)}
    if size != "few":
        patterns = patterns + [f"unrelated.{i}.*" for i in range(70)]
    if size == "joined":
        monkeypatch.setattr(routing, "is_small", lambda table: False)
    events = spark.createDataFrame(rows, "event_id bigint, subject string")
    subs = spark.createDataFrame([(f"s{i}", p) for i, p in enumerate(patterns)], "subscriber string, pattern string")
    df = routing.fan_out(events, subs)
    got = [(r.event_id, r.pattern) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "rlike" not in text.lower()
    groups = routing.deliver_to_groups(events, subs, "subscriber").collect()
    assert len(groups) == len(want) and {r.event_id for r in groups} == {i for i, _ in want}


def test_literal_patterns_follow_the_same_rule(spark):
    rng = random.Random(12)
    subjects, patterns = [*random_subjects(rng, 60), *ODD], random_patterns(rng, 40)
    df = spark.createDataFrame(list(enumerate(subjects)), "i int, subject string")
    row = df.orderBy("i").select(*[subject_match(F.col("subject"), p).alias(f"m{n}") for n, p in enumerate(patterns)]).collect()
    for s, hits in zip(subjects, row, strict=True):
        assert list(hits) == [matches(p, s) for p in patterns], s


def test_two_patterns_two_deliveries(spark):
    events = spark.createDataFrame([(1, "river.stripe.webhook")], "event_id bigint, subject string")
    subs = spark.createDataFrame([("d", "river.*.webhook"), ("d", "river.stripe.>")], "subscriber string, pattern string")
    assert routing.fan_out(events, subs).count() == 2
    groups = routing.deliver_to_groups(events, subs, "subscriber").collect()
    assert [(r.event_id, r.subscriber) for r in groups] == [(1, "d")]
    assert routing.subjects_of(events, ["river.>", "river.stripe.webhook", "x"]).count() == 2


def test_consumer_lag(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a.x", "a.y", "b.x"])) for i in range(1, 301)]
    consumers = [
        ("c1", "a.>", 0, 0), ("c2", "a.x", 137, 20), ("c3", "*.x", 299, 298), ("c4", "b.y", 5, 1), ("c5", ">", 900, 150), ("c6", ">", -4, -9),
    ]
    raw = spark.createDataFrame(rows, "pos bigint, subject string")
    df = spark.createDataFrame(consumers, "consumer string, filter_subject string, position bigint, acked bigint")
    got = {r.consumer: (r.pending, r.ack_pending) for r in logstats.consumer_lag(raw, df, "pos", width=50).collect()}
    want = {
        c: (sum(1 for i, s in rows if i > p and matches(f, s)), sum(1 for i, s in rows if a < i <= p and matches(f, s)))
        for c, f, p, a in consumers
    }
    assert got == want
