"""Captures, parsers, reactors, chains and responders on small vectors."""

import json

import pytest
from pyspark.sql import functions as F

from eventflow.functions import signatures as sig
from eventflow.operators import changelog, events, outbox, parsers, reactors, responder, state, transforms
from eventflow.operators.chain import Step, run_steps
from eventflow.plans.reactions import make_responder, make_scorer
from eventflow.sources import captures, rawlog

RAW = "event_id bigint, subject string, data string"


def raw(spark, rows):
    df = spark.createDataFrame([(i, s, d if d is None or isinstance(d, str) else json.dumps(d)) for i, (s, d) in enumerate(rows)], RAW)
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")))


def charge(kind, **fields):
    return {"type": kind, "data": {"object": {"id": "ch_1", "amount": 5000, "currency": "usd", "customer": "cus_a", **fields}}}


def test_ingest_and_wire(spark):
    rows = raw(spark, [("stripe.webhook", "x"), ("river.a", "y"), ("", "z"), ("s", ""), ("r", None)])
    got = [(r.subject, r.reject_reason) for r in rawlog.ingest(rows).orderBy("event_id").collect()]
    assert got == [
        ("river.stripe.webhook", None),
        ("river.a", None),
        ("river.", "empty subject"),
        ("river.s", "empty data"),
        ("river.r", "empty data"),
    ]
    wire = rows.where("event_id < 2").select("event_id", rawlog.encode_wire(rows).alias("wire"))
    bad = spark.createDataFrame([(5, "{"), (6, '{"subject":1,"data":"!!"}'), (7, "[]")], "event_id bigint, wire string")
    back = {r.event_id: (r.decoded, r.subject, r.data) for r in rawlog.decode_wire(wire.unionByName(bad)).collect()}
    assert back[0] == (True, "stripe.webhook", "x")
    assert [back[i][0] for i in (5, 6, 7)] == [False, False, False]


def test_scan_table_prunes(spark, tmp_path):
    rows = raw(spark, [("river.stripe.webhook", "a"), ("river.general.x", "b"), ("river.general.y.z", "c")])
    path = str(tmp_path / "raw")
    rawlog.write_raw(rows, path)
    scan = rawlog.scan_table(spark, path, "general.>")
    assert {r.data for r in scan.collect()} == {"b", "c"}
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan and "StringStartsWith(subject,river.general.)" in plan
    assert rawlog.scan_table(spark, path).count() == 3
    assert rawlog.scan_table(spark, path, "river.*.webhook").count() == 1


def test_parse_payment(spark):
    rows = raw(
        spark,
        [
            ("r", charge("charge.succeeded", metadata={"item_id": "jacket"})),
            ("r", charge("charge.failed", failure_message="insufficient_funds", metadata={"item_id": "x"})),
            ("r", charge("charge.refunded")),
            ("r", "{bad"),
            ("r", charge("charge.succeeded", metadata={})),
            ("r", charge("charge.succeeded", metadata={"item_id": ""})),
            ("r", charge("charge.succeeded", amount="5000")),
            ("r", charge("charge.succeeded", amount=50.5)),
            ("r", {"type": "charge.succeeded"}),
            ("r", charge("charge.succeeded", customer=7)),
            ("r", charge("charge.succeeded", metadata={"item_id": "x", "n": 1})),
            ("r", charge("charge.succeeded", metadata={"item_id": None}, currency=None)),
            ("r", {"type": 3}),
            ("r", charge("charge.succeeded", customer={"id": "x"})),
            ("r", charge("charge.succeeded", customer='q":1', metadata={"item_id": 'a":{', "k": "\\"})),
        ],
    )
    got = {r.event_id: (r.subject, *r.payment) for r in parsers.parse_payment(rows).collect()}
    assert got == {
        0: ("payment.completed", "cus_a", 50.0, "usd", "jacket", None),
        1: ("payment.failed", "cus_a", 50.0, "usd", "x", "insufficient_funds"),
        4: ("payment.completed", "cus_a", 50.0, "usd", "unknown", None),
        5: ("payment.completed", "cus_a", 50.0, "usd", "unknown", None),
        8: ("payment.completed", "", 0.0, "", "unknown", None),
        11: ("payment.completed", "cus_a", 50.0, "", "unknown", None),
        14: ("payment.completed", 'q":1', 50.0, "usd", 'a":{', None),
    }


def effects_of(df):
    return [(r.kind, r.target, r.action, json.loads(r.data)) for r in df.collect()]


def test_payment_reactions(spark):
    rows = raw(
        spark,
        [
            ("r", charge("charge.succeeded", amount=25000, customer="alice")),
            ("r", charge("charge.succeeded", amount=9999, customer="bob")),
            ("r", charge("charge.failed", amount=5000, customer="carl", failure_message="card_declined")),
        ],
    )
    paid = parsers.parse_payment(rows)
    done = effects_of(reactors.on_payment_completed(paid))
    assert [(k, t) for k, t, _, _ in done] == [
        ("change", "task-alice-1700000000"),
        ("event", "followup.required"),
        ("event", "email.send"),
        ("change", "task-bob-1700000001"),
        ("event", "followup.required"),
    ]
    task = done[0][3]
    assert task["description"] == "Follow up on purchase of unknown (250.00 usd)"
    assert (task["status"], task["due_date"]) == ("pending", "2023-11-15T22:13:20.000000Z")
    failed = effects_of(reactors.on_payment_failed(paid))
    assert failed[0][1:3] == ("task-carl-failed-1700000002", "create")
    assert failed[0][3]["due_date"] == "2023-11-15T00:13:22.000000Z"
    assert failed[1][3]["reason"] == "payment_failed: card_declined"
    both = effects_of(reactors.on_payment(paid))
    assert sorted(map(repr, both)) == sorted(map(repr, done + failed))


def test_task_lifecycle(spark):
    rows = raw(spark, [("r", charge("charge.succeeded", customer="a")), ("r", charge("charge.failed", customer="b"))])
    log = changelog.append(reactors.changes(reactors.on_payment(parsers.parse_payment(rows))), "event_id")
    table = state.fold(log)
    tasks = {r.entity: r.status for r in reactors.tasks(table).collect()}
    assert tasks == {"task-a-1700000000": "pending", "task-b-failed-1700000001": "urgent"}
    asked = spark.createDataFrame([("task-a-1700000000",), ("nope",)], "task_id string").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_500))
    )
    done = {r.task_id: r for r in reactors.complete_tasks(asked, table).collect()}
    assert done["nope"].reject_reason == "not found"
    body = json.loads(done["task-a-1700000000"].data)
    assert (body["status"], body["updated_at"]) == ("completed", "2023-11-14T22:21:40.000000Z")
    updates = reactors.complete_tasks(asked, table).where("reject_reason is null").withColumn("slot", F.lit(99).cast("bigint"))
    after = state.fold(log.select("slot", "entity", "action", "data").unionByName(updates.select("slot", "entity", "action", "data")))
    assert {r.entity: r.status for r in reactors.tasks(after).collect()}["task-a-1700000000"] == "completed"


def test_general_events_and_reactions(spark):
    rows = raw(
        spark,
        [
            ("river.general.a", {"type": "data.received", "source": "api", "data": {"k": [1, None]}}),
            ("river.general.a", {"type": "status.update", "entity_id": 42, "status": "s"}),
            ("river.general.a", {"type": "notification", "priority": "high", "message": "m", "recipient": "r"}),
            ("river.general.a", {"type": "notification", "priority": "low", "message": "m"}),
            ("river.general.a", {"type": "order.shipped", "n": 1}),
            ("river.general.a", {"type": 7}),
            ("river.general.a", "[1]"),
            ("river.general.a", {"type": ""}),
        ],
    )
    parsed = parsers.parse_general(rows)
    got = {r.event_id: (r.subject, json.loads(r.data)) for r in parsed.collect()}
    assert got[0] == ("data.received", {"event_type": "data.received", "timestamp": None, "source": "api", "data": {"k": [1, None]}})
    assert got[1] == ("status.update", {"event_type": "status.update", "entity_id": 42, "status": "s", "message": None})
    assert got[4] == ("general.event", {"event_type": "order.shipped", "raw_data": {"type": "order.shipped", "n": 1}})
    assert got[7][0] == "general.event"
    assert set(got) == {0, 1, 2, 3, 4, 7}

    record, confirm = effects_of(reactors.on_data_received(parsed))
    assert record[:3] == ("change", "data-record-0", "create")
    assert record[3] == {"id": "data-record-0", "source": "api", "data": {"k": [1, None]}, "received_at": "2023-11-14T22:13:20Z", "processed": True}
    assert confirm[3] == {"record_id": "data-record-0", "status": "processed"}

    urgent, queued = effects_of(reactors.on_notification(parsed))
    assert urgent[:2] == ("event", "notification.send.immediate") and urgent[3] == got[2][1]
    assert queued[1] == "notification-3" and queued[3]["sent"] is False and queued[3]["recipient"] is None

    archived = effects_of(reactors.archive(parsed))
    assert [a[1] for a in archived] == ["event-4", "event-7"]
    assert archived[0][3]["data"]["raw_data"]["n"] == 1
    assert reactors.emitted(reactors.on_notification(parsed)).count() == 1
    odd = parsed.withColumn("subject", F.lit("general."))
    assert reactors.archive(odd).count() == 0


def test_webhook_parser(spark):
    rows = raw(
        spark,
        [
            ("r", {"type": "a", "data": {"x": 1}, "timestamp": "t"}),
            ("r", {"payload": "p"}),
            ("r", {"type": False, "data": None, "payload": {"y": 2}}),
            ("r", {}),
            ("r", "{bad"),
        ],
    )
    got = [(r.original_type, r.timestamp, r.body) for r in parsers.parse_webhook(rows).orderBy("event_id").collect()]
    assert got == [
        ("a", "t", '{"x":1}'),
        ("unknown", "2023-11-14T22:13:21Z", '"p"'),
        ("unknown", "2023-11-14T22:13:22Z", '{"y":2}'),
        ("unknown", "2023-11-14T22:13:23Z", "{}"),
    ]


def test_chat_parser(spark):
    full = {
        "update_id": 1,
        "message": {
            "message_id": 9,
            "from": {"id": 5, "first_name": "Ann", "username": "ann"},
            "chat": {"id": -7, "type": "group", "title": "T"},
            "date": 1_704_067_200,
            "text": "hi @bob and @eve",
            "reply_to_message": {"message_id": 3},
            "entities": [
                {"type": "mention", "offset": 3, "length": 4},
                {"type": "bold", "offset": 0, "length": 2},
                {"type": "text_mention", "offset": 12, "length": 4},
            ],
        },
    }
    bare = {"update_id": 2, "message": {"message_id": 1}}
    rows = raw(
        spark,
        [
            ("r", {"body": full}),
            ("r", {"body": json.dumps(full)}),
            ("r", {"body": bare}),
            ("r", {"body": {"update_id": 3}}),
            ("r", {"body": {"message": bare["message"]}}),
            ("r", {"other": 1}),
        ],
    )
    got = {r.event_id: r.message for r in parsers.parse_chat(rows).collect()}
    assert set(got) == {0, 1, 2}
    m = got[0]
    assert (m.chat_id, m.user_id, m.username, m.reply_to) == ("-7", "5", "ann", "3")
    assert m.mentions == ["@bob", "@eve"]
    assert m.metadata == {"message_id": "9", "chat_type": "group", "chat_title": "T"}
    assert m.timestamp == "2024-01-01T00:00:00Z"
    assert got[1] == m
    assert (got[2].text, got[2].mentions, got[2].chat_id, got[2].metadata) == ("", [], "", {"message_id": "1", "chat_type": "unknown"})


def test_chat_capture(spark):
    rows = spark.createDataFrame([(1, '{"update_id":1}'), (2, "nope"), (3, '{"update_id":1,"message":{"message_id":1}}')], "i int, body string")
    got = captures.capture_chat(rows.withColumn("ts", F.current_timestamp()), "chat", "river.chat")
    assert {r.i: (r.status, r.landed) for r in got.collect()} == {1: (200, False), 2: (400, False), 3: (200, True)}


def test_webhook_capture_checks(spark):
    body = '{"a":1}'
    signed = spark.range(1).select(sig.hmac_hex("k", F.lit(body))).head()[0]
    rows = [
        ("POST", True, {"X-Signature-256": signed, "X-A": "1", "X-B": ""}, body),
        ("POST", True, {"X-Signature-256": "bad"}, body),
        ("POST", True, {}, body),
        ("GET", True, {}, body),
        ("POST", False, {}, body),
        ("POST", True, {"X-Signature-256": "?"}, "{"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, method string, source_running boolean, headers map<string,string>, body string")
    df = df.select("*", F.lit("/in").alias("path"), F.timestamp_seconds(F.lit(0)).alias("captured_at"))
    got = captures.capture_webhooks(df, "src", "river.src", ["X-A", "X-B", "X-C"], {"/in": "k"}).orderBy("i").collect()
    assert [r.status for r in got] == [200, 401, 401, 405, 503, 401]
    assert json.loads(got[0].data) == {"headers": {"X-A": "1"}, "body": {"a": 1}, "timestamp": "1970-01-01T00:00:00.000000Z", "source": "src"}
    open_door = captures.capture_webhooks(df, "src", "river.src", []).orderBy("i").collect()
    assert [r.status for r in open_door] == [200, 200, 200, 405, 503, 500]
    assert "headers" not in json.loads(open_door[0].data)


def test_poll_capture(spark):
    rows = [
        (1, 200, '{"meta":{"c":"a b"}}'),
        (2, 500, '{"meta":{}}'),
        (3, None, None),
        (4, 200, "{bad"),
        (5, 200, '{"meta":{"c":7}}'),
        (6, 200, '{"meta":{"c":null}}'),
    ]
    df = spark.createDataFrame(rows, "event_id bigint, status_code int, body string").select(
        "*",
        F.lit("s").alias("source"),
        F.lit("http://x/y?k=1").alias("url"),
        F.timestamp_seconds(F.col("event_id")).alias("ts"),
        F.create_map(F.lit("H"), F.array(F.lit("1"), F.lit("2")), F.lit("E"), F.array().cast("array<string>")).alias("headers"),
    )
    for width in (2, 100):
        got = captures.capture_polls(df, "$.meta.c", "since", F.lit("river.s"), width=width).orderBy("event_id").collect()
        assert [r.failed for r in got] == [False, False, True, True, False, False]
        assert [r.cursor for r in got] == ["a b", "a b", "a b", "a b", "7", "7"]
        assert got[1].request_url == "http://x/y?k=1&since=a+b" and got[0].request_url == "http://x/y?k=1"
        assert json.loads(got[1].data)["headers"] == {"H": "1"}
        assert json.loads(got[1].data)["status_code"] == 500


def test_event_rules(spark):
    rows = spark.createDataFrame(
        [("", "s", "d", 1), ("a", "", "d", 1), ("a", "s", "", 1), ("a", "s", "d", None), ("a", "s", "{}", 1), (None, None, None, None)],
        "subject string, source string, data string, t int",
    ).withColumn("ts", F.timestamp_seconds("t"))
    got = [r.reject_reason for r in events.validate(rows).collect()]
    assert got == ["empty subject", "empty source", "empty data", "missing time", None, "empty subject"]
    assert events.accepted(events.validate(rows)).count() == 1
    assert events.rejected(events.validate(rows)).count() == 5
    value = events.publish(rows.where("data = '{}'")).head()
    assert (value["key"], json.loads(value["value"])["ts"]) == ("a", "1970-01-01T00:00:01.000000Z")
    named = events.default_source(rows, "scorer", "treehouse").select("source").collect()
    assert [r.source for r in named][:2] == ["s", "treehouse:scorer"]


def test_event_table(spark, tmp_path):
    rows = raw(spark, [("a.b", "x"), ("c.d", "y"), ("", "z")]).withColumn("source", F.lit("s"))
    events.write_events(rows, str(tmp_path / "ev"))
    assert {r.subject_head: r.data for r in spark.read.parquet(str(tmp_path / "ev")).collect()} == {"a": "x", "c": "y"}


CONTACTS = [
    ("c1", 250, "VP Engineering", "technology", 85),
    ("c2", 600, "CEO", "finance", 105),
    ("c3", 800, "CTO", "technology", 105),
    ("c4", 200, "VP", "finance", 85),
    ("c5", 10, "Engineer", "retail", 0),
    ("c6", 21, "Sales Manager", None, 30),
    ("c7", None, "CEO", "finance", None),
    ("c8", 10, None, "finance", None),
]


def contacts(spark):
    schema = "id string, company_size bigint, title string, industry string, want int"
    return spark.createDataFrame(CONTACTS, schema).withColumn("email", F.lit("e"))


def test_scoring(spark):
    scored = transforms.score_contacts(contacts(spark))
    got = {r.id: (r.score, r.signals) for r in scored.collect()}
    assert {i: s for i, (s, _) in got.items()} == {c[0]: c[4] for c in CONTACTS if c[4] is not None}
    assert got["c1"][1] == ["mid_market", "executive", "target_industry"] and got["c5"][1] == []
    pursue = {r.id: (r.pursue, r.priority) for r in transforms.qualify_leads(scored).collect()}
    assert [pursue[i][0] for i in ("c3", "c4", "c5")] == [True, True, False]
    assert [pursue[i][1] for i in ("c2", "c1", "c6", "c5")] == ["high", "medium", "none", "none"]
    tiers = {r.id: r.tier for r in transforms.tier_leads(scored).collect()}
    assert (tiers["c2"], tiers["c6"]) == ("enterprise", "startup")
    unscored = scored.withColumn("score", F.lit(None).cast("bigint"))
    assert {r.tier for r in transforms.tier_leads(unscored).collect()} == {"startup"}


def test_python_transform_agrees_with_columns(spark):
    rows = contacts(spark)
    body = rows.select("id", F.to_json(F.struct("id", "company_size", "title", "industry")).alias("data"))
    extra = spark.createDataFrame([("bad", "{"), ("arr", "[1]"), ("nul", None)], "id string, data string")
    done = {r.id: (r.outcome, r.data) for r in transforms.map_payloads(body.unionByName(extra), make_scorer).collect()}
    assert json.loads(done["c1"][1])["score"] == 85
    assert done["c7"][0].startswith("error") and done["c8"][0].startswith("error")
    assert (done["bad"][0], done["arr"][0], done["nul"][0]) == ("not json", "not an object", "not an object")

    def make_odd():
        return lambda d: None if d["id"] == "c1" else ["no"]

    odd = {r.id: r.outcome for r in transforms.map_payloads(body.where("id in ('c1','c2')"), make_odd).collect()}
    assert odd == {"c1": "filtered", "c2": "not an object"}


def test_chain_reads_only_what_it_subscribes(spark):
    rows = spark.createDataFrame([("in.a", '{"n":1}'), ("other", '{"n":5}')], "subject string, data string").withColumn("source", F.lit("x"))

    def bump(df):
        n = F.get_json_object("data", "$.n").cast("int") + 1
        return df.withColumn("data", F.to_json(F.struct(n.alias("n"))))

    steps = [Step("one", "in.>", "mid.{n}", bump), Step("two", "mid.*", "out", bump)]
    got = {(r.subject, r.data, r.source) for r in run_steps(rows, steps).collect()}
    assert got == {
        ("in.a", '{"n":1}', "x"),
        ("other", '{"n":5}', "x"),
        ("mid.2", '{"n":2}', "one"),
        ("out", '{"n":3}', "two"),
    }


def test_model_step(spark):
    rows = spark.createDataFrame(
        [("l", '{"contact_id":"c1","score":3}'), ("l", '{"id":"c0","score":0}'), ("l", "[1]")], "subject string, data string"
    ).withColumn("source", F.lit("x"))
    out = responder.model_step(rows, "q", "{{.contact_id}}#{{.score}}", "lead.done", make_responder)
    row = out.collect()
    # The second prompt ends in #0 and is refused, the third payload is no object.
    assert [(r.entity, json.loads(r.answer), r.subject, r.source) for r in row] == [("c1", {"response": "seen c1#3"}, "lead.done", "nim:q")]
    entry = responder.recorded(out, "q").head()
    assert (entry.actor, entry.action, entry.entity) == ("q", "update", "c1")


def test_outbox(spark):
    rows = spark.createDataFrame(
        [
            ("song.telegram.1", '{"platform":"telegram","chat_id":"1","text":"a","reply_to":"9"}'),
            ("song.telegram.2", '{"platform":"slack","chat_id":"2","text":"b"}'),
            ("song.telegram.3", "{bad"),
            ("song.other.4", '{"platform":"telegram","chat_id":"4","text":"d"}'),
        ],
        "subject string, data string",
    )
    got = outbox.messages(rows, "song.telegram.>", "telegram").collect()
    assert [(r.chat_id, r.text) for r in got] == [("1", "a")] and "reply_to" not in got[0]
