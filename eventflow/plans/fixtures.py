"""Inputs of the queries, derived from the base tables.

Each fixture is a list of expressions over a base table or another fixture. The text is valid in
Spark SQL and in the checking engine alike, so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import load, load_stream, spread

CHARGE_OK = (
    """'{"type":"charge.succeeded","data":{"object":{"id":"ch_'||cast(event_id as string)||'","amount":'"""
    """||cast(cast(round(value*100) as bigint) as string)||',"currency":"usd","customer":"cus_'"""
    """||cast(user_id as string)||'","metadata":{'||case when event_id % 10 = 0 then '' else"""
    """ '"item_id":"item_'||cast(user_id % 7 as string)||'"' end||'}}}}'"""
)
CHARGE_FAILED = (
    """'{"type":"charge.failed","data":{"object":{"id":"ch_'||cast(event_id as string)||'","amount":'"""
    """||cast(cast(round(value*100) as bigint) as string)||',"currency":"usd","customer":"cus_'"""
    """||cast(user_id as string)||'","failure_message":"code_'||cast(user_id % 5 as string)"""
    """||'","metadata":{"item_id":"item_'||cast(user_id % 7 as string)||'"}}}}'"""
)
RECEIVED = """case when event_id % 25 = 0 then '{broken' else '{"type":"data.received","source":"app","data":"v'||cast(event_id as string)||'"}' end"""
NOTIFICATION = (
    """'{"type":"notification","priority":"'||case event_id % 4 when 0 then 'urgent' when 1 then 'high'"""
    """ when 2 then 'normal' else 'low' end||'","message":"m'||cast(event_id as string)"""
    """||'","recipient":"u'||cast(user_id as string)||'"}'"""
)
STATUS = (
    """case event_id % 3 when 0 then '{"type":"status.update","entity_id":"user-'||cast(user_id as string)"""
    """||'","status":"s'||cast(event_id % 4 as string)||'","message":"m'||cast(event_id as string)||'"}'"""
    """ when 1 then '{"type":"order.shipped","n":'||cast(event_id as string)||'}' else '{"no_type":1}' end"""
)

# A text inside a JSON string.
ESCAPED = (
    "replace(replace(replace(replace(replace(said, chr(92), chr(92)||chr(92)), chr(34), chr(92)||chr(34)),"
    " chr(10), chr(92)||'n'), chr(13), chr(92)||'r'), chr(9), chr(92)||'t')"
)

# name -> (table or fixture, expressions, filter)
FIXTURES: dict[str, tuple[str, list[str], str | None]] = {
    "fx_raw": (
        "events",
        [
            "event_id",
            "ts",
            "user_id",
            "case when event_type in ('purchase','error') then 'river.stripe.webhook' else 'river.general.'||event_type end as subject",
            f"case event_type when 'purchase' then {CHARGE_OK} when 'error' then {CHARGE_FAILED}"
            f" when 'view' then {RECEIVED} when 'click' then {NOTIFICATION} else {STATUS} end as data",
        ],
        None,
    ),
    "fx_payloads": (
        "fx_raw",
        [
            "event_id",
            "ts",
            "case event_id % 7 when 0 then '' when 1 then substr(subject, 7) else subject end as subject",
            "case when event_id % 11 = 0 then '' else data end as data",
        ],
        None,
    ),
    "fx_envelopes": (
        "fx_raw",
        [
            "event_id",
            "case when event_id % 13 = 0 then '' else subject end as subject",
            "case when event_id % 17 = 0 then '' else 'emitter-'||cast(event_id % 5 as string) end as source",
            "case when event_id % 19 = 0 then '' else data end as data",
            "case when event_id % 23 = 0 then null else ts end as ts",
        ],
        None,
    ),
    "fx_docs": (
        "fx_raw",
        [
            "event_id",
            "ts",
            "subject",
            """case event_id % 9 when 0 then '[1]' when 1 then 'null' when 2 then '"x"' else data end as data""",
        ],
        None,
    ),
    "fx_changelog": (
        "events",
        [
            "event_id + 1 as slot",
            "ts",
            "'user-'||cast(user_id as string) as entity",
            "case event_type when 'signup' then 'create' when 'error' then 'delete' else 'update' end as action",
            "case when event_type = 'error' then null else 'v'||cast(event_id as string) end as data",
            "'actor-'||cast(event_id % 3 as string) as actor",
        ],
        None,
    ),
    "fx_entries": (
        "events",
        [
            "event_id",
            "ts",
            "case when event_id % 17 = 0 then '' else 'actor-'||cast(event_id % 3 as string) end as actor",
            "case when event_id % 19 = 0 then '' else 'user-'||cast(user_id as string) end as entity",
            "case when event_id % 23 = 0 then 'upsert' when event_id % 29 = 0 then ''"
            " when event_type = 'signup' then 'create' when event_type = 'error' then 'delete' else 'update' end as action",
            "case when event_type = 'error' then null when event_id % 31 = 0 then '' else 'v'||cast(event_id as string) end as data",
        ],
        None,
    ),
    "fx_contacts": (
        "customer",
        [
            "'c'||cast(c_custkey as string) as id",
            "c_custkey",
            "c_name||'@x.com' as email",
            "case when c_custkey % 50 = 0 then null else cast(floor(abs(c_acctbal)/10) as bigint) end as company_size",
            "case c_custkey % 6 when 0 then 'CEO' when 1 then 'CTO' when 2 then 'VP Sales' when 3 then 'Director' when 4 then 'Manager' else 'Engineer' end as title",
            "case c_mktsegment when 'MACHINERY' then 'technology' when 'BUILDING' then 'finance' else lower(c_mktsegment) end as industry",
        ],
        None,
    ),
    "fx_nodes": (
        "supplier",
        [
            "'node-'||cast(s_suppkey as string) as node_id",
            "s_suppkey",
            "s_name as hostname",
            "cast(16 + (s_suppkey % 4)*16 as bigint)*1073741824 as ram_total",
            "cast(4 + (s_suppkey % 3)*4 as bigint) as cpu_cores",
            "case when s_suppkey % 5 = 0 then cast(24 as bigint)*1073741824 else cast(0 as bigint) end as gpu_vram",
            "s_suppkey % 2 = 0 as has_docker",
        ],
        None,
    ),
    "fx_subscriptions": (
        "part",
        [
            "p_partkey as sub_id",
            "'node-'||cast(p_partkey % 110 + 1 as string) as node_id",
            "case p_partkey % 10 when 0 then 'river.stripe.webhook' when 1 then 'river.general.>' when 2 then 'contact.created'"
            " when 3 then 'lead.scored' when 4 then 'payment.completed' when 5 then 'payment.>' when 6 then '*.failed'"
            " when 7 then '_INBOX.abc' when 8 then case when p_partkey % 20 = 8 then 'payment.treehouse.x' else 'x.treehouse.y' end else 'misc.*' end as subject",
            "case when p_partkey % 3 = 0 then 'workers' else '' end as queue",
            "cast(p_size as bigint)*67108864 as ram_allocated",
        ],
        None,
    ),
    # Whole turns behind a sender in quotes and a backslash, so that every text needs escaping.
    "fx_said": (
        "conversations",
        ["conv_id", "turn", "role", "chr(34)||role||chr(34)||' '||chr(92)||' '||text as said"],
        None,
    ),
    "fx_chat": (
        "fx_said",
        [
            "conv_id",
            "turn",
            "role",
            "said",
            "cast(floor(length(said) / 2) as bigint) as middle",
            """'{"update_id":'||cast(conv_id*1000+turn as string)||case when role='system' then '}' else ',"message":{"message_id":'||cast(turn as string)||',"from":{"id":'||cast(conv_id % 17 as string)||',"first_name":"'||role||'"},"chat":{"id":'||cast(conv_id as string)||',"type":"private"},"date":'||cast(1704067200 + conv_id*60 + turn as string)||',"text":"'||"""
            + ESCAPED
            + """||'","entities":[{"type":"bold","offset":2,"length":3},{"type":"mention","offset":0,"length":'||cast(length(role) + 2 as string)||'},{"type":"text_mention","offset":'||cast(cast(floor(length(said) / 2) as bigint) as string)||',"length":7}]'||case when turn > 0 then ',"reply_to_message":{"message_id":'||cast(turn-1 as string)||'}' else '' end||'}}' end as body""",
        ],
        None,
    ),
    "fx_requests": (
        "events",
        [
            "event_id",
            "ts as captured_at",
            "case when event_id % 20 = 0 then 'GET' else 'POST' end as method",
            "case event_id % 4 when 0 then '/webhooks/stripe' when 1 then '/webhooks/github' when 2 then '/webhooks/slack' else '/webhooks/other' end as path",
            "event_id % 33 <> 0 as source_running",
            """case event_id % 4 when 0 then '{"Stripe-Signature":"t=1704067200,v1=abc","X-Req":"1"}' when 1 then '{"X-Hub-Signature-256":"sha256=abc","X-GitHub-Event":"push"}' when 2 then '{"X-Slack-Signature":"v0=abc"}' else '{"X-Signature-256":"","X-Hub-Signature-256":"sha256=def"}' end as headers_json""",
            """case when event_id % 25 = 0 then '{broken' else '{"type":"'||event_type||'","n":'||cast(event_id as string)||'}' end as body""",
        ],
        None,
    ),
    "fx_polls": (
        "events",
        [
            "event_id",
            "ts",
            "'api-'||cast(user_id % 5 as string) as source",
            "case when event_id % 35 = 0 then null when event_id % 15 = 0 then 500 else 200 end as status_code",
            """case when event_id % 35 = 0 then null when event_id % 50 = 1 then '{broken' else case event_id % 4 when 0 then '{"meta":{}}' when 1 then '{"meta":{"cursor":"c'||cast(event_id as string)||'"}}' when 2 then '{"meta":{"cursor":'||cast(event_id as string)||'}}' else '{"meta":{"cursor":null}}' end end as body""",
            "'https://api.example.com/items/'||cast(user_id % 5 as string)||case event_id % 6 when 1 then '?since=old'"
            " when 2 then '?since=old&limit=5' when 3 then '?limit=5&since=old' when 4 then '?limit=5' else '' end as url",
        ],
        None,
    ),
    "fx_fleet_events": (
        "events",
        [
            "event_id + 1 as slot",
            "ts",
            "case event_id % 6 when 0 then 'land_added' when 1 then 'process_added' when 2 then 'process_added' when 3 then 'process_updated' when 4 then case when event_id % 5 = 0 then 'land_removed' else 'land_updated' end else 'process_removed' end as type",
            "case when event_id % 12 = 5 then null else 'node-'||cast(user_id % 20 as string) end as node_id",
            "'p-'||cast(event_id % 50 as string) as process_id",
            "cast(floor(value*1000) as bigint) as ram",
        ],
        None,
    ),
    "fx_cas": (
        "events",
        [
            "event_id as arrival",
            "'e'||cast(user_id as string) as entity",
            "(event_id * 7 + user_id) % 11 as expected_revision",
            "user_id % 3 as current_revision",
            "'v'||cast(event_id as string) as data",
        ],
        None,
    ),
    "fx_entities": (
        "customer",
        [
            "'entity-user-'||cast(c_custkey as string) as entity",
            """'{"id":"user-'||cast(c_custkey as string)||'","created_at":"2023-05-0'||cast(c_custkey % 9 + 1 as string)||'T00:00:00Z","owner":{"name":"'||c_name||'"},"credit":'||cast(c_custkey * 10 as string)||',"status":"old"}' as data""",
        ],
        "c_custkey % 3 = 0",
    ),
    "fx_topics": (
        "events",
        ["event_id", "user_id", "event_type", "'orders.'||cast(user_id as string)||'.'||event_type as subject"],
        None,
    ),
    "fx_topic_subs": (
        "part",
        [
            "p_partkey as subscriber",
            "p_partkey % 500 as k",
            "cast(floor(p_partkey / 500) as bigint) % 4 as kind",
            "case cast(floor(p_partkey / 500) as bigint) % 4 when 0 then 'orders.'||cast(p_partkey % 500 as string)||'.click'"
            " when 1 then 'orders.'||cast(p_partkey % 500 as string)||'.*' when 2 then 'orders.'||cast(p_partkey % 500 as string)||'.>'"
            " else '*.'||cast(p_partkey % 500 as string)||'.view' end as pattern",
        ],
        None,
    ),
    "fx_consumer_rows": (
        "part",
        [
            "'stream-'||cast(p_partkey % 3 as string) as stream_name",
            "case when p_partkey % 7 = 0 then '' else 'worker-'||cast(p_partkey % 41 as string) end as name",
            "case p_partkey % 6 when 0 then '' when 1 then 'river.general.>' when 2 then 'contact.created'"
            " when 3 then 'payment.>' when 4 then 'payment.treehouse.x' else 'x.treehouse.y' end as filter_subject",
        ],
        None,
    ),
    "fx_connections": (
        "part",
        [
            "case p_partkey % 4 when 0 then 'browser' else 'eventflow-'||cast(p_partkey % 29 as string) end as name",
            "case p_partkey % 5 when 0 then '_INBOX.abc' when 1 then 'lead.scored' when 2 then 'river.stripe.webhook'"
            " when 3 then 'payment.completed' else '$SYS.ping' end as subject",
        ],
        None,
    ),
    "fx_snapshot_old": ("part", ["p_partkey as id", "p_name as name"], "p_partkey % 7 <> 0"),
    "fx_snapshot_new": ("part", ["p_partkey as id", "p_name as name"], "p_partkey % 5 <> 0"),
}

# Fixtures whose queries parse or hash text per row.
TEXT_HEAVY = {"fx_raw", "fx_requests", "fx_polls", "fx_chat", "fx_contacts"}

# Routing table, and consumers with delivered and acknowledged positions in percent of the log.
PATTERNS = [
    ("parser-pay", "river.stripe.webhook"),
    ("parser-gen", "river.general.>"),
    ("audit", "river.>"),
    ("one-token", "river.general.*"),
    ("double", "river.*.webhook"),
    ("double", "river.stripe.>"),
]
CONSUMERS = [
    ("observer-a", "river.general.>", 25, 20),
    ("observer-b", "river.stripe.webhook", 50, 50),
    ("observer-c", "river.>", 99, 10),
]
SMALL = {
    "fx_patterns": "select * from (values "
    + ", ".join(f"('{s}','{p}')" for s, p in PATTERNS)
    + ") as t(subscriber, pattern)",
    "fx_consumers": "select consumer, filter_subject, cast(floor((select max(event_id) from {events}) * p / 100) as bigint) as position,"
    " cast(floor((select max(event_id) from {events}) * a / 100) as bigint) as acked from (values "
    + ", ".join(f"('{c}','{f}',{p},{a})" for c, f, p, a in CONSUMERS)
    + ") as t(consumer, filter_subject, p, a)",
}


def fixture(spark: SparkSession, folder: str, name: str, stream: bool = False) -> DataFrame:
    """The fixture as a batch or streaming DataFrame."""
    if name in SMALL:
        return spark.sql(SMALL[name], events=load(spark, folder, "events")) if "{" in SMALL[name] else spark.sql(SMALL[name])
    table, columns, where = FIXTURES[name]
    if table in FIXTURES:
        base = fixture(spark, folder, table, stream)
    elif stream:
        base = load_stream(spark, folder, table)
    else:
        base = load(spark, folder, table)
        if name in TEXT_HEAVY:
            base = spread(base)
    if where:
        base = base.where(where)
    return base.selectExpr(*columns)


def with_ctes(names: list[str], body: str) -> str:
    """SQL text with the fixtures (and what they derive from) as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        if name in FIXTURES and FIXTURES[name][0] in FIXTURES:
            need(FIXTURES[name][0])
        order.append(name)

    for name in names:
        need(name)
    parts = []
    for name in order:
        if name in SMALL:
            parts.append(f"{name} as ({SMALL[name].replace('{events}', 'events')})")
        else:
            table, columns, where = FIXTURES[name]
            parts.append(f"{name} as (select {', '.join(columns)} from {table}{f' where {where}' if where else ''})")
    body = body.strip()
    plain = body.lower().startswith("select")
    if not parts:
        return body if plain else "with " + body
    return "with " + ", ".join(parts) + (" " if plain else ", ") + body
