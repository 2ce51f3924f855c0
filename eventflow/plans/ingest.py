"""Queries over sources, captures, signatures and parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import documents as doc
from ..functions import signatures as sig
from ..operators import events as ev
from ..operators import parsers
from ..sources import captures, rawlog, ticks
from .fixtures import fixture
from .registry import query

# Example settings of the queries.
SECRET = "whsec_example"


def text(value) -> Column:
    """Empty text instead of NULL, so results compare the same everywhere."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def pad_hex(byte: int, block: int = 64) -> str:
    """Key pad of the example secret, as hex, for the SQL side."""
    return bytes(b ^ byte for b in SECRET.encode().ljust(block, b"\0")).hex()


def sql_hmac(body: str) -> str:
    inner = f"sha256(unhex('{pad_hex(0x36)}') || encode({body}))"
    return f"sha256(unhex('{pad_hex(0x5C)}') || unhex({inner}))"


# --- raw log ------------------------------------------------------------------------------


@query(
    "raw_ingest",
    "fx_payloads",
    sql="""
    select event_id,
      case when subject like 'river.%' then subject else 'river.'||subject end as subject,
      case when subject = '' then 'empty subject' when data = '' then 'empty data' else '' end as reject_reason,
      cast(octet_length(encode(data)) as bigint) as size
    from fx_payloads""",
)
def raw_ingest(spark, folder):
    rows = rawlog.ingest(fixture(spark, folder, "fx_payloads"))
    size = F.octet_length("data").cast("bigint")
    return rows.select("event_id", "subject", text("reject_reason").alias("reject_reason"), size.alias("size"))


def wire_records(spark, folder, stream=False):
    """Wire text of the raw log; every 40th record is cut short."""
    raw = fixture(spark, folder, "fx_raw", stream)
    wire = rawlog.encode_wire(raw)
    return raw.select(
        "event_id", F.when(F.col("event_id") % 40 == 0, F.substring(wire, 1, 20)).otherwise(wire).alias("wire")
    )


@query(
    "raw_decode",
    "fx_raw",
    sql="""
    select event_id, event_id % 40 <> 0 as decoded,
      case when event_id % 40 = 0 then '' else subject end as subject,
      case when event_id % 40 = 0 then '' else md5(data) end as data_md5,
      case when event_id % 40 = 0 then 0 else epoch_us(ts) end as sent_us
    from fx_raw""",
)
def raw_decode(spark, folder):
    rows = rawlog.decode_wire(wire_records(spark, folder))
    ok = F.col("decoded")
    return rows.select(
        "event_id",
        "decoded",
        F.when(ok, F.col("subject")).otherwise("").alias("subject"),
        F.when(ok, F.md5("data")).otherwise("").alias("data_md5"),
        F.when(ok, F.unix_micros("sent_at")).otherwise(0).alias("sent_us"),
    )


@query(
    "raw_scan_by_pattern",
    "fx_raw",
    sql="select event_id, subject from fx_raw where subject like 'river.general.%'",
)
def raw_scan_by_pattern(spark, folder):
    return rawlog.scan(fixture(spark, folder, "fx_raw"), "general.>").select("event_id", "subject")


# --- captures -----------------------------------------------------------------------------


def requests(spark, folder):
    """Captured requests with a header map; every second GitHub-style one is signed correctly."""
    rows = fixture(spark, folder, "fx_requests")
    headers = F.from_json("headers_json", "map<string,string>")
    signed = F.map_from_arrays(
        F.array(F.lit("X-Hub-Signature-256"), F.lit("X-GitHub-Event")),
        F.array(F.concat(F.lit("sha256="), sig.hmac_hex(SECRET, F.col("body"))), F.lit("push")),
    )
    return rows.withColumn("headers", F.when(F.col("event_id") % 8 == 1, signed).otherwise(headers))


@query(
    "webhook_capture",
    "fx_requests",
    sql="""
    checked as (select *, case when method <> 'POST' then 405 when not source_running then 503
        when path = '/webhooks/github' and event_id % 8 <> 1 then 401
        when not json_valid(body) then 500 else 200 end as st from fx_requests)
    select event_id, st as status,
      case when st = 200 then 'river'||replace(replace(path, '/webhooks', ''), '/', '.') else '' end as subject,
      case when st = 200 and event_id % 4 = 1 then 'push' else '' end as event_header,
      case when st = 200 then json_extract_string(body, '$.type') else '' end as type,
      case when st = 200 then 'hooks' else '' end as source
    from checked""",
)
def webhook_capture(spark, folder):
    subject = F.concat(F.lit("river"), F.regexp_replace(F.regexp_replace("path", "/webhooks", ""), "/", "."))
    rows = captures.capture_webhooks(
        requests(spark, folder), "hooks", subject, ["X-GitHub-Event"], {"/webhooks/github": SECRET}
    )

    def part(path: str) -> Column:
        return text(F.get_json_object("data", path))

    return rows.select(
        "event_id",
        "status",
        text("subject").alias("subject"),
        part("$.headers.X-GitHub-Event").alias("event_header"),
        part("$.body.type").alias("type"),
        part("$.source").alias("source"),
    )


@query(
    "webhook_unwrap",
    "fx_requests",
    sql="""
    select event_id, json_extract_string(body, '$.type') as type,
      cast(json_extract_string(body, '$.n') as bigint) as n, event_id % 3 = 0 as wrapped
    from fx_requests
    where method = 'POST' and source_running and json_valid(body)""",
)
def webhook_unwrap(spark, folder):
    """Objects in a wrapper, JSON strings in a wrapper, and documents never wrapped."""
    rows = captures.capture_webhooks(requests(spark, folder), "hooks", "river.hooks", [])
    third = F.col("event_id") % 3
    data = (
        F.when(third == 0, F.col("data"))
        .when(third == 1, F.to_json(F.struct("body")))
        .otherwise(F.col("body"))
    )
    body = captures.unwrap(F.col("data"))
    return (
        rows.where(F.col("status") == 200)
        .withColumn("data", data)
        .select(
            "event_id",
            F.get_json_object(body, "$.type").alias("type"),
            F.get_json_object(body, "$.n").cast("bigint").alias("n"),
            (third == 0).alias("wrapped"),
        )
    )


def chat_updates(spark, folder, broken=True):
    rows = fixture(spark, folder, "fx_chat")
    body = F.col("body")
    if broken:
        body = F.when((F.col("conv_id") + F.col("turn")) % 13 == 0, F.substring("body", 1, 10)).otherwise(body)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 60 + F.col("turn"))
    return rows.withColumns({"body": body, "ts": at})


@query(
    "chat_update_capture",
    "fx_chat",
    sql="""
    select conv_id, turn, case when (conv_id + turn) % 13 = 0 then 400 else 200 end as status,
      (conv_id + turn) % 13 <> 0 and role <> 'system' as landed,
      case when (conv_id + turn) % 13 <> 0 and role <> 'system' then cast(conv_id*1000 + turn as varchar) else '' end as update_id,
      case when (conv_id + turn) % 13 <> 0 and role <> 'system' then said else '' end as text
    from fx_chat""",
)
def chat_update_capture(spark, folder):
    rows = captures.capture_chat(chat_updates(spark, folder), "chat", "river.telegram.messages")
    found = {"update_id": "$.body.update_id", "text": "$.body.message.text"}
    fields = [text(F.get_json_object("data", p)).alias(n) for n, p in found.items()]
    return rows.select("conv_id", "turn", "status", "landed", *fields)


# A cursor replaces the one that the URL has; other parameters stay.
SQL_SENT = """case when rc is null then url else split_part(url, '?', 1)||case when contains(url, 'limit') then '?limit=5&' else '?' end||'since='||rc end"""
SQL_CURSORS = """
  found as (select *, case when json_valid(body) and json_type(body, '$.meta.cursor') in ('VARCHAR','UBIGINT','BIGINT')
      then nullif(json_extract_string(body, '$.meta.cursor'), '') end as f from fx_polls),
  cursors as (select *,
      last_value(f ignore nulls) over (partition by source order by event_id rows between unbounded preceding and current row) as c,
      last_value(f ignore nulls) over (partition by source order by event_id rows between unbounded preceding and 1 preceding) as rc
    from found)
"""


@query(
    "poll_capture",
    "fx_polls",
    sql=SQL_CURSORS
    + f"""
    select event_id, source, status_code is null or body is null or not json_valid(body) as failed,
      case when status_code is null or body is null or not json_valid(body) then '' else {SQL_SENT} end as url,
      case when status_code is null or body is null or not json_valid(body) then 0 else status_code end as status_code,
      case when status_code is null or body is null or not json_valid(body) then '' else coalesce(c, '') end as cursor
    from cursors""",
)
def poll_capture(spark, folder):
    rows = captures.capture_polls(
        fixture(spark, folder, "fx_polls"), "$.meta.cursor", "since", F.concat(F.lit("river.polls."), "source")
    )
    return rows.select(
        "event_id",
        "source",
        "failed",
        text(F.get_json_object("data", "$.url")).alias("url"),
        F.coalesce(F.get_json_object("data", "$.status_code").cast("int"), F.lit(0)).alias("status_code"),
        text(F.get_json_object("data", "$.cursor")).alias("cursor"),
    )


@query(
    "poll_cursor",
    "fx_polls",
    sql=SQL_CURSORS
    + f"""
    select event_id, source, coalesce(f, '') as found, coalesce(rc, '') as request_cursor, coalesce(c, '') as cursor, {SQL_SENT} as request_url
    from cursors""",
)
def poll_cursor(spark, folder):
    rows = captures.poll_cursors(fixture(spark, folder, "fx_polls"), "$.meta.cursor", "since")
    return rows.select(
        "event_id",
        "source",
        doc.path_text(F.col("body"), "$.meta.cursor").alias("found"),
        text("request_cursor").alias("request_cursor"),
        text("cursor").alias("cursor"),
        "request_url",
    )


# --- count windows ------------------------------------------------------------------------


@query(
    "interval_trigger",
    "fx_raw",
    sql="""
    counted as (select row_number() over (order by event_id) as seq, ts, (epoch_us(ts) - epoch_us((select min(ts) from fx_raw))) / 1e6 as up from fx_raw),
    fired as (select seq // 90 as n, epoch_us(ts) as ts_us, cast(round(up) as bigint) as up from counted where seq % 90 = 0)
    select 'heartbeat' as source, n as trigger, '1s' as interval, ts_us, 'sync' as payload,
      cast(90 as bigint) as beat_count,
      case when up >= 3600 then (up // 3600)||'h'||((up % 3600) // 60)||'m'||(up % 60)||'s'
           when up >= 60 then (up // 60)||'m'||(up % 60)||'s' else up||'s' end as uptime
    from fired""",
)
def interval_trigger(spark, folder):
    """Fires at every 90th recorded event, with that event's time."""
    rows = fixture(spark, folder, "fx_raw").select("event_id", "ts")
    fired = ticks.triggers(ticks.numbered(rows, "event_id"), "heartbeat", "1s", payload="sync")
    return fired.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


# --- envelopes ----------------------------------------------------------------------------

SQL_PROBLEM = """case when coalesce(subject, '') = '' then 'empty subject' when coalesce(source, '') = '' then 'empty source'
   when coalesce(data, '') = '' then 'empty data' when ts is null then 'missing time' else '' end"""


@query(
    "event_validate",
    "fx_envelopes",
    sql=f"select event_id, {SQL_PROBLEM} as reject_reason from fx_envelopes",
)
def event_validate(spark, folder):
    rows = ev.validate(fixture(spark, folder, "fx_envelopes"))
    return rows.select("event_id", text("reject_reason").alias("reject_reason"))


@query(
    "event_publish",
    "fx_envelopes",
    sql=f"""
    select event_id, subject as key, source, md5(data) as data_md5, epoch_us(ts) as ts_us
    from fx_envelopes where {SQL_PROBLEM} = ''""",
)
def event_publish(spark, folder):
    """Published records, read back from their JSON value."""
    rows = ev.publish(fixture(spark, folder, "fx_envelopes"))
    value = F.from_json("value", "subject string, data string, source string, ts timestamp")
    return rows.withColumn("v", value).select(
        "event_id", "key", "v.source", F.md5("v.data").alias("data_md5"), F.unix_micros("v.ts").alias("ts_us")
    )


@query(
    "payload_json_guard",
    "fx_docs",
    sql="""
    select event_id, case when not json_valid(data) then 'not json'
      when json_type(data) <> 'OBJECT' then 'not an object' else '' end as reject_reason
    from fx_docs""",
)
def payload_json_guard(spark, folder):
    rows = ev.guard_payload(fixture(spark, folder, "fx_docs"))
    return rows.select("event_id", text("reject_reason").alias("reject_reason"))


@query(
    "inject_metadata",
    "fx_docs",
    sql="""
    select event_id, subject as meta_subject, 'river' as meta_source,
      case when json_valid(data) then coalesce(json_extract_string(data, '$.type'), '') else '' end as type
    from fx_docs where case when json_valid(data) then json_type(data) = 'OBJECT' else false end""",
)
def inject_metadata(spark, folder):
    guarded = ev.accepted(ev.guard_payload(fixture(spark, folder, "fx_docs")))
    rows = ev.add_metadata(guarded)

    def part(name: str) -> Column:
        return text(F.get_json_object("data", f"$.{name}"))

    return rows.select(
        "event_id",
        part("_subject").alias("meta_subject"),
        part("_source").alias("meta_source"),
        part("type").alias("type"),
    )


@query(
    "default_source",
    "fx_envelopes",
    sql="select event_id, case when source = '' then 'treehouse:scoring' else source end as source from fx_envelopes",
)
def default_source(spark, folder):
    rows = ev.default_source(fixture(spark, folder, "fx_envelopes"), "scoring", "treehouse")
    return rows.select("event_id", "source")


# --- parsers ------------------------------------------------------------------------------


def payments(spark, folder, stream=False):
    raw = rawlog.scan(fixture(spark, folder, "fx_raw", stream), parsers.CHARGE_PATTERN)
    return parsers.parse_payment(raw)


def general_events(spark, folder, stream=False):
    raw = rawlog.scan(fixture(spark, folder, "fx_raw", stream), parsers.GENERAL_PATTERN)
    return parsers.parse_general(raw)


SQL_PAYMENTS = """
  paid as (select event_id, ts,
      case json_extract_string(data, '$.type') when 'charge.succeeded' then 'payment.completed' else 'payment.failed' end as subject,
      json_extract_string(data, '$.data.object.customer') as customer_id,
      cast(json_extract_string(data, '$.data.object.amount') as double) / 100.0 as amount,
      json_extract_string(data, '$.data.object.currency') as currency,
      coalesce(nullif(json_extract_string(data, '$.data.object.metadata.item_id'), ''), 'unknown') as item_id,
      coalesce(json_extract_string(data, '$.data.object.failure_message'), '') as reason
    from fx_raw where subject = 'river.stripe.webhook')
"""


@query("parse_payment", "fx_raw", sql=SQL_PAYMENTS + "select event_id, subject, customer_id, amount, currency, item_id, reason from paid")
def parse_payment(spark, folder):
    rows = payments(spark, folder)
    return rows.select("event_id", "subject", "payment.*").withColumn("reason", text("reason"))


SQL_GENERAL = """
  valid as (select event_id, ts, subject as raw_subject, data as doc from fx_raw
    where subject like 'river.general.%' and json_valid(data)),
  typed as (select *, json_extract_string(doc, '$.type') as event_type from valid where json_type(doc, '$.type') = 'VARCHAR'),
  parsed as (select *, case event_type when 'data.received' then 'data.received' when 'status.update' then 'status.update'
      when 'notification' then 'notification.required' else 'general.event' end as subject from typed)
"""


@query(
    "parse_general",
    "fx_raw",
    sql=SQL_GENERAL
    + """
    select event_id, subject, event_type,
      case when subject = 'data.received' then coalesce(json_extract_string(doc, '$.source'), '') else '' end as source_field,
      case when subject = 'data.received' then coalesce(json_extract_string(doc, '$.data'), '') else '' end as data_field,
      case when subject = 'status.update' then coalesce(json_extract_string(doc, '$.entity_id'), '') else '' end as entity_id,
      case when subject = 'notification.required' then coalesce(json_extract_string(doc, '$.priority'), '') else '' end as priority,
      case when subject in ('status.update','notification.required') then coalesce(json_extract_string(doc, '$.message'), '') else '' end as message,
      case when subject = 'general.event' then coalesce(json_extract_string(doc, '$.n'), '') else '' end as n
    from parsed""",
)
def parse_general(spark, folder):
    def part(path: str) -> Column:
        return text(F.get_json_object("data", path))

    return general_events(spark, folder).select(
        "event_id",
        "subject",
        "event_type",
        part("$.source").alias("source_field"),
        part("$.data").alias("data_field"),
        part("$.entity_id").alias("entity_id"),
        part("$.priority").alias("priority"),
        part("$.message").alias("message"),
        part("$.raw_data.n").alias("n"),
    )


@query(
    "parse_webhook_generic",
    "fx_raw",
    sql="""
    select event_id, coalesce(json_extract_string(data, '$.type'), 'unknown') as original_type,
      strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp,
      coalesce(json_extract_string(data, '$.data.object.id'), '') as charge_id,
      case when json_type(data, '$.data') = 'VARCHAR' then json_extract_string(data, '$.data') else '' end as body_text
    from fx_raw where json_valid(data)""",
)
def parse_webhook_generic(spark, folder):
    rows = parsers.parse_webhook(fixture(spark, folder, "fx_raw"))
    plain = F.when(F.col("body").startswith('"'), F.expr("substr(body, 2, length(body) - 2)"))
    return rows.select(
        "event_id",
        "original_type",
        "timestamp",
        text(F.get_json_object("body", "$.object.id")).alias("charge_id"),
        text(plain).alias("body_text"),
    )


def chat_messages(spark, folder):
    landed = captures.capture_chat(chat_updates(spark, folder, broken=False), "chat", "river.telegram.messages")
    return parsers.parse_chat(landed.where("landed"))


@query(
    "parse_chat",
    "fx_chat",
    sql="""
    select conv_id, turn, 'telegram' as platform, cast(conv_id as varchar) as chat_id, cast(conv_id % 17 as varchar) as user_id,
      role as username, said as text, '"'||role||'"|'||substr(said, middle + 1, 7) as mentions,
      case when turn > 0 then cast(turn - 1 as varchar) else '' end as reply_to, 'private' as chat_type,
      false as has_title,
      strftime(make_timestamp((1704067200 + conv_id*60 + turn) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as timestamp
    from fx_chat where role <> 'system'""",
)
def parse_chat(spark, folder):
    rows = chat_messages(spark, folder).select("conv_id", "turn", "message.*")
    return rows.select(
        "conv_id",
        "turn",
        "platform",
        "chat_id",
        "user_id",
        "username",
        "text",
        F.array_join("mentions", "|").alias("mentions"),
        "reply_to",
        F.col("metadata")["chat_type"].alias("chat_type"),
        F.map_contains_key("metadata", "chat_title").alias("has_title"),
        "timestamp",
    )


# --- signatures ---------------------------------------------------------------------------


@query(
    "sig_hmac",
    "fx_requests",
    sql=f"""
    select event_id, {sql_hmac("body")} as digest,
      case event_id % 4 when 0 then 'ok' when 1 then 'ok' when 2 then 'mismatch' else 'missing' end as verdict
    from fx_requests""",
)
def sig_hmac(spark, folder):
    digest = sig.hmac_hex(SECRET, F.col("body"))
    pick = F.col("event_id") % 4
    given = (
        F.when(pick == 0, F.concat(F.lit("sha256="), digest))
        .when(pick == 1, digest)
        .when(pick == 2, F.lit("sha256=abc"))
        .otherwise("")
    )
    return fixture(spark, folder, "fx_requests").select(
        "event_id", digest.alias("digest"), sig.verify_plain(SECRET, F.col("body"), given).alias("verdict")
    )


@query(
    "sig_timestamped",
    "fx_requests",
    sql=f"""
    stamped as (select *, epoch_us(captured_at) // 1000000 - (event_id % 10) * 60 as t from fx_requests)
    select event_id, {sql_hmac("cast(t as varchar)||'.'||body")} as digest,
      case when event_id % 7 = 0 then 'bad_format' when event_id % 11 = 0 then 'bad_timestamp'
        when epoch_us(captured_at) - t * 1000000 > 300000000 then 'too_old'
        when event_id % 13 = 0 then 'mismatch' else 'ok' end as verdict
    from stamped""",
)
def sig_timestamped(spark, folder):
    rows = fixture(spark, folder, "fx_requests")
    n = F.col("event_id")
    stamp = (F.floor(F.unix_micros("captured_at") / 1_000_000) - (n % 10) * 60).cast("bigint").cast("string")
    digest = sig.hmac_hex(SECRET, F.concat("t", F.lit("."), "body"))
    header = (
        F.when(n % 7 == 0, F.concat(F.lit("v1="), digest))
        .when(n % 11 == 0, F.concat(F.lit("t=abc,v1="), digest))
        .when(n % 13 == 0, F.concat(F.lit("t="), "t", F.lit(",v1=abc")))
        .otherwise(F.concat(F.lit("v1=old,t="), "t", F.lit(",v1="), digest))
    )
    verdict = sig.verify_timestamped(SECRET, F.col("body"), F.col("header"), F.col("captured_at"))
    return (
        rows.withColumn("t", stamp)
        .withColumns({"digest": digest, "header": header})
        .select("event_id", "digest", verdict.alias("verdict"))
    )


@query(
    "sig_prefixed",
    "fx_requests",
    sql=f"""
    select event_id, {sql_hmac("body")} as digest,
      case event_id % 3 when 0 then 'ok' when 1 then 'no_prefix' else 'mismatch' end as github,
      case event_id % 3 when 0 then 'no_prefix' when 1 then 'ok' else 'missing' end as slack
    from fx_requests""",
)
def sig_prefixed(spark, folder):
    digest = sig.hmac_hex(SECRET, F.col("body"))
    pick = F.col("event_id") % 3
    github = F.when(pick == 0, F.concat(F.lit("sha256="), digest)).when(pick == 1, digest).otherwise("sha256=abc")
    slack = F.when(pick == 0, digest).when(pick == 1, F.concat(F.lit("v0="), digest)).otherwise("")
    return fixture(spark, folder, "fx_requests").select(
        "event_id",
        digest.alias("digest"),
        sig.verify_prefixed(SECRET, F.col("body"), github, "sha256=").alias("github"),
        sig.verify_prefixed(SECRET, F.col("body"), slack, "v0=").alias("slack"),
    )


@query(
    "sig_header_pick",
    "fx_requests",
    sql="""
    select event_id, case event_id % 4 when 0 then 't=1704067200,v1=abc' when 1 then 'sha256=abc' when 2 then 'v0=abc'
      else 'sha256=def' end as signature
    from fx_requests""",
)
def sig_header_pick(spark, folder):
    headers = F.from_json("headers_json", "map<string,string>")
    return fixture(spark, folder, "fx_requests").select("event_id", sig.pick_header(headers).alias("signature"))


@query(
    "sig_scheme_pick",
    "fx_requests",
    sql="""
    select event_id, case when event_id % 5 = 0 then 'none' else case event_id % 4 when 0 then 'timestamped'
      when 1 then 'sha256=' when 2 then 'v0=' else 'plain' end end as scheme
    from fx_requests""",
)
def sig_scheme_pick(spark, folder):
    scheme = sig.pick_scheme(F.col("path"), F.col("event_id") % 5 != 0)
    return fixture(spark, folder, "fx_requests").select("event_id", scheme.alias("scheme"))
