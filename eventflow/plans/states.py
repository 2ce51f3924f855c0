"""Queries over the change log and the state folded from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents as doc
from ..functions.pin import pin
from ..operators import chained, changelog, logstats, state
from ..session import load, work_folder
from ..streaming import snapshots, statetable, status
from .fixtures import fixture
from .ingest import SQL_GENERAL, SQL_PAYMENTS, general_events, payments, text
from .registry import query

SQL_OUTCOMES = """
  ops as (select *, lag(action) over (partition by entity order by slot) as prev from fx_changelog),
  outc as (select *, case when action = 'create' and prev is not null and prev <> 'delete' then 'rejected_exists'
      when action = 'update' and (prev is null or prev = 'delete') then 'created_by_update'
      when action = 'delete' and (prev is null or prev = 'delete') then 'noop_delete' else 'applied' end as outcome from ops)
"""
SQL_REVISIONS = (
    SQL_OUTCOMES
    + """, rev as (select *, row_number() over (order by slot) as revision from outc where outcome in ('applied','created_by_update')),
    cur as (select entity, data, slot, revision from (select * from rev qualify row_number() over (partition by entity order by slot desc) = 1)
      where action <> 'delete')
"""
)


def log(spark, folder, stream=False) -> DataFrame:
    return fixture(spark, folder, "fx_changelog", stream)


# --- reading and writing the log ----------------------------------------------------------


@query(
    "changelog_scan",
    "fx_changelog",
    sql="select slot, entity, action, 'humus.'||actor||'.'||action as subject from fx_changelog order by slot",
)
def changelog_scan(spark, folder):
    return changelog.read_log(log(spark, folder)).select("slot", "entity", "action", changelog.route().alias("subject"))


@query(
    "changelog_append",
    "fx_entries",
    sql="""
    checked as (select *, case when actor = '' then 'empty actor' when entity = '' then 'empty entity' when action = '' then 'empty action'
        when action not in ('create','update','delete') then 'unknown action'
        when action <> 'delete' and coalesce(data, '') = '' then 'empty data' else '' end as reason from fx_entries)
    select event_id, reason as reject_reason, 1000 + row_number() over (order by event_id) as slot,
      'humus.'||actor||'.'||action as subject, coalesce(nullif(data, ''), 'null') as data from checked where reason = ''
    union all select event_id, reason, 0, '', '' from checked where reason <> ''""",
)
def changelog_append(spark, folder):
    """Appended entries with their slots, and the refused ones with their reason."""
    entries = fixture(spark, folder, "fx_entries")
    stored = changelog.append(entries, "event_id", last_slot=1000)
    refused = changelog.check_entries(entries).where(F.col("reject_reason").isNotNull())
    return stored.select("event_id", F.lit("").alias("reject_reason"), "slot", "subject", "data").unionByName(
        refused.select(
            "event_id",
            "reject_reason",
            F.lit(0).cast("bigint").alias("slot"),
            F.lit("").alias("subject"),
            F.lit("").alias("data"),
        )
    )


# --- state table --------------------------------------------------------------------------


@query(
    "state_fold",
    "fx_changelog",
    sql=SQL_REVISIONS + "select entity, data, slot from cur",
)
def state_fold(spark, folder):
    return state.fold(log(spark, folder))


@query("apply_outcome", "fx_changelog", sql=SQL_OUTCOMES + "select slot, entity, action, outcome from outc")
def apply_outcome(spark, folder):
    return state.outcomes(log(spark, folder)).select("slot", "entity", "action", "outcome")


@query("revision_assign", "fx_changelog", sql=SQL_REVISIONS + "select slot, entity, revision from rev")
def revision_assign(spark, folder):
    return state.revisions(log(spark, folder)).select("slot", "entity", "revision")


#: The entities here are few; a table's buckets go by how many it is to hold.
FEW_BUCKETS = 4


def state_table(spark, folder) -> str:
    """The state table that a stream over the log maintains; returns its folder."""
    return statetable.maintain(log(spark, folder, stream=True), work_folder(spark, "state"), FEW_BUCKETS)


@query(
    "state_get",
    "fx_changelog",
    sql=SQL_REVISIONS
    + """select asked.entity, cur.entity is not null as found, coalesce(cur.data, '') as data, coalesce(cur.revision, 0) as revision
    from (select 'user-'||c_custkey as entity from customer) asked left join cur on asked.entity = cur.entity""",
)
def state_get(spark, folder):
    """One lookup per customer; most customers have no state."""
    contacts = fixture(spark, folder, "fx_contacts")
    asked = contacts.select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("entity"))
    hit = statetable.get_many(spark, state_table(spark, folder), asked)
    return hit.select("entity", "found", text("data").alias("data"), "revision")


@query("state_keys", "fx_changelog", sql=SQL_REVISIONS + "select entity from cur")
def state_keys(spark, folder):
    return state.keys(state.fold(log(spark, folder)))


@query(
    "state_watch",
    "fx_changelog",
    sql=SQL_REVISIONS
    + """, fed as (select *, lag(action) over w as old_action, lag(data) over w as old from rev window w as (partition by entity order by slot))
    select revision, entity, data, case when old_action <> 'delete' then old else '' end as before from fed where action <> 'delete'""",
)
def state_watch(spark, folder):
    """The feed of the maintained table, each write with the value it replaced. The first half of the log
    is delivered twice, which the feed does not show."""
    base = work_folder(spark, "watch")
    entries = log(spark, folder)
    half = entries.agg(F.floor(F.max("slot") / 2)).head()[0]
    for batch_id, part in enumerate((entries.where(F.col("slot") <= half), entries)):
        statetable.apply(part, batch_id, base, FEW_BUCKETS)
    return statetable.watch(spark, base, "*").select("revision", "entity", "data", text("before").alias("before"))


@query(
    "state_history",
    "fx_changelog",
    sql=SQL_REVISIONS
    + "select entity, revision, action, coalesce(data, '') as data from rev qualify row_number() over (partition by entity order by revision desc) <= 10",
)
def state_history(spark, folder):
    kept = state.history(state.revisions(log(spark, folder)))
    return kept.select("entity", "revision", "action", text("data").alias("data"))


@query(
    "state_at",
    "fx_changelog",
    sql="""
    early as (select * from fx_changelog where slot <= (select max(slot) * 3 // 4 from fx_changelog)),
    gone as (select entity, max(slot) as d from early where action = 'delete' group by entity),
    kept as (select e.*, coalesce(d, 0) as d from early e left join gone g on e.entity = g.entity where e.slot > coalesce(d, 0)),
    upd as (select entity, data, slot from kept where action = 'update' qualify row_number() over (partition by entity order by slot desc) = 1),
    cre as (select entity, data, slot from kept where action = 'create' qualify row_number() over (partition by entity order by slot) = 1)
    select coalesce(upd.entity, cre.entity) as entity, coalesce(upd.data, cre.data) as data, coalesce(upd.slot, cre.slot) as slot
    from upd full outer join cre on upd.entity = cre.entity""",
)
def state_at(spark, folder):
    """State after three quarters of the log, from the last snapshot before and the segments since."""
    base, entries = work_folder(spark, "snapshots"), log(spark, folder)
    newest = entries.agg(F.max("slot")).head()[0]
    width = max(newest // 16, 1)  # some sixteen segments at any size of the log
    changelog.write_log(entries, f"{base}/log", width)
    stored = spark.read.parquet(f"{base}/log")
    snapshots.take(stored, f"{base}/snapshots", every=5, width=width)
    return snapshots.state_at(stored, f"{base}/snapshots", newest * 3 // 4, width)


@query(
    "state_asof",
    "fx_changelog",
    sql=SQL_OUTCOMES
    + """, applied as (select entity, slot, action, data from outc where outcome in ('applied','created_by_update')),
    reads as (select event_id as read_id, 'user-'||((user_id * 7 + event_id) % 200) as entity, event_id + 1 as slot from events)
    select read_id, reads.entity, reads.slot, case when action <> 'delete' then applied.slot else 0 end as seen_slot,
      case when action <> 'delete' then data else '' end as seen_data
    from reads asof left join applied on reads.entity = applied.entity and reads.slot >= applied.slot""",
)
def state_asof(spark, folder):
    """At every event some other user's state is read."""
    reads = fixture(spark, folder, "fx_raw").select(
        F.col("event_id").alias("read_id"),
        F.concat(F.lit("user-"), ((F.col("user_id") * 7 + F.col("event_id")) % 200).cast("string")).alias("entity"),
        (F.col("event_id") + 1).alias("slot"),
    )
    seen = state.as_of(reads, log(spark, folder))
    return seen.select("read_id", "entity", "slot", "seen_slot", text("seen_data").alias("seen_data"))


@query(
    "state_lookup",
    "fx_changelog",
    "fx_raw",
    sql=SQL_REVISIONS
    + """select event_id, 'user-'||user_id as entity, coalesce(cur.data, '') as state_data, coalesce(cur.revision, 0) as state_revision
    from fx_raw left join cur on cur.entity = 'user-'||user_id""",
)
def state_lookup(spark, folder):
    events = fixture(spark, folder, "fx_raw").select(
        "event_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity")
    )
    rows = statetable.get_many(spark, state_table(spark, folder), events)
    return rows.select("event_id", "entity", text("data").alias("state_data"), F.col("revision").alias("state_revision"))


@query(
    "state_put_delete",
    "fx_changelog",
    sql="""
    ops as (select slot, entity, action, lag(action) over (partition by entity order by slot) as prev from fx_changelog)
    select slot, entity, case when action <> 'delete' then 'written' when prev is null or prev = 'delete' then 'not_found' else 'deleted' end as outcome
    from ops""",
)
def state_put_delete(spark, folder):
    ops = log(spark, folder).withColumn("action", F.when(F.col("action") == "delete", "delete").otherwise("put"))
    return state.put_delete(ops).select("slot", "entity", "outcome")


@query(
    "cas_resolve",
    "fx_cas",
    sql="""
    -- A won attempt is followed by the entity's next attempt that expects one revision more.
    linked as materialized (select f.arrival, f.entity, f.expected_revision, n.arrival as next from fx_cas f
      asof left join (select arrival, entity, expected_revision from fx_cas) n on f.entity = n.entity and f.expected_revision + 1 = n.expected_revision and f.arrival < n.arrival),
    won as (with recursive chain as (
        select entity, min(arrival) as arrival from fx_cas where expected_revision = current_revision group by entity
        union all select l.entity, l.next from chain join linked l on chain.arrival = l.arrival where l.next is not null)
      select chain.entity, chain.arrival, expected_revision + 1 as revision from chain join fx_cas on chain.arrival = fx_cas.arrival),
    met as (select f.*, w.arrival is not null as hit, coalesce(max(w.revision) over (partition by f.entity order by f.arrival rows between unbounded preceding and 1 preceding),
        current_revision) as met_revision from fx_cas f left join won w on f.arrival = w.arrival)
    select arrival, entity, met_revision, case when hit then case when expected_revision = 0 then 'created' else 'updated' end
      when expected_revision = 0 then 'conflict_exists' else 'conflict_revision' end as outcome from met""",
)
def cas_resolve(spark, folder):
    """Chains of attempts: each write that wins decides which revision the next ones meet."""
    return chained.resolve(fixture(spark, folder, "fx_cas")).select("arrival", "entity", "met_revision", "outcome")


@query(
    "snapshot_diff",
    "fx_snapshot_old",
    "fx_snapshot_new",
    sql="""
    select id, 'added' as change from fx_snapshot_new where id not in (select id from fx_snapshot_old)
    union all select id, 'removed' from fx_snapshot_old where id not in (select id from fx_snapshot_new)""",
)
def snapshot_diff(spark, folder):
    return state.snapshot_diff(fixture(spark, folder, "fx_snapshot_old"), fixture(spark, folder, "fx_snapshot_new"))


SQL_STATUS = (
    SQL_GENERAL
    + """, upd as (select *, 'entity-'||json_extract_string(doc, '$.entity_id') as entity from parsed where subject = 'status.update'
      and json_extract_string(doc, '$.entity_id') is not null),
    seen as (select event_id, upd.entity, ts, first_value(ts) over w as first_ts, row_number() over w as n, doc, data as old
      from upd left join fx_entities e on upd.entity = e.entity window w as (partition by upd.entity order by event_id))
    select event_id, entity, case when old is not null or n > 1 then 'update' else 'create' end as action,
      case when old is null then json_extract_string(doc, '$.entity_id') else coalesce(json_extract_string(old, '$.id'), '') end as id,
      json_extract_string(doc, '$.status') as status, json_extract_string(doc, '$.message') as message,
      case when old is null then strftime(first_ts, '%Y-%m-%dT%H:%M:%SZ') else json_extract_string(old, '$.created_at') end as created_at,
      strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as last_update,
      coalesce(json_extract_string(old, '$.owner.name'), '') as owner, coalesce(json_extract(old, '$.credit')::varchar, '') as credit
    from seen"""
)


def status_rows(documents: DataFrame, position: str) -> DataFrame:
    """Fields of the merged documents; owner and credit are none that an event sets."""
    paths = {c: f"$.{c}" for c in ("id", "status", "message", "created_at", "last_update", "credit")} | {"owner": "$.owner.name"}
    fields = {c: F.get_json_object("data", p) for c, p in paths.items()}
    optional = {c: text(fields[c]) for c in ("id", "owner", "credit")}
    return documents.select(F.col(position).alias("event_id"), "entity", "action", *[c.alias(n) for n, c in (fields | optional).items()])


def status_events(spark, folder, stream=False) -> DataFrame:
    events = general_events(spark, folder, stream).where(F.col("subject") == "status.update")
    return pin(events, {f: doc.scalar_text(doc.field(F.col("payload"), f)) for f in ("entity_id", "status", "message")})


@query("status_upsert", "fx_raw", "fx_entities", sql=SQL_STATUS)
def status_upsert(spark, folder):
    """Status events merged into entities, of which many are stored already, with fields of their own."""
    stored = fixture(spark, folder, "fx_entities").select("entity", "data")
    return status_rows(state.status_documents(status_events(spark, folder), stored, "event_id"), "event_id")


@query("status_upsert_stream", "fx_raw", "fx_entities", sql=SQL_STATUS)
def status_upsert_stream(spark, folder):
    """The same in keyed streaming state that starts from the stored entities."""
    stored = fixture(spark, folder, "fx_entities").select("entity", "data")
    sink = status.keep_status(status_events(spark, folder, stream=True), "event_id", stored, work_folder(spark, "status"))
    return status_rows(spark.read.parquet(sink), "position")


# --- retention and order ------------------------------------------------------------------

KEEP_SECONDS, KEEP_ROWS = 7 * 24 * 3600, 2000


@query(
    "retain_log",
    "fx_changelog",
    sql=f"""
    young as (select * from fx_changelog where ts >= (select max(ts) from fx_changelog) - interval {KEEP_SECONDS} second)
    select slot, entity from young qualify row_number() over (order by slot desc) <= {KEEP_ROWS}""",
)
def retain_log(spark, folder):
    return changelog.retain(log(spark, folder), KEEP_SECONDS, KEEP_ROWS).select("slot", "entity")


SQL_SHUFFLED = """case when event_id % 100 = 50 then event_id - 4 else event_id + 1 end"""


@query(
    "slot_order_check",
    "fx_raw",
    sql=f"""
    arrived as (select event_id as arrival, {SQL_SHUFFLED} as slot from fx_raw),
    seen as (select *, lag(slot) over (order by arrival) as prev_slot from arrived)
    select arrival, slot, prev_slot from seen where slot <= prev_slot""",
)
def slot_order_check(spark, folder):
    """Every hundredth entry arrives with a slot that was passed already."""
    arrived = fixture(spark, folder, "fx_raw").selectExpr("event_id as arrival", f"{SQL_SHUFFLED} as slot")
    return changelog.out_of_order(arrived, "arrival")


# --- statistics ---------------------------------------------------------------------------


@query(
    "source_stats",
    "fx_polls",
    sql="""
    select source, count(*) as polls, cast(count(*) filter (status_code is null or body is null or not json_valid(body)) as bigint) as errors,
      epoch_us(max(ts)) as last_us, 0 as triggers, 0 as beats, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 as uptime_s
    from fx_polls group by source
    union all select 'every-'||event_type, 0, 0, epoch_us(max(ts)), count(*) // 180, count(*) % 180,
      epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 from events group by event_type""",
)
def source_stats(spark, folder):
    """Polled sources, and timed ones that take each kind of event as their beat."""
    rows = fixture(spark, folder, "fx_polls")
    failed = F.col("status_code").isNull() | doc.decode(F.col("body")).isNull()
    polled = logstats.poll_stats(rows.withColumn("failed", failed))
    beats = load(spark, folder, "events").select(F.concat(F.lit("every-"), "event_type").alias("source"), "ts")
    stats = logstats.source_stats(polled, logstats.trigger_stats(beats, 180))
    return stats.select("source", "polls", "errors", F.unix_micros("last_at").alias("last_us"), "triggers", "beats", "uptime_s")


@query(
    "stream_stats",
    "fx_raw",
    "fx_consumers",
    sql="""
    select 'river' as stream, subject, count(*) as messages, cast(sum(octet_length(encode(data))) as bigint) as bytes, 0 as consumers from fx_raw group by subject
    union all select 'river', '', count(*), cast(sum(octet_length(encode(data))) as bigint), (select count(*) from fx_consumers) from fx_raw""",
)
def stream_stats(spark, folder):
    return logstats.stream_stats(fixture(spark, folder, "fx_raw"), fixture(spark, folder, "fx_consumers"))


@query(
    "consumer_lag",
    "fx_raw",
    "fx_consumers",
    sql="""
    waiting as (select consumer, count(*) filter (event_id > position) as pending,
        count(*) filter (event_id > acked and event_id <= position) as ack_pending
      from fx_consumers c join fx_raw r on case c.filter_subject when 'river.general.>' then subject like 'river.general.%'
        when 'river.>' then true else subject = c.filter_subject end group by consumer)
    select c.*, coalesce(pending, 0) as pending, coalesce(ack_pending, 0) as ack_pending from fx_consumers c left join waiting w on c.consumer = w.consumer""",
)
def consumer_lag(spark, folder):
    return logstats.consumer_lag(fixture(spark, folder, "fx_raw"), fixture(spark, folder, "fx_consumers"), "event_id")


@query(
    "event_counts",
    "fx_raw",
    sql=SQL_PAYMENTS
    + """select 'payment' as head, customer_id, cast(count(*) filter (subject = 'payment.completed') as bigint) as completed,
      cast(count(*) filter (subject = 'payment.failed') as bigint) as failed,
      count(*) filter (subject = 'payment.completed') / count(*)::double as success_rate
    from paid group by customer_id""",
)
def event_counts(spark, folder):
    return logstats.event_counts(payments(spark, folder), [F.col("payment.customer_id").alias("customer_id")])


@query(
    "threshold_alert",
    sql="""
    select epoch_us(time_bucket(interval 1 hour, ts)) as start_us, user_id, count(*) as readings, min(value) as low, max(value) as high,
      cast(count(*) filter (value > 200) as bigint) as over, count(*) filter (value > 200) > 0 as alert
    from events group by 1, 2""",
)
def threshold_alert(spark, folder):
    """Users are the sensors, event values their readings."""
    rows = logstats.threshold_metrics(load(spark, folder, "events"), "user_id", "value", 200)
    return rows.withColumn("start_us", F.unix_micros("start")).drop("start")


@query(
    "stock_reorder",
    sql="""
    sold as (select l_partkey, l_shipdate, l_orderkey, l_linenumber, l_quantity, sum(l_quantity) over
      (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber rows unbounded preceding) as s from lineitem)
    select l_partkey, epoch_us(l_shipdate) as shipped_us, l_orderkey, l_linenumber, 500 - s as stock from sold
    where 500 - s < 100 and 500 - s + l_quantity >= 100""",
)
def stock_reorder(spark, folder):
    """500 of each part at first; the order line at which fewer than 100 are left."""
    lines = load(spark, folder, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    # A quarter holds few enough lines of one part for a task, and many enough for a short summary.
    segment = F.date_trunc("quarter", "l_shipdate")
    rows = logstats.reorder_alerts(
        lines, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", 500.0, 100.0, segment
    )
    return rows.select("l_partkey", F.unix_micros("l_shipdate").alias("shipped_us"), "l_orderkey", "l_linenumber", "stock")
