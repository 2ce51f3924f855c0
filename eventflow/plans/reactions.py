"""Queries over routing, transforms, reactors, responders and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as doc
from ..functions import text as txt
from ..functions.pin import pin
from ..functions.subjects import inventory_match, resolve_subject, subject_match
from ..functions.templates import render
from ..operators import changelog, outbox, reactors, responder, routing, state, transforms
from ..operators.chain import Step, run_steps
from .fixtures import fixture
from .ingest import SQL_GENERAL, SQL_PAYMENTS, chat_messages, general_events, payments, text
from .registry import query

# --- routing ------------------------------------------------------------------------------

MATCH_PATTERNS = ["river.stripe.webhook", "river.general.>", "river.*.webhook", "*.general.*", "river.*"]


@query(
    "subject_match",
    "fx_raw",
    sql="""
    select event_id, subject = 'river.stripe.webhook' as m0, regexp_matches(subject, '^river\\.general\\..+$') as m1,
      regexp_matches(subject, '^river\\.[^.]+\\.webhook$') as m2, regexp_matches(subject, '^[^.]+\\.general\\.[^.]+$') as m3,
      regexp_matches(subject, '^river\\.[^.]+$') as m4
    from fx_raw""",
)
def subject_match_query(spark, folder):
    hits = [subject_match(F.col("subject"), p).alias(f"m{i}") for i, p in enumerate(MATCH_PATTERNS)]
    return fixture(spark, folder, "fx_raw").select("event_id", *hits)


@query(
    "subject_match_simple",
    "fx_subscriptions",
    sql="""
    select sub_id, subject = 'payment.>' or starts_with(subject, 'payment.') as m0,
      regexp_matches(subject, '^[^.]*\\.completed$') as m1, subject = 'lead.scored' as m2,
      regexp_matches(subject, '^river\\.[^.]*\\.webhook$') as m3, false as m4
    from fx_subscriptions""",
)
def subject_match_simple(spark, folder):
    patterns = ["payment.>", "*.completed", "lead.scored", "river.*.webhook", "river.*.>"]
    hits = [inventory_match(F.col("subject"), p).alias(f"m{i}") for i, p in enumerate(patterns)]
    return fixture(spark, folder, "fx_subscriptions").select("sub_id", *hits)


SQL_ROUTES = """
  rules as (select subscriber, pattern, case pattern when 'river.stripe.webhook' then '^river\\.stripe\\.webhook$'
      when 'river.general.>' then '^river\\.general\\..+$' when 'river.>' then '^river\\..+$'
      when 'river.general.*' then '^river\\.general\\.[^.]+$' when 'river.*.webhook' then '^river\\.[^.]+\\.webhook$'
      else '^river\\.stripe\\..+$' end as regex from fx_patterns),
  routed as (select event_id, subscriber, pattern from fx_raw join rules on regexp_matches(subject, regex))
"""


def routed(spark, folder) -> DataFrame:
    events = fixture(spark, folder, "fx_raw").select("event_id", "subject")
    return routing.fan_out(events, fixture(spark, folder, "fx_patterns"))


@query("route_fanout", "fx_raw", "fx_patterns", sql=SQL_ROUTES + "select event_id, subscriber, pattern from routed")
def route_fanout(spark, folder):
    return routed(spark, folder).select("event_id", "subscriber", "pattern")


@query(
    "route_many",
    "fx_topics",
    "fx_topic_subs",
    sql="""
    select event_id, subscriber, pattern from fx_topics join fx_topic_subs on user_id = k
      and (kind in (1, 2) or (kind = 0 and event_type = 'click') or (kind = 3 and event_type = 'view'))""",
)
def route_many(spark, folder):
    """Thousands of subscriptions, one for each part."""
    events = fixture(spark, folder, "fx_topics").select("event_id", "subject")
    subscriptions = fixture(spark, folder, "fx_topic_subs").select("subscriber", "pattern")
    return routing.fan_out(events, subscriptions).select("event_id", "subscriber", "pattern")


@query(
    "queue_group_assign",
    "fx_raw",
    "fx_patterns",
    sql=SQL_ROUTES + "select event_id, subscriber, event_id % 3 as member from (select distinct event_id, subscriber from routed)",
)
def queue_group_assign(spark, folder):
    """Each subscriber is a group of three workers; a group gets an event once."""
    events = fixture(spark, folder, "fx_raw").select("event_id", "subject")
    groups = routing.deliver_to_groups(events, fixture(spark, folder, "fx_patterns"), "subscriber")
    return routing.assign_member(groups, "event_id", F.lit(3)).select("event_id", "subscriber", "member")


HANDLED = ["river.general.signup", "river.general.>", "river.*.webhook"]


@query(
    "union_subjects",
    "fx_raw",
    sql="""
    select event_id, subject, 'river.general.signup' as pattern from fx_raw where subject = 'river.general.signup'
    union all select event_id, subject, 'river.general.>' from fx_raw where subject like 'river.general.%'
    union all select event_id, subject, 'river.*.webhook' from fx_raw where regexp_matches(subject, '^river\\.[^.]+\\.webhook$')""",
)
def union_subjects(spark, folder):
    return routing.subjects_of(fixture(spark, folder, "fx_raw").select("event_id", "subject"), HANDLED)


# --- transforms ---------------------------------------------------------------------------

SQL_SCORED = """
  scored as (select *, case when company_size > 500 then 50 when company_size > 100 then 30 when company_size > 20 then 10 else 0 end
      + case when title like '%CEO%' or title like '%CTO%' or title like '%VP%' then 40
             when title like '%Director%' or title like '%Manager%' then 20 else 0 end
      + case when industry in ('technology','finance') then 15 else 0 end as score,
      concat_ws(',', case when company_size > 500 then 'enterprise' when company_size > 100 then 'mid_market' when company_size > 20 then 'smb' end,
        case when title like '%CEO%' or title like '%CTO%' or title like '%VP%' then 'executive'
             when title like '%Director%' or title like '%Manager%' then 'manager' end,
        case when industry in ('technology','finance') then 'target_industry' end) as signals
    from fx_contacts where company_size is not null and title is not null)
"""
SQL_POLICY = "case when score >= 100 then 'high' when score >= 70 then 'medium' when score >= 40 then 'low' else 'none' end"


def scored(spark, folder) -> DataFrame:
    return transforms.score_contacts(fixture(spark, folder, "fx_contacts"))


@query("score_contact", "fx_contacts", sql=SQL_SCORED + "select id, email, cast(score as bigint) as score, signals from scored")
def score_contact(spark, folder):
    return scored(spark, folder).select("id", "email", "score", F.array_join("signals", ",").alias("signals"))


@query(
    "tier_lead",
    "fx_contacts",
    sql=SQL_SCORED
    + """select id, case when score >= 80 then 'enterprise' when score >= 50 then 'mid-market' else 'startup' end as tier,
      case when score >= 80 then 'high' when score >= 50 then 'medium' else 'low' end as priority
    from (select f.id, s.score from fx_contacts f left join scored s on f.id = s.id)""",
)
def tier_lead(spark, folder):
    """All contacts; those that could not be scored count as 0."""
    leads = transforms.score_contacts(fixture(spark, folder, "fx_contacts"), keep_all=True)
    return transforms.tier_leads(leads).select("id", "tier", "priority")


@query(
    "qualify_lead",
    "fx_contacts",
    sql=SQL_SCORED
    + f"""select id, score >= 70 as pursue, {SQL_POLICY} as priority,
      case {SQL_POLICY} when 'high' then 'schedule demo immediately' when 'medium' then 'schedule discovery call'
        when 'low' then 'add to nurture' else 'no action' end as action
    from scored""",
)
def qualify_lead(spark, folder):
    return transforms.qualify_leads(scored(spark, folder)).select("id", "pursue", "priority", "action")


CONTACT_SCHEMA = "id string, email string, company_size bigint, title string, industry string"
LEAD_SCHEMA = "contact_id string, email string, score bigint, signals array<string>"


def contact_events(spark, folder) -> DataFrame:
    """Contacts as ``contact.created`` events."""
    rows = fixture(spark, folder, "fx_contacts")
    body = doc.encode(F.struct("id", "email", "company_size", "title", "industry"))
    return rows.select(
        F.lit("contact.created").alias("subject"), body.alias("data"), F.lit("crm").alias("source"), "c_custkey"
    )


def score_step(events: DataFrame) -> DataFrame:
    rows = pin(events, {"_c": F.from_json("data", CONTACT_SCHEMA)}).select(*events.columns, "_c.*")
    done = transforms.score_contacts(rows)
    return done.withColumn("data", doc.encode(F.struct(F.col("id").alias("contact_id"), "email", "score", "signals")))


def qualify_step(events: DataFrame) -> DataFrame:
    rows = pin(events, {"_l": F.from_json("data", LEAD_SCHEMA)}).select(*events.columns, "_l.*")
    done = transforms.qualify_leads(rows)
    return done.withColumn("data", doc.encode(F.struct("contact_id", "pursue", "priority", "action")))


LEAD_CHAIN = [
    Step("treehouse:scoring", "contact.created", "lead.scored", score_step),
    Step("nim:qualify", "lead.scored", "lead.qualified", qualify_step),
]


@query(
    "event_lead_chain",
    "fx_contacts",
    sql=SQL_SCORED
    + f"""select 'contact.created' as subject, 'crm' as source, id, '' as score, '' as priority from fx_contacts
    union all select 'lead.scored', 'treehouse:scoring', id, cast(score as varchar), '' from scored
    union all select 'lead.qualified', 'nim:qualify', id, '', {SQL_POLICY} from scored""",
)
def event_lead_chain(spark, folder):
    def part(name: str) -> Column:
        return F.get_json_object("data", f"$.{name}")

    return run_steps(contact_events(spark, folder), LEAD_CHAIN).select(
        "subject",
        "source",
        F.coalesce(part("contact_id"), part("id")).alias("id"),
        text(part("score")).alias("score"),
        text(part("priority")).alias("priority"),
    )


# --- reactors -----------------------------------------------------------------------------

ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"


def _flat(effects: DataFrame, *paths: str) -> DataFrame:
    """Effects with the named fields of their JSON as text."""
    fields = [text(F.get_json_object("data", f"$.{p}")).alias(p) for p in paths]
    return effects.select("event_id", "kind", "target", text("action").alias("action"), "source", *fields)


@query(
    "react_payment_completed",
    "fx_raw",
    sql=SQL_PAYMENTS
    + f""", ok as (select *, 'task-'||customer_id||'-'||cast(epoch_us(ts) // 1000000 as varchar) as task_id,
        printf('%.2f', amount)||' '||currency as money from paid where subject = 'payment.completed')
    select event_id, 'change' as kind, task_id as target, 'create' as action, 'aftersales-nim' as source, customer_id,
      'pending' as status, 'Follow up on purchase of '||item_id||' ('||money||')' as description, '' as reason,
      strftime(ts + interval 24 hour, {ISO}) as due_date, '' as body from ok
    union all select event_id, 'event', 'followup.required', '', 'aftersales-nim', customer_id, '', '', 'post_purchase_followup',
      strftime(ts + interval 24 hour, {ISO}), '' from ok
    union all select event_id, 'event', 'email.send', '', 'aftersales-nim', '', '', '', '', '',
      'We appreciate your purchase of '||money from ok where amount >= 100""",
)
def react_payment_completed(spark, folder):
    effects = reactors.on_payment_completed(payments(spark, folder))
    return _flat(effects, "customer_id", "status", "description", "reason", "due_date", "body")


@query(
    "react_payment_failed",
    "fx_raw",
    sql=SQL_PAYMENTS
    + f""", bad as (select *, 'task-'||customer_id||'-failed-'||cast(epoch_us(ts) // 1000000 as varchar) as task_id,
        printf('%.2f', amount)||' '||currency as money from paid where subject = 'payment.failed')
    select event_id, 'change' as kind, task_id as target, 'create' as action, 'aftersales-nim' as source, customer_id,
      'urgent' as status, 'Reach out about failed payment ('||money||'): '||reason as description, '' as reason,
      strftime(ts + interval 2 hour, {ISO}) as due_date from bad
    union all select event_id, 'event', 'followup.required', '', 'aftersales-nim', customer_id, '', '', 'payment_failed: '||reason,
      strftime(ts + interval 2 hour, {ISO}) from bad""",
)
def react_payment_failed(spark, folder):
    effects = reactors.on_payment_failed(payments(spark, folder))
    return _flat(effects, "customer_id", "status", "description", "reason", "due_date")


def task_log(spark, folder) -> DataFrame:
    """Change log of the tasks both payment reactors create."""
    effects = reactors.on_payment(payments(spark, folder))
    return changelog.append(reactors.changes(effects), "event_id")


def open_tasks(spark, folder) -> DataFrame:
    """Raw payloads to parsed payments to tasks to folded state: open tasks per customer."""
    tasks = reactors.tasks(state.fold(task_log(spark, folder)))
    return (
        tasks.where(F.col("status").isin("pending", "urgent"))
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("open_tasks"),
            F.count_if(F.col("status") == "urgent").alias("urgent_tasks"),
            F.unix_micros(F.min("due_date")).alias("first_due_us"),
        )
    )


SQL_TASKS = (
    SQL_PAYMENTS
    + """, made as (select *, 'task-'||customer_id||case when subject = 'payment.failed' then '-failed-' else '-' end
        ||cast(epoch_us(ts) // 1000000 as varchar) as task_id from paid),
    tasks as (select task_id, customer_id, subject, ts from made qualify row_number() over (partition by task_id order by event_id) = 1)
"""
)


@query(
    "open_tasks",
    "fx_raw",
    sql=SQL_TASKS
    + """select customer_id, count(*) as open_tasks, cast(count(*) filter (subject = 'payment.failed') as bigint) as urgent_tasks,
      epoch_us(min(ts + case when subject = 'payment.failed' then interval 2 hour else interval 24 hour end)) as first_due_us
    from tasks group by customer_id""",
)
def open_tasks_query(spark, folder):
    return open_tasks(spark, folder)


@query(
    "complete_task",
    "fx_raw",
    sql=SQL_TASKS
    + f""", asked as (select event_id, ts + interval 1 day as ts, case when event_id % 5 = 0 then 'task-none-'||event_id
        else 'task-cus_'||user_id||case when json_extract_string(data, '$.type') = 'charge.failed' then '-failed-' else '-' end
          ||cast(epoch_us(ts) // 1000000 as varchar) end as task_id from fx_raw where subject = 'river.stripe.webhook')
    select asked.task_id, case when tasks.task_id is null then 'not found' else '' end as reject_reason,
      case when tasks.task_id is null then '' else 'update' end as action, coalesce(customer_id, '') as customer_id,
      case when tasks.task_id is null then '' else 'completed' end as status,
      case when tasks.task_id is null then '' else strftime(asked.ts, {ISO}) end as updated_at,
      case when tasks.task_id is null then '' else strftime(tasks.ts, {ISO}) end as created_at
    from asked left join tasks on asked.task_id = tasks.task_id""",
)
def complete_task(spark, folder):
    """Every payment's task is completed a day later; every fifth request names an unknown task."""
    raw = fixture(spark, folder, "fx_raw").where("subject = 'river.stripe.webhook'")
    kind = F.when(F.get_json_object("data", "$.type") == "charge.failed", "-failed-").otherwise("-")
    named = F.concat(
        F.lit("task-cus_"), F.col("user_id").cast("string"), kind, F.unix_seconds("ts").cast("string")
    )
    wanted = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("task-none-"), F.col("event_id").cast("string")))
    requests = raw.select(F.coalesce(wanted, named).alias("task_id"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"))
    done = reactors.complete_tasks(requests, state.fold(task_log(spark, folder)))

    def part(name: str) -> Column:
        return text(F.get_json_object("data", f"$.{name}")).alias(name)

    return done.select(
        "task_id",
        text("reject_reason").alias("reject_reason"),
        text("action").alias("action"),
        part("customer_id"),
        part("status"),
        part("updated_at"),
        part("created_at"),
    )


@query(
    "react_data_received",
    "fx_raw",
    sql=SQL_GENERAL
    + """, got as (select * from parsed where subject = 'data.received')
    select event_id, 'change' as kind, 'data-record-'||event_id as target, 'create' as action, 'general-nim' as source,
      json_extract_string(doc, '$.data') as data, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as received_at, 'true' as processed, '' as record_id from got
    union all select event_id, 'event', 'data.processed', '', 'general-nim', '', '', '', 'data-record-'||event_id from got""",
)
def react_data_received(spark, folder):
    effects = reactors.on_data_received(general_events(spark, folder))
    return _flat(effects, "data", "received_at", "processed", "record_id")


@query(
    "react_notification",
    "fx_raw",
    sql=SQL_GENERAL
    + """, got as (select *, json_extract_string(doc, '$.priority') as priority from parsed where subject = 'notification.required')
    select event_id, 'event' as kind, 'notification.send.immediate' as target, '' as action, 'general-nim' as source,
      priority, json_extract_string(doc, '$.message') as message, json_extract_string(doc, '$.recipient') as recipient, '' as sent
      from got where priority in ('high','urgent')
    union all select event_id, 'change', 'notification-'||event_id, 'create', 'general-nim', priority,
      json_extract_string(doc, '$.message'), json_extract_string(doc, '$.recipient'), 'false' from got where priority not in ('high','urgent')""",
)
def react_notification(spark, folder):
    effects = reactors.on_notification(general_events(spark, folder))
    return _flat(effects, "priority", "message", "recipient", "sent")


@query(
    "archive_general",
    "fx_raw",
    sql=SQL_GENERAL
    + """select event_id, 'event-'||event_id as target, 'general.event' as subject, 'general-tree' as event_source,
      event_type, json_extract_string(doc, '$.n') as n
    from parsed where subject = 'general.event'""",
)
def archive_general(spark, folder):
    rows = reactors.archive(general_events(spark, folder))

    def part(path: str) -> Column:
        return F.get_json_object("data", path)

    return rows.select(
        "event_id",
        "target",
        part("$.subject").alias("subject"),
        part("$.source").alias("event_source"),
        part("$.data.event_type").alias("event_type"),
        part("$.data.raw_data.n").alias("n"),
    )


# --- dynamic subjects, prompts, responders ------------------------------------------------


@query(
    "dynamic_subject",
    "fx_chat",
    sql="""
    select conv_id, turn, 'song.telegram.'||cast(conv_id as varchar)||'.{missing}.'||case when turn % 2 = 0 then 'true' else '1.5' end||'.'||said as subject
    from fx_chat""",
)
def dynamic_subject(spark, folder):
    """Chat ids are text in even turns and numbers in odd ones; the whole text ends the subject."""
    even = F.col("turn") % 2 == 0
    body = F.when(
        even, F.to_json(F.struct(F.lit("telegram").alias("platform"), F.col("conv_id").cast("string").alias("chat_id"), F.lit(True).alias("flag"), F.col("said").alias("text")))
    ).otherwise(F.to_json(F.struct(F.lit("telegram").alias("platform"), F.col("conv_id").alias("chat_id"), F.lit(1.5).alias("flag"), F.col("said").alias("text"))))
    subject = resolve_subject("song.{platform}.{chat_id}.{missing}.{flag}.{text}", doc.decode(body))
    return fixture(spark, folder, "fx_chat").select("conv_id", "turn", subject.alias("subject"))


LEAD_PROMPT = (
    "Lead {{.lead.id}} <{{.lead.email}}> scored {{.score}} with {{.signals}}."
    "{{if .signals}} Signals:{{range .signals}} [{{.}}]{{end}}.{{else}} No signals.{{end}} Note: {{.note}}"
)


def lead_documents(spark, folder) -> DataFrame:
    rows = scored(spark, folder)
    body = doc.encode(F.struct(F.struct("id", "email").alias("lead"), "score", "signals"))
    return rows.select("id", "score", body.alias("data"))


@query(
    "render_prompt",
    "fx_contacts",
    sql=SQL_SCORED
    + """select id, 'Lead '||id||' <'||email||'> scored '||score||' with ['||replace(signals, ',', ' ')||'].'
      ||case when signals = '' then ' No signals.' else ' Signals: ['||replace(signals, ',', '] [')||'].' end||' Note: <no value>' as prompt
    from scored""",
)
def render_prompt(spark, folder):
    prompt = render(LEAD_PROMPT, doc.decode(F.col("data")))
    return lead_documents(spark, folder).select("id", prompt.alias("prompt"))


@query(
    "parse_response",
    "fx_contacts",
    sql="""
    select id, case c_custkey % 3 when 0 then '' when 1 then 'plain '||id else '['||c_custkey||']' end as response,
      case c_custkey % 3 when 0 then id else '' end as verdict
    from fx_contacts""",
)
def parse_response(spark, folder):
    """Answers that are objects, plain text, and JSON that is no object."""
    pick = F.col("c_custkey") % 3
    answer = (
        F.when(pick == 0, F.to_json(F.struct(F.col("id").alias("verdict"))))
        .when(pick == 1, F.concat(F.lit("plain "), "id"))
        .otherwise(F.concat(F.lit("["), F.col("c_custkey").cast("string"), F.lit("]")))
    )
    parsed = responder.parse_answer(answer)
    return fixture(spark, folder, "fx_contacts").select(
        "id",
        text(F.get_json_object(parsed, "$.response")).alias("response"),
        text(F.get_json_object(parsed, "$.verdict")).alias("verdict"),
    )


CHAT_PROMPT = (
    'Message from {{.username}} ({{.platform}}): {{.text}}{{if .reply_to}} (reply to {{.reply_to}}){{end}}\n'
    'Answer as {"platform": "{{.platform}}", "chat_id": "{{.chat_id}}", "text": "..."}'
)


def chat_events(spark, folder) -> DataFrame:
    rows = chat_messages(spark, folder)
    return rows.select(
        "conv_id",
        "turn",
        F.lit("song.incoming").alias("subject"),
        F.to_json("message").alias("data"),
        F.lit("tree:chat-parser").alias("source"),
    )


@query(
    "rule_responder",
    "fx_chat",
    sql=f"""
    select conv_id, turn, case when role <> 'system' then cast(conv_id as varchar) else '' end as chat_id,
      case when role <> 'system' then '{responder.CHAT_REPLY}' else '' end as text,
      case when role <> 'system' then '' else 'medium' end as priority, case when role <> 'system' then length(said) + length(cast(conv_id as varchar)) + 50 else 0 end as asked
    from fx_chat""",
)
def rule_responder(spark, folder):
    """Chat prompts for turns with a message, a lead prompt for the others."""
    prompt = F.when(
        F.col("role") != "system",
        F.concat(F.col("said"), F.lit('\nReply as {"platform": "telegram", "chat_id":  "'), F.col("conv_id").cast("string"), F.lit('"}')),
    ).otherwise(F.lit("Should we pursue this lead?"))
    answer = responder.ask_rules(prompt)
    return fixture(spark, folder, "fx_chat").select(
        "conv_id",
        "turn",
        *[text(F.get_json_object(answer, f"$.{f}")).alias(f) for f in ("chat_id", "text", "priority")],
        F.when(F.col("role") != "system", F.length(prompt)).otherwise(0).cast("bigint").alias("asked"),
    )


@query(
    "outbox_messages",
    "fx_chat",
    sql=f"""
    select conv_id, turn, 'song.telegram.'||cast(conv_id as varchar) as subject, cast(conv_id as varchar) as chat_id,
      '{responder.CHAT_REPLY}' as text, md5('Message from '||role||' (telegram): '||said||case when turn > 0 then ' (reply to '||cast(turn - 1 as varchar)||')' else '' end
        ||chr(10)||'Answer as {{"platform": "telegram", "chat_id": "'||cast(conv_id as varchar)||'", "text": "..."}}') as asked
    from fx_chat where role <> 'system'""",
)
def outbox_messages(spark, folder):
    """Incoming chat to answers on dynamic subjects to the outbox."""
    answers = responder.model_step(chat_events(spark, folder), "chat", CHAT_PROMPT, "song.telegram.{chat_id}")
    events = answers.select("conv_id", "turn", "subject", F.col("answer").alias("data"), "source", F.md5("prompt").alias("asked"))
    return outbox.messages(events, "song.telegram.>", "telegram")


@query(
    "entity_id_extract",
    "fx_contacts",
    sql="""
    select id, case c_custkey % 5 when 0 then id when 1 then 'k'||c_custkey when 2 then '' when 3 then 'e'||c_custkey else '' end as entity
    from fx_contacts""",
)
def entity_id_extract(spark, folder):
    """Ids as text, as numbers (skipped), as empty text (stops the search), and missing."""
    key = F.col("c_custkey")
    pick = key % 5
    body = (
        F.when(pick == 0, F.to_json(F.struct("id", F.lit("x").alias("contact_id"))))
        .when(pick == 1, F.to_json(F.struct(key.alias("id"), F.concat(F.lit("k"), key.cast("string")).alias("contact_id"))))
        .when(pick == 2, F.to_json(F.struct(F.lit("").alias("id"), F.lit("x").alias("contact_id"))))
        .when(pick == 3, F.to_json(F.struct(F.concat(F.lit("e"), key.cast("string")).alias("entity_id"))))
        .otherwise(F.lit('{"name":"x"}'))
    )
    return fixture(spark, folder, "fx_contacts").select("id", text(responder.entity_id(doc.decode(body))).alias("entity"))


# --- scalar functions ---------------------------------------------------------------------


@query(
    "fn_contains",
    "fx_contacts",
    sql="select id, contains(title, 'VP') as vp, contains(email, 'customer') as lower_hit, contains(title, '') as empty_hit from fx_contacts",
)
def fn_contains(spark, folder):
    return fixture(spark, folder, "fx_contacts").select(
        "id",
        txt.contains(F.col("title"), "VP").alias("vp"),
        txt.contains(F.col("email"), "customer").alias("lower_hit"),
        txt.contains(F.col("title"), "").alias("empty_hit"),
    )


@query(
    "fn_json_encode",
    "fx_contacts",
    sql="""
    select id, md5('{"id":"'||id||'","size":'||coalesce(cast(company_size as varchar), 'null')||',"tags":['
      ||case when c_custkey % 2 = 0 then '"'||title||'"' else '' end||']}') as encoded_md5
    from fx_contacts""",
)
def fn_json_encode(spark, folder):
    tags = F.when(F.col("c_custkey") % 2 == 0, F.array("title")).otherwise(F.array().cast("array<string>"))
    body = doc.encode(F.struct("id", F.col("company_size").alias("size"), tags.alias("tags")))
    return fixture(spark, folder, "fx_contacts").select("id", F.md5(body).alias("encoded_md5"))


@query(
    "fn_json_decode",
    "fx_docs",
    sql="""
    select event_id, json_valid(data) as decoded, case when json_valid(data) then
      case when json_type(data) = 'OBJECT' then 'object' when json_type(data) = 'ARRAY' then 'array' when json_type(data) = 'NULL' then 'null' else 'scalar' end
      else '' end as shape
    from fx_docs""",
)
def fn_json_decode(spark, folder):
    value = doc.decode(F.col("data"))
    name = doc.kind(value)
    shape = (
        F.when(value.isNull(), "")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "VOID", "null")
        .otherwise("scalar")
    )
    return fixture(spark, folder, "fx_docs").select("event_id", value.isNotNull().alias("decoded"), shape.alias("shape"))


@query(
    "fn_json_path",
    "fx_polls",
    sql="""
    select event_id, case when json_valid(body) and json_type(body, '$.meta.cursor') in ('VARCHAR','UBIGINT') then json_extract_string(body, '$.meta.cursor') else '' end as cursor,
      '' as object_leaf, '' as no_path
    from fx_polls""",
)
def fn_json_path(spark, folder):
    body = F.col("body")
    return fixture(spark, folder, "fx_polls").select(
        "event_id",
        doc.path_text(body, "$.meta.cursor").alias("cursor"),
        doc.path_text(body, "meta").alias("object_leaf"),
        doc.path_text(body, "").alias("no_path"),
    )


@query(
    "fn_format_bytes",
    "fx_nodes",
    sql="""
    sized as (select node_id, ram_total // (1024 ** (s_suppkey % 4))::bigint * (case when s_suppkey % 7 = 0 then 96 else 1 end) as size from fx_nodes)
    select node_id, size, case when size >= 1099511627776 then printf('%.1fTB', size / 1099511627776.0)
      when size >= 1073741824 then printf('%.0fGB', size / 1073741824.0) when size >= 1048576 then printf('%.0fMB', size / 1048576.0)
      when size >= 1024 then printf('%.0fKB', size / 1024.0) else size||'B' end as short_text,
      case when size >= 1099511627776 then printf('%.1f TB', size / 1099511627776.0)
      when size >= 1073741824 then printf('%.1f GB', size / 1073741824.0) when size >= 1048576 then printf('%.1f MB', size / 1048576.0)
      when size >= 1024 then printf('%.1f KB', size / 1024.0) else size||' B' end as long_text
    from sized""",
)
def fn_format_bytes(spark, folder):
    """Node sizes scaled down by 0 to 3 units, and some up into the terabytes."""
    key = F.col("s_suppkey")
    scaled = F.floor(F.col("ram_total") / F.pow(F.lit(1024.0), key % 4)) * F.when(key % 7 == 0, 96).otherwise(1)
    size = scaled.cast("bigint")
    return fixture(spark, folder, "fx_nodes").select(
        "node_id", size.alias("size"), txt.format_bytes(size).alias("short_text"), txt.format_bytes_spaced(size).alias("long_text")
    )


@query(
    "fn_format_duration",
    "fx_raw",
    sql="""
    aged as (select event_id, (epoch_us(ts) - 1704067200000000) // 1000000 as s from fx_raw)
    select event_id, case when s < 60 then s||'s' when s < 3600 then (s // 60)||'m' when s < 86400 then (s // 3600)||'h' else (s // 86400)||'d' end as age
    from aged""",
)
def fn_format_duration(spark, folder):
    seconds = (F.unix_micros("ts") - F.lit(START_US)) / 1_000_000
    return fixture(spark, folder, "fx_raw").select("event_id", txt.format_duration(seconds).alias("age"))


START_US = 1_704_067_200_000_000


@query(
    "fn_parse_interval",
    "fx_raw",
    sql="""
    select event_id, case event_id % 5 when 0 then event_id * 1.0 when 1 then (event_id % 60) * 60 + (event_id % 59) * 1.0
      when 2 then -5400.0 when 3 then (event_id % 1000) / 1000.0 else -1.0 end::double as seconds, event_id % 5 <> 4 as valid
    from fx_raw""",
)
def fn_parse_interval(spark, folder):
    n, n_text = F.col("event_id"), F.col("event_id").cast("string")
    spelled = (
        F.when(n % 5 == 0, F.concat(n_text, F.lit("s")))
        .when(n % 5 == 1, F.concat((n % 60).cast("string"), F.lit("m"), (n % 59).cast("string"), F.lit("s")))
        .when(n % 5 == 2, F.lit("-1.5h"))
        .when(n % 5 == 3, F.concat((n % 1000).cast("string"), F.lit("ms")))
        .otherwise(F.concat(n_text, F.lit("x")))
    )
    seconds = txt.parse_interval(spelled)
    return fixture(spark, folder, "fx_raw").select(
        "event_id", F.coalesce(seconds, F.lit(-1.0)).alias("seconds"), seconds.isNotNull().alias("valid")
    )


# --- user functions -----------------------------------------------------------------------


def make_scorer():
    """The scoring rules as a plain Python function, built once per task."""

    def score(contact: dict) -> dict:
        points = 0
        for bound, value, _ in transforms.SIZE_STEPS:
            if contact["company_size"] > bound:
                points += value
                break
        for words, value, _ in transforms.TITLE_STEPS:
            if any(word in contact["title"] for word in words):
                points += value
                break
        if contact["industry"] in transforms.TARGET_INDUSTRIES:
            points += transforms.INDUSTRY_POINTS
        return {"contact_id": contact["id"], "score": points}

    return score


@query(
    "udf_transform",
    "fx_contacts",
    sql=SQL_SCORED
    + """select f.id, case when s.id is null then 'error: TypeError' else 'ok' end as outcome, coalesce(cast(s.score as varchar), '') as score
    from fx_contacts f left join scored s on f.id = s.id""",
)
def udf_transform(spark, folder):
    rows = contact_events(spark, folder).select(F.get_json_object("data", "$.id").alias("id"), "data")
    done = transforms.map_payloads(rows, make_scorer)
    return done.select("id", "outcome", text(F.get_json_object("data", "$.score")).alias("score"))


def make_parser():
    """A user parser: keeps documents with a type, filters the others."""

    def parse(document: dict) -> dict | None:
        if not document.get("type"):
            return None
        return {"kind": document["type"].upper()}

    return parse


@query(
    "udf_parser",
    "fx_docs",
    sql="""
    select event_id, case when not json_valid(data) then 'not json' when json_type(data) <> 'OBJECT' then 'not an object'
      when json_extract_string(data, '$.type') is null then 'filtered' else 'ok' end as outcome,
      case when json_valid(data) and json_type(data) = 'OBJECT' then coalesce(upper(json_extract_string(data, '$.type')), '') else '' end as kind
    from fx_docs""",
)
def udf_parser(spark, folder):
    done = transforms.map_payloads(fixture(spark, folder, "fx_docs").select("event_id", "data"), make_parser)
    return done.select("event_id", "outcome", text(F.get_json_object("data", "$.kind")).alias("kind"))


def make_responder():
    """A user responder that answers in plain text and refuses low scores."""

    def answer(prompt: str) -> str:
        if prompt.endswith("#0"):
            raise ValueError("nothing to say")
        return "seen " + prompt

    return answer


@query(
    "udf_responder",
    "fx_contacts",
    sql="""
    select id, case when c_custkey % 4 = 0 then '' else 'seen '||id||'#'||(c_custkey % 4) end as answer,
      case when c_custkey % 4 = 0 then 'ValueError' else '' end as ask_error
    from fx_contacts""",
)
def udf_responder(spark, folder):
    prompt = F.concat("id", F.lit("#"), (F.col("c_custkey") % 4).cast("string"))
    rows = fixture(spark, folder, "fx_contacts").select("id", prompt.alias("prompt"))
    done = responder.ask_function(rows, make_responder)
    return done.select("id", text("answer").alias("answer"), text("ask_error").alias("ask_error"))


STEP_PROMPT = "{{.contact_id}}:{{.score}}"


@query(
    "model_step",
    "fx_contacts",
    sql=SQL_SCORED
    + """select id as entity, 'lead.{missing}' as subject, 'nim:qualify' as source, 'seen '||id||':'||score as response, 'qualify' as actor,
      'update' as action
    from scored""",
)
def model_step(spark, folder):
    """Scored leads through a user responder; the published event and its log entry side by side."""
    leads = run_steps(contact_events(spark, folder), LEAD_CHAIN[:1]).where("subject = 'lead.scored'")
    answers = responder.model_step(leads, "qualify", STEP_PROMPT, "lead.{missing}", make_responder)
    published = answers.withColumns(
        {"out_subject": F.col("subject"), "out_source": F.col("source"), "response": F.get_json_object("answer", "$.response")}
    )
    entries = responder.recorded(published, "qualify")
    return entries.select("entity", F.col("out_subject").alias("subject"), F.col("out_source").alias("source"), "response", "actor", "action")
