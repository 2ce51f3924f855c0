"""Reactors: one event in, several effects out (log entries and further events).

Every reactor returns the input's position and time plus ``kind`` (``change`` for a log entry,
``event`` for a further event), ``target`` (entity or subject), ``action`` (for changes), ``source``
and JSON ``data``. Ids come from the event's position or time, never from a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as doc
from .events import iso

# Names the reactors sign their effects with.
AFTERSALES, GENERAL = "aftersales-nim", "general-nim"
# Amount from which a thank-you mail goes out, hours until a task is due.
MAIL_FROM = 100.0
DUE_HOURS = {"pending": 24, "urgent": 2}
# Priorities forwarded at once.
URGENT = ("high", "urgent")
TASK_SCHEMA = (
    "id string, customer_id string, type string, description string, status string, "
    "due_date timestamp, created_at timestamp, updated_at timestamp"
)
ARCHIVE_PREFIX = "general."


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _effect(kind: str, target: Column, action: str | None, body: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        target.alias("target"),
        F.lit(action).cast("string").alias("action"),
        body.alias("data"),
    )


def _emit(events: DataFrame, position: str, actor: str, effects: list[Column]) -> DataFrame:
    many = F.inline(F.array_compact(F.array(*effects)))
    return events.select(position, "ts", F.lit(actor).alias("source"), many)


def _task(task_id: Column, task_type: str, description: Column, status: str) -> Column:
    ts = F.col("ts")
    due = ts + F.make_interval(hours=F.lit(DUE_HOURS[status]))
    return doc.encode(
        F.struct(
            task_id.alias("id"),
            F.col("payment.customer_id"),
            F.lit(task_type).alias("type"),
            description.alias("description"),
            F.lit(status).alias("status"),
            iso(due).alias("due_date"),
            iso(ts).alias("created_at"),
            iso(ts).alias("updated_at"),
        )
    )


def _followup(reason: Column, status: str) -> Column:
    due = F.col("ts") + F.make_interval(hours=F.lit(DUE_HOURS[status]))
    body = doc.encode(F.struct(F.col("payment.customer_id"), reason.alias("reason"), iso(due).alias("due_date")))
    return _effect("event", F.lit("followup.required"), None, body)


def _completed_effects() -> list[Column]:
    p = F.col("payment")
    task_id = F.concat(F.lit("task-"), p["customer_id"], F.lit("-"), F.unix_seconds("ts").cast("string"))
    money = F.format_string("%.2f %s", p["amount"], p["currency"])
    description = F.concat(F.lit("Follow up on purchase of "), p["item_id"], F.lit(" ("), money, F.lit(")"))
    mail = doc.encode(
        F.struct(
            p["customer_id"].alias("to"),
            F.lit("Thank you for your purchase!").alias("subject"),
            F.concat(F.lit("We appreciate your purchase of "), money).alias("body"),
            F.lit("thank_you_template").alias("template_id"),
        )
    )
    return [
        _effect("change", task_id, "create", _task(task_id, "followup", description, "pending")),
        _followup(F.lit("post_purchase_followup"), "pending"),
        F.when(p["amount"] >= MAIL_FROM, _effect("event", F.lit("email.send"), None, mail)),
    ]


def _failed_effects() -> list[Column]:
    p = F.col("payment")
    task_id = F.concat(F.lit("task-"), p["customer_id"], F.lit("-failed-"), F.unix_seconds("ts").cast("string"))
    money = F.format_string("%.2f %s", p["amount"], p["currency"])
    description = F.concat(F.lit("Reach out about failed payment ("), money, F.lit("): "), p["reason"])
    return [
        _effect("change", task_id, "create", _task(task_id, "payment_failure", description, "urgent")),
        _followup(F.concat(F.lit("payment_failed: "), p["reason"]), "urgent"),
    ]


def on_payment_completed(payments: DataFrame, position: str = "event_id") -> DataFrame:
    """Follow-up task, ``followup.required``, and a mail when the amount is large."""
    done = payments.where(F.col("subject") == "payment.completed")
    return _emit(done, position, AFTERSALES, _completed_effects())


def on_payment_failed(payments: DataFrame, position: str = "event_id") -> DataFrame:
    """Urgent task and a follow-up that names the reason."""
    failed = payments.where(F.col("subject") == "payment.failed")
    return _emit(failed, position, AFTERSALES, _failed_effects())


def on_payment(payments: DataFrame, position: str = "event_id") -> DataFrame:
    """Both payment reactors in one pass over the events."""
    good = F.col("subject") == "payment.completed"
    effects = [F.when(good, e) for e in _completed_effects()] + [F.when(~good, e) for e in _failed_effects()]
    return _emit(payments, position, AFTERSALES, effects)


def on_data_received(events: DataFrame, position: str = "event_id") -> DataFrame:
    """A stored record and ``data.processed`` as confirmation."""
    got = events.where(F.col("subject") == "data.received")
    record_id = F.concat(F.lit("data-record-"), F.col(position).cast("string"))
    record = doc.encode(
        F.struct(
            record_id.alias("id"),
            doc.field(F.col("payload"), "source").alias("source"),
            doc.field(F.col("payload"), "data").alias("data"),
            iso_seconds(F.col("ts")).alias("received_at"),
            F.lit(True).alias("processed"),
        )
    )
    done = doc.encode(F.struct(record_id.alias("record_id"), F.lit("processed").alias("status")))
    return _emit(
        got,
        position,
        GENERAL,
        [_effect("change", record_id, "create", record), _effect("event", F.lit("data.processed"), None, done)],
    )


def on_notification(events: DataFrame, position: str = "event_id") -> DataFrame:
    """High priorities are forwarded unchanged, the rest is queued as unsent records."""
    got = events.where(F.col("subject") == "notification.required")
    urgent = F.coalesce(doc.string_field(F.col("payload"), "priority").isin(*URGENT), F.lit(False))
    queue_id = F.concat(F.lit("notification-"), F.col(position).cast("string"))
    queued = doc.encode(
        F.struct(
            queue_id.alias("id"),
            *[doc.field(F.col("payload"), f).alias(f) for f in ("priority", "message", "recipient")],
            iso_seconds(F.col("ts")).alias("queued_at"),
            F.lit(False).alias("sent"),
        )
    )
    return _emit(
        got,
        position,
        GENERAL,
        [
            F.when(urgent, _effect("event", F.lit("notification.send.immediate"), None, F.col("data"))),
            F.when(~urgent, _effect("change", queue_id, "create", queued)),
        ],
    )


def archive(events: DataFrame, position: str = "event_id") -> DataFrame:
    """Any ``general.<x>`` event becomes an archive record; unreadable payloads are skipped."""
    got = events.where(
        F.col("subject").startswith(ARCHIVE_PREFIX)
        & (F.length("subject") > len(ARCHIVE_PREFIX))
        & doc.is_object(F.col("data"))
    )
    archive_id = F.concat(F.lit("event-"), F.col(position).cast("string"))
    record = doc.encode(
        F.struct(
            archive_id.alias("id"),
            "subject",
            "source",
            iso_seconds(F.col("ts")).alias("timestamp"),
            doc.decode(F.col("data")).alias("data"),
        )
    )
    return _emit(got, position, GENERAL, [_effect("change", archive_id, "create", record)])


def changes(effects: DataFrame) -> DataFrame:
    """The effects that belong on the change log, shaped as its entries."""
    return effects.where(F.col("kind") == "change").select(
        *[c for c in effects.columns if c not in ("kind", "target", "source")],
        F.col("target").alias("entity"),
        F.col("source").alias("actor"),
    )


def emitted(effects: DataFrame) -> DataFrame:
    """The effects that are further events."""
    return effects.where(F.col("kind") == "event").select(
        *[c for c in effects.columns if c not in ("kind", "target", "action")],
        F.col("target").alias("subject"),
    )


def tasks(state: DataFrame) -> DataFrame:
    """Task rows of a state table (typed from the JSON data)."""
    return state.select("entity", F.from_json("data", TASK_SCHEMA).alias("task")).select("entity", "task.*")


def complete_tasks(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Update entries that set tasks to completed; unknown ids get ``reject_reason``.

    ``requests`` has ``task_id`` and ``ts``. The last writer wins; no revision is checked.
    """
    rows = requests.join(tasks(state), requests["task_id"] == F.col("entity"), "left")
    body = doc.encode(
        F.struct(
            "id",
            "customer_id",
            "type",
            "description",
            F.lit("completed").alias("status"),
            iso(F.col("due_date")).alias("due_date"),
            iso(F.col("created_at")).alias("created_at"),
            iso(F.col("ts")).alias("updated_at"),
        )
    )
    found = F.col("entity").isNotNull()
    return rows.select(
        "task_id",
        "ts",
        F.lit(AFTERSALES).alias("actor"),
        F.col("entity"),
        F.when(found, F.lit("update")).alias("action"),
        F.when(found, body).alias("data"),
        F.when(~found, F.lit("not found")).alias("reject_reason"),
    )
