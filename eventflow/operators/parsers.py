"""Parsers: raw records to typed events. Rows that do not parse are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as doc
from ..functions.cases import constant_map, first_case
from ..functions.pin import pin
from ..sources.captures import chat_update, unwrap

CHARGE_SCHEMA = """
  type variant,
  data struct<object: struct<id: variant, amount: bigint, currency: variant, customer: variant,
    status: variant, failure_message: variant, metadata: map<string, variant>>>,
  _bad string
"""
WEBHOOK_SCHEMA = "type variant, timestamp variant, data variant, payload variant"
# Event types of the charge provider and the subjects they become.
CHARGE_SUBJECTS = {"charge.succeeded": "payment.completed", "charge.failed": "payment.failed"}
# Raw subjects the two built-in parsers read, and their names as event sources.
CHARGE_PATTERN, CHARGE_PARSER = "river.stripe.webhook", "payment-tree"
GENERAL_PATTERN, GENERAL_PARSER = "river.general.>", "general-tree"
# General event types with their own subject and payload fields.
GENERAL_EVENTS = {
    "data.received": ("data.received", ("timestamp", "source", "data")),
    "status.update": ("status.update", ("entity_id", "status", "message")),
    "notification": ("notification.required", ("priority", "message", "recipient")),
}
GENERAL_OTHER = "general.event"
# Mention kinds of a chat message, and the platform name.
MENTION_KINDS = ("mention", "text_mention")
CHAT_PLATFORM = "telegram"


def _only_text(fields: Column) -> Column:
    """Every VARIANT of a struct or map is missing, null or a string.

    Read off the JSON text: a key's closing quote and colon must be followed by a quote or null.
    Quotes inside strings are escaped and do not count.
    """
    return F.coalesce(~F.to_json(fields).rlike(r'(?<!\\)":(?!"|null)'), F.lit(True))


def parse_payment(raw: DataFrame) -> DataFrame:
    """Charge documents to ``payment.completed`` / ``payment.failed`` events.

    Adds a typed ``payment`` struct (cents become currency units, a missing or empty item is
    ``unknown``), and ``subject``, ``source`` and JSON ``data`` of the event. Types are strict: a
    charge with a number where text belongs does not parse.
    """
    charge = F.from_json("data", CHARGE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    texts = [F.col(f"_d.data.object.{n}") for n in ("id", "currency", "customer", "status", "failure_message")]
    strict = _only_text(F.struct("_d.type", *texts)) & _only_text(F.col("_d.data.object.metadata"))
    decoded = pin(raw, {"_d": charge}).where(F.col("_d._bad").isNull())
    kind = doc.scalar_text(F.col("_d.type"))
    parsed = pin(decoded, {"_type": kind, "_strict": strict}).where(
        F.col("_strict") & F.col("_type").isin(*CHARGE_SUBJECTS)
    )

    def text(name: str) -> Column:
        return F.coalesce(doc.scalar_text(F.col(f"_d.data.object.{name}")), F.lit(""))

    item = F.nullif(doc.scalar_text(F.try_element_at("_d.data.object.metadata", F.lit("item_id"))), F.lit(""))
    failed = F.col("_type") == "charge.failed"
    payment = F.struct(
        text("customer").alias("customer_id"),
        (F.coalesce(F.col("_d.data.object.amount"), F.lit(0)) / 100.0).alias("amount"),
        text("currency").alias("currency"),
        F.coalesce(item, F.lit("unknown")).alias("item_id"),
        F.when(failed, text("failure_message")).alias("reason"),
    )
    return pin(parsed, {"payment": payment}).withColumns(
        {
            "subject": constant_map(CHARGE_SUBJECTS)[F.col("_type")],
            "source": F.lit(CHARGE_PARSER),
            "data": F.to_json("payment"),
        }
    ).drop("_d", "_type", "_strict")


def parse_general(raw: DataFrame) -> DataFrame:
    """Typed dispatch of general documents; a missing or non-string ``type`` is dropped.

    Adds ``payload`` (VARIANT of the source document), ``event_type``, ``subject``, ``source`` and
    the event's JSON ``data``. Columns a consumer does not read are never computed.
    """
    decoded = pin(raw, {"payload": doc.decode(F.col("data"))})
    parsed = pin(decoded, {"event_type": doc.string_field(F.col("payload"), "type")}).where(
        F.col("event_type").isNotNull()
    )
    kind = F.col("event_type")

    def body(fields: tuple[str, ...]) -> Column:
        return doc.encode(F.struct(kind, *[doc.field(F.col("payload"), f).alias(f) for f in fields]))

    events = GENERAL_EVENTS.items()
    other = doc.encode(F.struct(kind, F.col("payload").alias("raw_data")))
    return parsed.withColumns(
        {
            "subject": first_case([(kind == n, target) for n, (target, _) in events], GENERAL_OTHER),
            "source": F.lit(GENERAL_PARSER),
            "data": first_case([(kind == n, body(fields)) for n, (_, fields) in events], other),
        }
    )


def parse_webhook(raw: DataFrame) -> DataFrame:
    """Generic webhook document to ``original_type, timestamp, body``.

    ``body`` is the document's ``data``, else its ``payload``, else an empty object; a missing
    time is the record's own.
    """

    objects = raw.where(doc.is_object(F.col("data")))
    decoded = pin(objects, {"_v": F.from_json("data", WEBHOOK_SCHEMA)})
    texts = {f"_{name}": F.to_json(f"_v.{name}") for name in ("type", "timestamp", "data", "payload")}

    def present(name: str) -> Column:
        """JSON text of a field; null and false count as missing."""
        return F.when(~F.col(f"_{name}").isin("null", "false"), F.col(f"_{name}"))

    def shown(name: str) -> Column:
        return F.when(present(name).isNotNull(), doc.scalar_text(F.col(f"_v.{name}")))

    now = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        pin(decoded, texts)
        .withColumns(
            {
                "original_type": F.coalesce(shown("type"), F.lit("unknown")),
                "timestamp": F.coalesce(shown("timestamp"), now),
                "body": F.coalesce(present("data"), present("payload"), F.lit("{}")),
            }
        )
        .drop("_v", *texts)
    )


def parse_chat(raw: DataFrame) -> DataFrame:
    """Wrapped chat updates to platform-neutral messages (a ``message`` struct).

    Updates without an id or a message are left out. Mentions are cut by characters.
    """
    parsed = pin(raw, {"_u": chat_update(unwrap(F.col("data")))}).where(
        F.col("_u.update_id").isNotNull() & F.col("_u.message").isNotNull() & F.col("_u._bad").isNull()
    )
    m = F.col("_u.message")
    text = F.coalesce(m["text"], F.lit(""))

    def id_text(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit(""))

    named = F.coalesce(
        F.filter(m["entities"], lambda e: e["type"].isin(*MENTION_KINDS)), F.array().cast("array<struct<type:string,offset:int,length:int>>")
    )
    mentions = F.transform(named, lambda e: F.substring(text, e["offset"] + 1, e["length"]))
    metadata = F.create_map(
        F.lit("message_id"),
        id_text(m["message_id"]),
        F.lit("chat_type"),
        F.coalesce(m["chat"]["type"], F.lit("unknown")),
        F.lit("chat_title"),
        m["chat"]["title"],
    )
    sent = F.coalesce(F.timestamp_seconds(m["date"]), F.col("ts"))
    message = F.struct(
        F.lit(CHAT_PLATFORM).alias("platform"),
        id_text(m["chat"]["id"]).alias("chat_id"),
        id_text(m["from"]["id"]).alias("user_id"),
        F.coalesce(m["from"]["username"], m["from"]["first_name"], F.lit("")).alias("username"),
        text.alias("text"),
        mentions.alias("mentions"),
        id_text(m["reply_to_message"]["message_id"]).alias("reply_to"),
        F.map_filter(metadata, lambda _k, v: v.isNotNull()).alias("metadata"),
        F.date_format(sent, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )
    return pin(parsed, {"message": message}).drop("_u")
