"""Captured requests and responses turned into raw records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as doc
from ..functions import signatures as sig
from ..functions.pin import pin
from ..operators.events import iso
from ..operators.ordered import SEGMENT_WIDTH, Running, running

CHAT_SCHEMA = """
  update_id bigint,
  message struct<
    message_id: bigint,
    `from`: struct<id: bigint, first_name: string, last_name: string, username: string>,
    chat: struct<id: bigint, type: string, title: string>,
    date: bigint,
    text: string,
    reply_to_message: struct<message_id: bigint>,
    entities: array<struct<type: string, offset: int, length: int>>>,
  _bad string
"""


def chat_update(body: Column) -> Column:
    """Typed chat update; ``_bad`` is set when the text does not fit."""
    return F.from_json(body, CHAT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def wrap(body: Column, ts: Column, source: Column, headers: Column | None = None) -> Column:
    """Wrapper document ``{headers, body, timestamp, source}`` around a JSON body."""
    fields = [
        doc.decode(body).alias("body"),
        iso(ts).alias("timestamp"),
        source.alias("source"),
    ]
    if headers is not None:
        # An empty header map is left out of the wrapper.
        fields.insert(0, F.when(F.size(headers) > 0, headers).alias("headers"))
    return F.to_json(F.struct(*fields))


def capture_webhooks(
    requests: DataFrame,
    source: str | Column,
    subject: str | Column,
    keep_headers: list[str],
    secrets: dict[str, str] | None = None,
) -> DataFrame:
    """Give every captured request its response ``status``; accepted ones get ``subject, data``.

    Columns read: ``method, path, source_running, headers (map), body, captured_at``.
    ``secrets`` maps a request path to its signing secret; other paths are not checked. A body that is
    no JSON gets 500, valid JSON too large to be wrapped 413.
    """
    source = F.lit(source) if isinstance(source, str) else source
    subject = F.lit(subject) if isinstance(subject, str) else subject
    path, body, headers = F.col("path"), F.col("body"), F.col("headers")
    verdict = F.lit("ok")
    for checked, secret in (secrets or {}).items():
        verdict = F.when(
            path == checked, sig.verify_request(path, secret, body, headers, F.col("captured_at"))
        ).otherwise(verdict)
    status = (
        F.when(F.col("method") != "POST", 405)
        .when(~F.col("source_running"), 503)
        .when(verdict != "ok", 401)
        .when(doc.too_large(body), 413)
        .when(doc.decode(body).isNull(), 500)
        .otherwise(200)
    )
    kept = F.map_filter(headers, lambda k, v: k.isin(keep_headers) & (v != ""))
    return pin(requests, {"status": status}).withColumns(
        {
            "subject": F.when(F.col("status") == 200, subject),
            "data": F.when(F.col("status") == 200, wrap(body, F.col("captured_at"), source, kept)),
        }
    )


def unwrap(data: Column) -> Column:
    """Body of a wrapper document as JSON text; other documents pass through.

    The body may be an object or a string that holds JSON.
    """
    body = F.from_json(data, "body variant").getField("body")
    return F.coalesce(doc.scalar_text(body), data)


def capture_chat(updates: DataFrame, source: str, subject: str, body: str = "body", ts: str = "ts") -> DataFrame:
    """Chat webhook landing: 400 for bad JSON, 200 otherwise; only updates with a message land."""
    parsed = chat_update(F.col(body))
    return (
        pin(updates, {"_u": parsed})
        .withColumn("status", F.when(F.col("_u").isNull() | F.col("_u._bad").isNotNull(), 400).otherwise(200))
        .withColumn("landed", (F.col("status") == 200) & F.col("_u.message").isNotNull())
        .withColumns(
            {
                "subject": F.when(F.col("landed"), F.lit(subject)),
                "data": F.when(F.col("landed"), wrap(F.col(body), F.col(ts), F.lit(source))),
            }
        )
        .drop("_u")
    )


def poll_cursors(
    responses: DataFrame,
    path: str,
    param: str,
    position: str = "event_id",
    width: int = SEGMENT_WIDTH,
) -> DataFrame:
    """Per source: cursor in force after each response, and the one its request was sent with.

    A response without a cursor keeps the previous one. ``request_url`` is the base ``url``
    with the request's cursor as a query parameter.
    """
    found = F.nullif(doc.path_text(F.col("body"), path), F.lit(""))
    with_found = pin(responses, {"_found": found})
    cursors = running(
        with_found,
        ["source"],
        position,
        [
            Running("cursor", F.col("_found"), "last"),
            Running("request_cursor", F.col("_found"), "last", strict=True),
        ],
        width=width,
    ).drop("_found")
    # A parameter of that name that the URL already has is replaced.
    bare = F.regexp_replace("url", f"(?<=[?&]){re.escape(param)}=[^&#]*(&|(?=#)|$)", "")
    bare = F.regexp_replace(bare, "[?&]$", "")
    glue = F.when(bare.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    query = F.concat(bare, glue, F.lit(param + "="), F.url_encode("request_cursor"))
    return cursors.withColumn("request_url", F.coalesce(query, F.col("url")))


def capture_polls(
    responses: DataFrame,
    path: str,
    param: str,
    subject: Column,
    position: str = "event_id",
    width: int = SEGMENT_WIDTH,
) -> DataFrame:
    """Poll responses as raw records; any HTTP status is kept, failed or non-JSON ones only count.

    Columns read: ``source, url, status_code, body, ts``, optionally ``headers`` (map of lists).
    A NULL ``status_code`` stands for a request that failed. Adds ``failed``.
    """
    cursors = poll_cursors(responses, path, param, position, width)
    fields = [F.col("request_url").alias("url"), "status_code"]
    if "headers" in responses.columns:
        first = F.transform_values("headers", lambda _k, v: F.get(v, F.lit(0)))
        fields.append(F.map_filter(first, lambda _k, v: v.isNotNull()).alias("headers"))
    fields += [
        doc.decode(F.col("body")).alias("body"),
        iso(F.col("ts")).alias("timestamp"),
        "source",
        F.nullif("cursor", F.lit("")).alias("cursor"),
    ]
    failed = F.col("status_code").isNull() | doc.decode(F.col("body")).isNull()
    return pin(cursors, {"failed": failed}).withColumns(
        {
            "subject": F.when(~F.col("failed"), subject),
            "data": F.when(~F.col("failed"), F.to_json(F.struct(*fields))),
        }
    )
