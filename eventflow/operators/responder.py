"""Question-and-answer steps: render a prompt, ask, parse the answer, record it, publish it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import documents as doc
from ..functions.pin import pin
from ..functions.subjects import resolve_subject
from ..functions.templates import render
from .events import blank

# Payload fields that may name the entity, first string wins.
ID_FIELDS = ("id", "contact_id", "entity_id")
# The rule responder's two canned answers (our own wording, same fields).
CHAT_REPLY = "Hello! No model is configured, this is a canned reply."
LEAD_REPLY = (
    '{"pursue": true, "reason": "No model is configured", '
    '"priority": "medium", "action": "Configure a responder"}'
)


def ask_rules(prompt: Column) -> Column:
    """Answer without a model: chat prompts get an echo to the same chat, others a fixed verdict."""

    def found(name: str) -> Column:
        return F.regexp_extract(prompt, f'"{name}":\\s*"([^"]+)"', 1)

    platform, chat = found("platform"), found("chat_id")
    reply = F.concat(
        F.lit('{"platform": "'), platform, F.lit('", "chat_id": "'), chat, F.lit(f'", "text": "{CHAT_REPLY}"}}')
    )
    return F.when((platform != "") & (chat != ""), reply).otherwise(F.lit(LEAD_REPLY))


def ask_function(
    df: DataFrame, make: Callable[[], Callable[[str], str]], prompt: str = "prompt"
) -> DataFrame:
    """Ask a user responder in Arrow batches; ``make`` builds one responder per task.

    Adds ``answer`` and ``ask_error``. A failed question keeps its row, with the error named.
    """
    fields = df.schema.fields
    schema = T.StructType(
        [*fields, T.StructField("answer", T.StringType()), T.StructField("ask_error", T.StringType())]
    )

    def ask(responder: Callable[[str], str], text: str) -> tuple[str | None, str | None]:
        try:
            return responder(text), None
        except Exception as error:  # a responder may fail in any way; the row says so
            return None, type(error).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        responder = make()
        for batch in batches:
            done = [ask(responder, text) for text in batch.column(prompt).to_pylist()]
            columns = [
                *batch.columns,
                pa.array([a for a, _ in done], pa.string()),
                pa.array([e for _, e in done], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def parse_answer(answer: Column) -> Column:
    """JSON objects stay as they are, any other text is wrapped as ``{"response": text}``."""
    return F.when(doc.is_object(answer), answer).otherwise(F.to_json(F.struct(answer.alias("response"))))


def entity_id(document: Column) -> Column:
    """First string among the id fields of a VARIANT payload; NULL when none or empty."""
    return F.nullif(F.coalesce(*[doc.string_field(document, f) for f in ID_FIELDS]), F.lit(""))


def model_step(
    events: DataFrame,
    name: str,
    template: str,
    publishes: str,
    make: Callable[[], Callable[[str], str]] | None = None,
) -> DataFrame:
    """One model-backed step over events whose ``data`` is a JSON object.

    Adds ``prompt``, JSON ``answer``, the ``entity`` to record it under (NULL = not recorded), and
    the ``subject`` and ``source`` it is published with. Without ``make`` the rules answer.
    Unreadable payloads and failed questions are left out.
    """
    decoded = pin(events.where(doc.is_object(F.col("data"))), {"_in": doc.decode(F.col("data"))})
    ready = pin(
        decoded, {"prompt": render(template, F.col("_in")), "entity": entity_id(F.col("_in"))}
    ).drop("_in")
    if make is None:
        asked = pin(ready, {"answer": ask_rules(F.col("prompt"))})
    else:
        asked = ask_function(ready, make).where(F.col("ask_error").isNull()).drop("ask_error")
    parsed = pin(asked, {"answer": parse_answer(F.col("answer"))})
    return parsed.withColumns(
        {
            "subject": resolve_subject(publishes, doc.decode(F.col("answer"))),
            "source": F.lit(f"nim:{name}"),
        }
    )


def recorded(answers: DataFrame, name: str) -> DataFrame:
    """Change-log entries of a model step's answers."""
    return answers.where(~blank(F.col("entity"))).select(
        *[c for c in answers.columns if c not in ("data", "answer", "prompt", "subject", "source")],
        F.lit(name).alias("actor"),
        F.lit("update").alias("action"),
        F.col("answer").alias("data"),
    )
