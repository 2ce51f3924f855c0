"""Outbound messages as a table; delivery is left to a writer the user passes in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pin import pin
from ..functions.subjects import subject_match

OUT_SCHEMA = "platform string, chat_id string, text string, reply_to string, _bad string"


def messages(events: DataFrame, pattern: str, platform: str) -> DataFrame:
    """Events on the pattern whose platform fits, as ``chat_id, text`` (reply_to is not sent)."""
    message = F.from_json("data", OUT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = pin(events.where(subject_match(F.col("subject"), pattern)), {"_m": message})
    fits = F.col("_m._bad").isNull() & (F.col("_m.platform") == platform)
    return parsed.where(fits).select(
        *[c for c in events.columns if c not in ("data", "source")],
        F.coalesce("_m.chat_id", F.lit("")).alias("chat_id"),
        F.coalesce("_m.text", F.lit("")).alias("text"),
    )


def deliver(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Run the user's writer over the outbox stream, one call per micro-batch."""
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
