"""The event envelope: validation, guards, metadata, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as doc

# Fixed value: the source name stamped on payloads read from the raw log.
RAW_SOURCE = "river"


def iso(ts: Column) -> Column:
    """UTC text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def blank(value: Column) -> Column:
    """NULL or empty."""
    return F.coalesce(F.length(value) == 0, F.lit(True))


def event_problem() -> Column:
    """First rule an event breaks, NULL for a valid one."""
    return (
        F.when(blank(F.col("subject")), "empty subject")
        .when(blank(F.col("source")), "empty source")
        .when(blank(F.col("data")), "empty data")
        .when(F.col("ts").isNull(), "missing time")
    )


def validate(events: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (NULL = valid) to ``subject, source, data, ts`` rows."""
    return events.withColumn("reject_reason", event_problem())


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNotNull())


def guard_payload(df: DataFrame, payload: str = "data") -> DataFrame:
    """Add ``reject_reason``: payloads must be JSON objects (JSON null is not one). Valid JSON too large
    for a VARIANT is told apart from text that is no JSON."""
    text = F.col(payload)
    unread = F.when(doc.too_large(text), "too large").otherwise("not json")
    return df.withColumn(
        "reject_reason", F.when(~doc.is_object(text), F.when(doc.decode(text).isNull(), unread).otherwise("not an object"))
    )


def add_metadata(df: DataFrame, payload: str = "data") -> DataFrame:
    """Write ``_subject`` and ``_source`` into the payload object."""
    return df.withColumn(
        payload,
        doc.merge_fields(F.col(payload), {"_subject": F.col("subject"), "_source": F.lit(RAW_SOURCE)}),
    )


def default_source(df: DataFrame, emitter: str, role: str | None = None) -> DataFrame:
    """Fill an empty ``source`` with the emitter's name, optionally as ``role:name``."""
    name = f"{role}:{emitter}" if role else emitter
    return df.withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(name)))


def publish(events: DataFrame) -> DataFrame:
    """Key/value records of the valid events (the shape a Kafka sink takes)."""
    value = F.struct("subject", "data", "source", iso(F.col("ts")).alias("ts"))
    return accepted(validate(events)).select(
        *[c for c in events.columns if c not in ("subject", "data", "source", "ts")],
        F.col("subject").alias("key"),
        F.to_json(value, {"ignoreNullFields": "false"}).alias("value"),
    )


def write_events(events: DataFrame, path: str) -> None:
    """Append valid events to a table partitioned by the first subject token."""
    (
        accepted(validate(events))
        .withColumn("subject_head", F.substring_index("subject", ".", 1))
        .write.mode("append")
        .partitionBy("subject_head")
        .parquet(path)
    )
