"""The raw log: ingest, wire format, scans by subject pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pin import pin
from ..functions.subjects import literal_prefix, scan_pattern, subject_match, with_prefix
from ..operators.events import blank, iso

# Fixed value: every raw subject starts with this.
RAW_PREFIX = "river."
WIRE_SCHEMA = "subject string, data string, ts timestamp, _bad string"


def ingest(payloads: DataFrame) -> DataFrame:
    """Prefix the subject and add ``reject_reason`` to ``subject, data, ts`` rows."""
    subject, data = F.col("subject"), F.col("data")
    return payloads.withColumns(
        {
            "reject_reason": F.when(blank(subject), "empty subject").when(blank(data), "empty data"),
            "subject": with_prefix(F.coalesce(subject, F.lit("")), RAW_PREFIX),
        }
    )


def encode_wire(raw: DataFrame) -> Column:
    """JSON wire text of a raw record; the payload bytes travel as base64."""
    return F.to_json(
        F.struct(
            "subject",
            F.base64(F.col("data").cast("binary")).alias("data"),
            iso(F.col("ts")).alias("ts"),
        )
    )


def decode_wire(records: DataFrame, wire: str = "wire") -> DataFrame:
    """Decode wire text; ``decoded`` is false for records to be handed back."""
    body = F.from_json(
        F.col(wire), WIRE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    good = F.col("_w._bad").isNull() & F.col("_w").isNotNull()
    payload = F.try_to_binary(F.col("_w.data"), F.lit("base64"))
    return (
        pin(records, {"_w": body}).withColumns(
            {
                "decoded": F.coalesce(good & (payload.isNotNull() | F.col("_w.data").isNull()), F.lit(False)),
                "subject": F.col("_w.subject"),
                "data": payload.cast("string"),
                "sent_at": F.col("_w.ts"),
            }
        )
        .drop("_w", wire)
    )


def scan(raw: DataFrame, pattern: str = "") -> DataFrame:
    """Records whose subject matches; the prefix is implied and empty means all."""
    return raw.where(subject_match(F.col("subject"), scan_pattern(pattern, RAW_PREFIX)))


def write_raw(raw: DataFrame, path: str) -> None:
    """Append to a raw-log table partitioned by the token after the prefix."""
    (
        raw.withColumn("channel", F.split("subject", r"\.")[1])
        .write.mode("append")
        .partitionBy("channel")
        .parquet(path)
    )


def scan_table(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """Scan a raw-log table; a literal second token prunes whole partitions."""
    full = scan_pattern(pattern, RAW_PREFIX)
    table = spark.read.parquet(path)
    head = literal_prefix(full)
    channel = head.split(".")[1] if head.count(".") >= 2 or head == full else ""
    if channel:
        table = table.where(F.col("channel") == channel)
    return table.where(subject_match(F.col("subject"), full))
