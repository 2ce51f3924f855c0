"""Count windows: recorded rows are numbered, and a trigger fires at every N-th."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import interval_seconds, interval_text
from ..operators.ordered import number_rows

# Default rate and default interval.
DEFAULT_HZ = 90
DEFAULT_INTERVAL = "60s"


def numbered(rows: DataFrame, position: str, last_seq: int = 0) -> DataFrame:
    """Recorded rows with ``seq`` 1, 2, .. after ``last_seq``, whatever gaps the position has."""
    return number_rows(rows, position, "seq", last_seq)


def tick_stream(spark: SparkSession, hz: int = DEFAULT_HZ) -> DataFrame:
    """Endless ticks from Spark's rate source."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", hz).load()
    return rate.select(
        (F.col("value") + 1).alias("seq"),
        (F.unix_micros("timestamp") * 1000).alias("ts_ns"),
        F.lit(hz).alias("hz"),
    )


def ticks_per_trigger(interval: str = DEFAULT_INTERVAL, hz: int = DEFAULT_HZ) -> int:
    """Whole seconds of the interval times the rate, at least 1; bad values take the defaults."""
    hz = hz if hz > 0 else DEFAULT_HZ
    seconds = interval_seconds(interval)
    if seconds <= 0:
        seconds = interval_seconds(DEFAULT_INTERVAL)
    return max(int(seconds) * hz, 1)


def triggers(
    rows: DataFrame,
    source: str,
    interval: str = DEFAULT_INTERVAL,
    hz: int = DEFAULT_HZ,
    payload: str | None = None,
    started: Column | None = None,
) -> DataFrame:
    """One record per N numbered rows (``seq, ts``), with the time of the row that fires it.

    The uptime is rounded to seconds since ``started``, by default the earliest time of the rows.
    """
    n = ticks_per_trigger(interval, hz)
    if started is None:
        started = rows.agg(F.min("ts").alias("ts")).scalar()
    up = F.round((F.unix_micros("ts") - F.unix_micros(started)) / 1e6).cast("bigint")
    return rows.where(F.col("seq") % n == 0).select(
        F.lit(source).alias("source"),
        F.floor(F.col("seq") / n).cast("bigint").alias("trigger"),
        F.lit(interval).alias("interval"),
        "ts",
        F.lit(payload).cast("string").alias("payload"),
        F.lit(n).cast("bigint").alias("beat_count"),
        interval_text(up).alias("uptime"),
    )
