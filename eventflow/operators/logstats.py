"""Counts, lag, thresholds and running stock over logs and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import SEG, SEGMENT_WIDTH, Running, running, segment_of
from .routing import match_subjects


def _uptime() -> Column:
    """Whole seconds from the first row to the last."""
    return F.floor(F.unix_micros(F.max("ts")) / 1_000_000) - F.floor(F.unix_micros(F.min("ts")) / 1_000_000)


def poll_stats(responses: DataFrame) -> DataFrame:
    """Per source: polls, failed polls (see ``captures.capture_polls``), last poll time and uptime."""
    return responses.groupBy("source").agg(
        F.count("*").alias("polls"), F.count_if("failed").alias("errors"), F.max("ts").alias("last_poll"), _uptime().alias("uptime_s")
    )


def trigger_stats(beats: DataFrame, per_trigger: int) -> DataFrame:
    """Per source: triggers fired, beats since the last one, time of the last beat and uptime."""
    n = F.count("*")
    return beats.groupBy("source").agg(
        F.floor(n / per_trigger).cast("bigint").alias("triggers"), (n % per_trigger).alias("beats"), F.max("ts").alias("last_beat"), _uptime().alias("uptime_s")
    )


def source_stats(polled: DataFrame, timed: DataFrame) -> DataFrame:
    """Statistics of polled and timed sources in one table; what a kind does not count is 0."""
    both = polled.withColumnRenamed("last_poll", "last_at").unionByName(timed.withColumnRenamed("last_beat", "last_at"), allowMissingColumns=True)
    return both.fillna(0, ["polls", "errors", "triggers", "beats"])


def stream_stats(raw: DataFrame, consumers: DataFrame) -> DataFrame:
    """Messages and payload bytes per subject, and per stream, with its number of consumers, in rows
    with subject ``''``. Each message adds to two running groups before the shuffle; consumers are
    counted per stream before they are joined."""
    stream = F.substring_index("subject", ".", 1)
    readers = consumers.groupBy(F.substring_index("filter_subject", ".", 1).alias("stream")).agg(F.count("*").alias("consumers"))
    counted = (
        raw.withColumn("stream", stream)
        .groupingSets([["stream", "subject"], ["stream"]], "stream", "subject")
        .agg(F.count("*").alias("messages"), F.sum(F.octet_length("data")).cast("bigint").alias("bytes"))
        .withColumn("subject", F.coalesce("subject", F.lit("")))
    )
    of_stream = F.when(F.col("subject") == "", F.col("consumers"))
    return counted.join(readers, "stream", "left").withColumn("consumers", F.coalesce(of_stream, F.lit(0)))


def consumer_lag(raw: DataFrame, consumers: DataFrame, position: str, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Messages matching each consumer's filter after its position, and those delivered but not
    acknowledged.

    ``consumers`` has ``consumer, filter_subject, position`` and ``acked`` (not above the position).
    The log is counted per (subject, segment) first; whole segments behind a position are summed
    from the counts, and only the segment a position falls into is looked at row by row.
    """
    marks = F.array(
        F.struct(F.lit(True).alias("delivered"), F.col("position").alias("_pos")),
        F.struct(F.lit(False).alias("delivered"), F.col("acked").alias("_pos")),
    )
    rules = consumers.select("consumer", F.col("filter_subject").alias("pattern"), F.inline(marks))
    counts = raw.groupBy("subject", segment_of(position, width).alias(SEG)).agg(F.count("*").alias("n"))
    subjects = counts.select("subject").distinct()
    pairs = match_subjects(subjects, rules).select("subject", "consumer", "delivered", "_pos", segment_of("_pos", width).alias("_pos_seg"))
    whole = (
        counts.join(pairs, "subject")
        .where(F.col(SEG) > F.col("_pos_seg"))
        .groupBy("consumer", "delivered")
        .agg(F.sum("n").alias("n"))
    )
    edge = (
        raw.select("subject", F.col(position).alias("_at"), segment_of(position, width).alias("_pos_seg"))
        .join(pairs, ["subject", "_pos_seg"])
        .where(F.col("_at") > F.col("_pos"))
        .groupBy("consumer", "delivered")
        .agg(F.count("*").alias("n"))
    )
    after = whole.unionByName(edge).groupBy("consumer").agg(
        F.sum(F.when(F.col("delivered"), F.col("n"))).alias("_new"), F.sum(F.when(~F.col("delivered"), F.col("n"))).alias("_open")
    )
    new, unsettled = F.coalesce("_new", F.lit(0)), F.coalesce("_open", F.lit(0))
    return (
        consumers.join(after, "consumer", "left")
        .withColumns({"pending": new.cast("bigint"), "ack_pending": (unsettled - new).cast("bigint")})
        .drop("_new", "_open")
    )


def event_counts(events: DataFrame, by: list[str | Column]) -> DataFrame:
    """Completed and failed events per subject head and the given columns, with success rate."""
    done = F.count_if(F.col("subject").endswith(".completed"))
    failed = F.count_if(F.col("subject").endswith(".failed"))
    return (
        events.where(F.col("subject").endswith(".completed") | F.col("subject").endswith(".failed"))
        .groupBy(F.substring_index("subject", ".", 1).alias("head"), *by)
        .agg(done.alias("completed"), failed.alias("failed"))
        .withColumn("success_rate", F.col("completed") / (F.col("completed") + F.col("failed")))
    )


def threshold_metrics(readings: DataFrame, key: str, value: str, limit: float, every: str = "1 hour") -> DataFrame:
    """Per key and time window: readings, smallest, largest, and how many exceed the limit.

    ``alert`` is true when any does. Works on streams too (add a watermark for bounded state).
    """
    return (
        readings.groupBy(F.window("ts", every), key)
        .agg(
            F.count("*").alias("readings"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            F.count_if(F.col(value) > limit).alias("over"),
        )
        .select(F.col("window.start").alias("start"), key, "readings", "low", "high", "over", (F.col("over") > 0).alias("alert"))
    )


def reorder_alerts(
    orders: DataFrame,
    key: str,
    order: list[str],
    quantity: str,
    initial: float,
    level: float,
    segment: Column,
) -> DataFrame:
    """The order line at which each item's stock first falls below the reorder level.

    Stock only falls, so the crossing is where it is below the level now and was not before; no
    ranking is needed. ``segment`` must never decrease along ``order``.
    """
    swept = running(orders, [key], order, [Running("_sold", F.col(quantity), "sum")], segment=segment)
    stock = F.lit(initial) - F.col("_sold")
    return (
        swept.withColumn("stock", stock)
        .where((F.col("stock") < level) & (F.col("stock") + F.col(quantity) >= level))
        .drop("_sold")
    )
