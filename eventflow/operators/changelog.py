"""The append-only change log: validation, slots, ordered reads, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .events import blank
from .ordered import SEG, SEGMENT_WIDTH, Running, number_rows, running, segment_of

# The three actions and the log's subject prefix.
ACTIONS = ("create", "update", "delete")
LOG_PREFIX = "humus"


def entry_problem() -> Column:
    """First rule a change entry breaks, NULL for a valid one."""
    action = F.col("action")
    return (
        F.when(blank(F.col("actor")), "empty actor")
        .when(blank(F.col("entity")), "empty entity")
        .when(blank(action), "empty action")
        .when(~action.isin(*ACTIONS), "unknown action")
        .when((action != "delete") & blank(F.col("data")), "empty data")
    )


def route() -> Column:
    """Subject of an entry: ``<prefix>.<actor>.<action>``."""
    return F.concat_ws(".", F.lit(LOG_PREFIX), "actor", "action")


def check_entries(entries: DataFrame) -> DataFrame:
    """Add ``reject_reason`` to ``actor, entity, action, data`` rows."""
    return entries.withColumn("reject_reason", entry_problem())


def append(
    entries: DataFrame, position: str, last_slot: int = 0, width: int = SEGMENT_WIDTH
) -> DataFrame:
    """Valid entries with the next slots, in the order of ``position``.

    A delete without data stores JSON ``null``. Slots are dense and need no global sort.
    """
    valid = check_entries(entries).where(F.col("reject_reason").isNull()).drop("reject_reason")
    stored = valid.withColumns(
        {
            "data": F.when(blank(F.col("data")), F.lit("null")).otherwise(F.col("data")),
            "subject": route(),
        }
    )
    return number_rows(stored, position, "slot", last_slot, width)


def write_log(log: DataFrame, path: str, width: int = SEGMENT_WIDTH) -> None:
    """Append to a log table laid out by segment, so slot ranges prune whole folders."""
    log.withColumn("segment", segment_of("slot", width)).write.mode("append").partitionBy("segment").parquet(path)


def read_log(log: DataFrame, after: int = 0) -> DataFrame:
    """Entries after a consumer's position, in slot order (a distributed range sort)."""
    return log.where(F.col("slot") > after).orderBy("slot")


def retain(log: DataFrame, max_age_s: int, max_rows: int, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Drop-oldest retention by age (relative to the newest entry) and by row count.

    Rows are counted per segment from the newest down; segment totals are all that meets in one
    place. Only the segment that holds the oldest row to keep is ranked, and its slot then filters
    the scan, so the log itself is not shuffled.
    """
    newest = log.agg(F.max("ts").alias("ts")).scalar()
    young = log.where(F.col("ts") >= newest - F.make_interval(secs=F.lit(max_age_s)))
    newest_first = W.orderBy(F.col(SEG).desc())
    totals = young.groupBy(segment_of("slot", width).alias(SEG)).agg(F.count("*").alias("_n"))
    border = (
        totals.withColumn("_until", F.sum("_n").over(newest_first))
        .where((F.col("_until") >= max_rows) & (F.col("_until") - F.col("_n") < max_rows))
        .select(SEG, (F.lit(max_rows) - F.col("_until") + F.col("_n")).alias("_take"))
    )
    ranked = (
        young.select("slot", segment_of("slot", width).alias(SEG))
        .join(F.broadcast(border), SEG)  # one row at most
        .withColumn("_rank", F.row_number().over(W.partitionBy(SEG).orderBy(F.col("slot").desc())))
    )
    oldest = ranked.where(F.col("_rank") == F.col("_take")).agg(F.max("slot").alias("slot")).scalar()
    every = F.lit(-(1 << 63))
    return young.where(F.col("slot") >= F.coalesce(oldest, every)) if max_rows > 0 else young.limit(0)


def out_of_order(log: DataFrame, arrival: str, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Entries whose slot does not exceed that of the entry that arrived just before."""
    previous = Running("prev_slot", F.col("slot"), "last", strict=True)
    return running(log, [], arrival, [previous], width=width).where(F.col("slot") <= F.col("prev_slot"))
