"""Snapshots of the state at regular segments of the log, so that reads far back replay only a tail.

The log is a table with one folder per segment (``changelog.write_log``). A snapshot holds the compacted
state before a segment; each is made from the one before it and the segments between. A read at a slot
opens one snapshot and the segments from there up to the slot's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..operators.ordered import SEGMENT_WIDTH
from . import parts
from .jobs import COMPACTED

#: Segments between two snapshots.
EVERY = 16


def _before(spark: SparkSession, folder: str, segment: int) -> DataFrame:
    """Compacted state before a segment that has a snapshot; before the first segment it is empty."""
    if not segment:
        return spark.createDataFrame([], COMPACTED.schema)
    return spark.read.schema(COMPACTED.schema).parquet(f"{folder}/before/{segment}")


def take(log: DataFrame, folder: str, every: int = EVERY, width: int = SEGMENT_WIDTH) -> None:
    """Add the snapshots that the log's complete segments allow; those taken earlier stay."""
    spark = log.sparkSession
    newest = log.agg(F.max("segment")).head()[0]
    known = parts.latest(spark, folder)
    every = known.notes.get("every", every)
    for segment in range(known.notes.get("segment", 0) + every, (newest or 0) + 1, every):
        between = log.where((F.col("segment") >= segment - every) & (F.col("segment") < segment))
        both = _before(spark, folder, segment - every).unionByName(state.compact(between, width))
        state.combine(both).write.mode("overwrite").parquet(f"{folder}/before/{segment}")
        known = parts.commit(spark, folder, known, segment, {}, {}, {"segment": segment, "every": every})


def _start(spark: SparkSession, folder: str, segment: int) -> int:
    """The last segment up to this one that has a snapshot."""
    notes = parts.latest(spark, folder).notes
    return min(segment // notes["every"] * notes["every"], notes["segment"]) if notes else 0


def _tail(log: DataFrame, start: int, end: int, slot: int) -> DataFrame:
    return log.where((F.col("segment") >= start) & (F.col("segment") <= end) & (F.col("slot") <= slot))


def state_at(log: DataFrame, folder: str, slot: int, width: int = SEGMENT_WIDTH) -> DataFrame:
    """State ``entity, data, slot`` as of a log position."""
    spark, segment = log.sparkSession, slot // width
    start = _start(spark, folder, segment)
    tail = state.compact(_tail(log, start, segment, slot), width)
    return state.merge(_before(spark, folder, start).unionByName(tail))


def as_of(reads: DataFrame, log: DataFrame, folder: str, width: int = SEGMENT_WIDTH) -> DataFrame:
    """``state.as_of`` over the segments between the first and the last read, on top of the snapshot
    before them; what is live in the snapshot stands in as one update each."""
    spark = log.sparkSession
    low, high = reads.agg(F.min("slot"), F.max("slot")).head()
    if low is None:
        low = high = 0
    start = _start(spark, folder, low // width)
    stand_ins = state.merge(_before(spark, folder, start)).withColumn("action", F.lit("update"))
    entries = _tail(log, start, high // width, high).select("entity", "data", "slot", "action")
    return state.as_of(reads, stand_ins.unionByName(entries), width)
