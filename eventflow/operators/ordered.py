"""Ordered work per key that survives hot keys.

A plain ``Window.partitionBy(key).orderBy(slot)`` puts all rows of one key into one task. Here
the log is cut into segments of its order column, rows are windowed per (key, segment), and only
one summary row per (key, segment) is windowed per key to get what earlier segments carry in. A
key that owns a third of the log is thereby spread over as many tasks as there are segments, and
a segment can never hold more than ``width`` rows of unique integer positions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pin import pin

# Positions per segment: 2^22 rows sort in one task with little or no spill.
SEGMENT_WIDTH = 1 << 22
# Without keys all rows of a segment are in one task, so its segments are narrower.
KEYLESS_WIDTH = 1 << 20

SEG = "_segment"


def segment_of(position: str | Column, width: int = SEGMENT_WIDTH) -> Column:
    """Segment number of an integer position."""
    col = F.col(position) if isinstance(position, str) else position
    return F.call_function("div", col, F.lit(width))


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` of ``value`` over a key's rows up to the current one.

    ``how`` is last, first (both skip NULL), sum, max or min; or next, the first non-NULL value
    after the current row. ``strict`` leaves the current row out.
    """

    name: str
    value: Column
    how: str
    strict: bool = False


def _summary(spec: Running, order: Column) -> Column:
    known = F.when(spec.value.isNotNull(), order)
    return {
        "last": lambda: F.max_by(spec.value, known),
        "first": lambda: F.min_by(spec.value, known),
        "next": lambda: F.min_by(spec.value, known),
        "sum": lambda: F.sum(spec.value),
        "max": lambda: F.max(spec.value),
        "min": lambda: F.min(spec.value),
    }[spec.how]()


def _over(value: Column, how: str, window) -> Column:
    return {
        "last": lambda: F.last(value, ignorenulls=True),
        "next": lambda: F.last(value, ignorenulls=True),
        "first": lambda: F.first(value, ignorenulls=True),
        "sum": lambda: F.sum(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
    }[how]().over(window)


def _combine(how: str, carried: Column, inside: Column) -> Column:
    if how in ("last", "next"):
        return F.coalesce(inside, carried)
    if how == "first":
        return F.coalesce(carried, inside)
    if how == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(inside, F.lit(0))
    return F.greatest(carried, inside) if how == "max" else F.least(carried, inside)


def running(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    specs: list[Running],
    segment: Column | None = None,
    width: int = SEGMENT_WIDTH,
) -> DataFrame:
    """Add running values per key.

    ``order`` is unique within a key. With a single integer column, segments are ranges of
    ``width`` positions (``KEYLESS_WIDTH`` at most if there are no keys); otherwise pass ``segment``,
    any expression that never decreases along the order.

    The rows are computed and shuffled once, by (key, segment). Both the windowed rows and the
    summary read that one shuffle, and the summary returns to the rows through a join on (key,
    segment), which the rows are partitioned by already. So sweeps can be stacked without the
    input being computed again for each.
    """
    order = [order] if isinstance(order, str) else order
    if segment is None:
        segment = segment_of(order[0], width if keys else min(width, KEYLESS_WIDTH))
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    dealt = df.withColumn(SEG, segment).repartition(*keys, SEG)
    # Pinned columns are not pruned, so both readers ask for the same shuffle and Spark reuses it.
    tagged = pin(dealt, {c: F.col(c) for c in df.columns if c not in keys})

    def inside(spec: Running) -> Column:
        # "next" looks back along the reversed order: frames that look ahead cost n^2.
        along = [F.col(c).desc() for c in order] if spec.how == "next" else order
        until = -1 if spec.strict or spec.how == "next" else W.currentRow
        rows = W.partitionBy(*keys, SEG).orderBy(*along).rowsBetween(W.unboundedPreceding, until)
        return _over(spec.value, spec.how, rows).alias(f"_in_{spec.name}")

    def carry(spec: Running) -> Column:
        along = F.col(SEG).desc() if spec.how == "next" else F.col(SEG)
        others = W.partitionBy(*keys).orderBy(along).rowsBetween(W.unboundedPreceding, -1)
        return _over(F.col(f"_sum_{spec.name}"), spec.how, others).alias(f"_out_{spec.name}")

    inner = tagged.select("*", *[inside(s) for s in specs])
    carried = (
        tagged.groupBy(*keys, SEG)
        .agg(*[_summary(s, position).alias(f"_sum_{s.name}") for s in specs])
        .select(*keys, SEG, *[carry(s) for s in specs])
    )
    if keys:
        carried = _without_null_keys(carried, keys)
    joined = inner.join(carried, [*keys, SEG], "left")
    return joined.select(
        *df.columns,
        *[_combine(s.how, F.col(f"_out_{s.name}"), F.col(f"_in_{s.name}")).alias(s.name) for s in specs],
    )


def _without_null_keys(carried: DataFrame, keys: list[str]) -> DataFrame:
    """Make NULL keys match nothing, without a filter on the keys.

    A join would add that filter and Spark would push it below the shuffle on this side only,
    so the shuffle could not be shared.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    plain = (T.StringType, T.NumericType)
    filled = [
        F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, plain)
        else F.col(f.name)
        for f in carried.schema.fields
        if f.name in keys
    ]
    rest = [c for c in carried.columns if c not in keys and c != SEG]
    return carried.select(*filled, F.when(known, F.col(SEG)).alias(SEG), *rest)


def number_rows(
    df: DataFrame, order: str, name: str, start: int = 0, width: int = SEGMENT_WIDTH
) -> DataFrame:
    """Number all rows 1, 2, 3.. after ``start`` along an integer position.

    Never one global sort: rows are counted per segment, and only the segment totals (one row
    per ``width`` positions, or fewer) meet in one place.
    """
    numbered = running(df, [], order, [Running(name, F.lit(1).cast("bigint"), "sum")], width=width)
    return numbered.withColumn(name, F.col(name) + F.lit(start)) if start else numbered


def newest_per_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The ``n`` newest rows of every key.

    Spark turns the rank filter into a per-task limit before the shuffle, so a hot key sends at
    most ``n`` rows per map task.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
