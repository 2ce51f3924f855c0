"""Deterministic transforms: lead scoring, and user functions over payloads."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cases import constant_map, first_case

# Scoring steps as (exclusive lower bound, points, signal), largest first.
SIZE_STEPS = ((500, 50, "enterprise"), (100, 30, "mid_market"), (20, 10, "smb"))
# Title words with points and signal, first hit wins.
TITLE_STEPS = ((("CEO", "CTO", "VP"), 40, "executive"), (("Director", "Manager"), 20, "manager"))
# Industries with a bonus.
TARGET_INDUSTRIES, INDUSTRY_POINTS, INDUSTRY_SIGNAL = ("technology", "finance"), 15, "target_industry"
# Tiers as (inclusive lower bound, tier, priority).
TIERS = ((80, "enterprise", "high"), (50, "mid-market", "medium"))
LOWEST_TIER = ("startup", "low")
# Qualification policy as (inclusive lower bound, priority).
QUALIFY_STEPS = ((100, "high"), (70, "medium"), (40, "low"))
QUALIFY_ACTIONS = {
    "high": "schedule demo immediately",
    "medium": "schedule discovery call",
    "low": "add to nurture",
    "none": "no action",
}
PURSUE_FROM = 70


def _size_step(size: Column, pick: int) -> Column:
    return first_case((size > bound, F.lit(step[pick])) for bound, *step in SIZE_STEPS)


def _title_step(title: Column, pick: int) -> Column:
    return first_case(
        (reduce(or_, [title.contains(w) for w in words]), F.lit(step[pick])) for words, *step in TITLE_STEPS
    )


def score_contacts(contacts: DataFrame, keep_all: bool = False) -> DataFrame:
    """Add ``score`` and ordered ``signals``; contacts without size or title are dropped, or with
    ``keep_all`` stay without a score."""
    size, title = F.col("company_size"), F.col("title")
    known = size.isNotNull() & title.isNotNull()
    target = F.coalesce(F.col("industry").isin(*TARGET_INDUSTRIES), F.lit(False))
    points = [_size_step(size, 0), _title_step(title, 0), F.when(target, F.lit(INDUSTRY_POINTS))]
    signals = [_size_step(size, 1), _title_step(title, 1), F.when(target, F.lit(INDUSTRY_SIGNAL))]
    total = reduce(add, [F.coalesce(p, F.lit(0)) for p in points])
    return (contacts if keep_all else contacts.where(known)).withColumns(
        {"score": F.when(known, total.cast("bigint")), "signals": F.when(known, F.array_compact(F.array(*signals)))}
    )


def tier_leads(leads: DataFrame) -> DataFrame:
    """Add ``tier`` and ``priority``; a missing score counts as 0."""
    score = F.coalesce("score", F.lit(0))
    return leads.withColumns(
        {
            "tier": first_case([(score >= b, t) for b, t, _ in TIERS], LOWEST_TIER[0]),
            "priority": first_case([(score >= b, p) for b, _, p in TIERS], LOWEST_TIER[1]),
        }
    )


def qualify_leads(leads: DataFrame) -> DataFrame:
    """Rule policy on the score: ``pursue``, ``priority`` and ``action``."""
    score = F.coalesce("score", F.lit(0))
    priority = first_case([(score >= b, name) for b, name in QUALIFY_STEPS], "none")
    return leads.withColumn("priority", priority).withColumns(
        {"pursue": score >= PURSUE_FROM, "action": constant_map(QUALIFY_ACTIONS)[F.col("priority")]}
    )


def map_payloads(
    df: DataFrame,
    make: Callable[[], Callable[[dict], dict | None]],
    payload: str = "data",
) -> DataFrame:
    """Run a user function over JSON payloads, object in, object out, in Arrow batches.

    ``make`` is called once per task and returns the function. ``data`` becomes the function's
    output. Every input row is kept and its ``outcome`` says what happened: ``ok``, ``filtered``
    (the function returned None), or an error text for bad input, a raised error or a result
    that is not an object.
    """
    keep = [f for f in df.schema.fields if f.name != payload]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(payload, T.StringType()), T.StructField("outcome", T.StringType())])

    def apply(fn: Callable[[dict], dict | None], text: str | None) -> tuple[str | None, str]:
        try:
            document = json.loads(text) if text is not None else None
        except ValueError:
            return None, "not json"
        if not isinstance(document, dict):
            return None, "not an object"
        try:
            result = fn(document)
        except Exception as error:  # a user function may fail in any way; the row says so
            return None, f"error: {type(error).__name__}"
        if result is None:
            return None, "filtered"
        if not isinstance(result, dict):
            return None, "not an object"
        return json.dumps(result), "ok"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            done = [apply(fn, text) for text in batch.column(payload).to_pylist()]
            columns = [batch.column(n) for n in names]
            columns.append(pa.array([d for d, _ in done], pa.string()))
            columns.append(pa.array([o for _, o in done], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*names, payload, "outcome"])

    return df.mapInArrow(run, schema)
