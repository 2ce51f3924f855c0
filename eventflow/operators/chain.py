"""Chains of steps wired by subject: each step reads a pattern and publishes under a subject."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents as doc
from ..functions.subjects import resolve_subject, subject_match
from ..session import written


@dataclass(frozen=True)
class Step:
    """``fn`` maps events to events: it reads JSON ``data`` and sets the new ``data``."""

    name: str
    subscribes: str
    publishes: str
    fn: Callable[[DataFrame], DataFrame]


def run_steps(events: DataFrame, steps: list[Step]) -> DataFrame:
    """All events: the given ones and everything the steps publish.

    A step sees the given events and what earlier steps published. Each hop is a table in the shared
    folder, which later hops read, so no step runs twice and the source is scanned once. A table of one
    fixed subject gets it back as a literal, so that a hop opens only tables that its pattern can match.
    On a stream, which cannot be kept as a table, it is one lazy plan.
    """
    columns, keep = events.columns, written if not events.isStreaming else lambda flow, _label: flow
    flows = [keep(events, "chain-source")]
    for step in steps:
        inputs = [flow.where(subject_match(F.col("subject"), step.subscribes)) for flow in flows]
        out = step.fn(reduce(DataFrame.unionByName, inputs)).withColumn("source", F.lit(step.name))
        if "{" in step.publishes:
            subject = resolve_subject(step.publishes, doc.decode(F.col("data")))
            flows.append(keep(out.withColumn("subject", subject).select(*columns), f"chain-{len(flows)}"))
        else:
            hop = keep(out.select(*[c for c in columns if c != "subject"]), f"chain-{len(flows)}")
            flows.append(hop.withColumn("subject", F.lit(step.publishes)).select(*columns))
    return reduce(DataFrame.unionByName, flows)
