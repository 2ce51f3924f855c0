"""Compare-and-set over whole chains of attempts.

An attempt that expects revision e is a function of the entity's revision: e becomes e + 1, any other
revision stays. The attempts of one segment of arrivals are therefore one function too, and it differs
from "stays" only at the revisions that the segment expects. Functions of neighbouring segments are
composed pairwise, by equality joins, up a tree; down the tree each segment then learns the revision
it starts from, one lookup per level. Only inside a segment are attempts followed one by one. So an entity
with a third of all attempts is spread over its segments, and the rounds grow with the logarithm of their
number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cases import first_case
from ..session import written
from .ordered import segment_of

#: Arrivals per segment.
WIDTH = 1 << 18

_ENTITY = ["entity", "node"]


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each expected revision of a segment ends up; attempts come last first."""
    at, ends = None, {}
    for batch in batches:
        for entity, node, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (entity, node) != at:
                if ends:
                    yield _rows(at, ends)
                at, ends = (entity, node), {}
            ends[expected] = ends.get(expected + 1, expected + 1)
    if ends:
        yield _rows(at, ends)


def _rows(at: tuple, ends: dict[int, int]) -> pa.RecordBatch:
    n = len(ends)
    columns = [pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array(list(ends), pa.int64()), pa.array(list(ends.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["entity", "node", "enter", "leave"])


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The revision each attempt meets; attempts come in order, with the revision their segment starts from."""
    at, revision = None, 0
    for batch in batches:
        entities, nodes, arrivals, expected, start = (c.to_pylist() for c in batch.columns)
        met = []
        for entity, node, e, r in zip(entities, nodes, expected, start, strict=True):
            if (entity, node) != at:
                at, revision = (entity, node), r
            met.append(revision)
            revision += e == revision
        columns = [pa.array(arrivals, pa.int64()), pa.array(met, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["arrival", "met_revision"])


def _above(links: DataFrame) -> DataFrame:
    """Functions of pairs of neighbours: the left one, then the right one."""
    up = F.shiftright("node", 1)
    left = links.where(F.col("node") % 2 == 0).select("entity", up.alias("node"), "enter", "leave")
    right = links.where(F.col("node") % 2 == 1).select("entity", up.alias("node"), "enter", "leave")
    then = right.select(*_ENTITY, F.col("enter").alias("leave"), F.col("leave").alias("_leave"))
    through = left.join(then, [*_ENTITY, "leave"], "left").select(*_ENTITY, "enter", F.coalesce("_leave", "leave").alias("leave"))
    return through.unionByName(right.join(left, [*_ENTITY, "enter"], "left_anti"))


def _below(starts: DataFrame, links: DataFrame) -> DataFrame:
    """The revision each child starts from: the left one from its parent's, the right one from what the
    left one makes of it. Only nodes that have attempts are kept."""
    there = links.select(*_ENTITY).distinct()
    left = links.where(F.col("node") % 2 == 0).select("entity", F.shiftright("node", 1).alias("node"), F.col("enter").alias("start"), "leave")
    both = starts.join(left, [*_ENTITY, "start"], "left")
    child = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), "start"), F.struct((F.col("node") * 2 + 1).alias("node"), F.coalesce("leave", "start").alias("start"))))
    return both.select("entity", child.alias("c")).select("entity", "c.*").join(there, _ENTITY, "left_semi")


def resolve(attempts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Outcomes of conditional writes in the order of ``arrival`` (unique, not negative).

    ``expected_revision`` 0 means create; ``current_revision`` is the entity's revision before all of its
    attempts (0 when absent), the same in all its rows. A write that meets the revision it expects takes
    the entity to the next one. Adds ``met_revision`` and ``outcome``.
    """
    rows = attempts.withColumn("node", segment_of("arrival", width).cast("bigint"))
    narrow = rows.select(*_ENTITY, "arrival", "expected_revision")
    ordered = narrow.repartition(*_ENTITY).sortWithinPartitions(*_ENTITY, F.desc("arrival"))
    links = written(ordered.select(*_ENTITY, F.col("expected_revision").cast("bigint")).mapInArrow(_functions, "entity string, node bigint, enter bigint, leave bigint"), "cas-links")
    levels = [links]
    for _ in range((links.agg(F.coalesce(F.max("node"), F.lit(0))).head()[0]).bit_length()):
        levels.append(written(_above(levels[-1]), "cas-links"))
    firsts = attempts.groupBy("entity").agg(F.min("current_revision").cast("bigint").alias("start"))
    starts = firsts.select("entity", F.lit(0).cast("bigint").alias("node"), "start")
    for below in reversed(levels[:-1]):
        starts = written(_below(starts, below), "cas-starts")
    dealt = narrow.join(starts, _ENTITY).repartition(*_ENTITY).sortWithinPartitions(*_ENTITY, "arrival")
    met = dealt.select(*_ENTITY, "arrival", F.col("expected_revision").cast("bigint"), "start").mapInArrow(_followed, "arrival bigint, met_revision bigint")
    create, won = F.col("expected_revision") == 0, F.col("expected_revision") == F.col("met_revision")
    outcome = first_case([(won & create, "created"), (won, "updated"), (create, "conflict_exists")], "conflict_revision")
    return attempts.join(met, "arrival").withColumn("outcome", outcome)
