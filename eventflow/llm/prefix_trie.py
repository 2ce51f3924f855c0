"""Trie of conversation prefixes with subtree totals, rolled up by bands of depth.

A node is a distinct sequence of first turns. Its key is a sum of hashes of (position, turn), so that
keys are running sums along a conversation; sums run by segments of turns (``operators.ordered``), and a
conversation that owns most rows is spread over many tasks. Texts are hashed before the first shuffle.

Totals over subtrees come from a roll-up by depth bands. In bands of ``HEIGHT`` levels every node sends
its values to its ancestors inside its band only, at most ``HEIGHT`` of them. The roots of the bands then
form a trie of their own, ``HEIGHT`` times lower, which is rolled up in the same way; the completed totals
of band roots at last go to the ancestors in the band above. So a node is sent to at most ``HEIGHT``
others per round, and the rounds grow with the logarithm of the greatest depth to the base ``HEIGHT``.
A node finds its ancestors through any one of its members, by an equality join on (member, band).

The hash over the ids of a node's last members needs them in order. Ids are put together by ranges of
``RANGE`` ids first; these texts pass one after another, sorted, through the hash, whose state is all
that a task holds, also for a node at which a third of all conversations ends.

Defined results: turns are ordered with null first, equal turns of one conversation by a hash of role
and text; null role or text counts as empty; rows without a conv_id belong to no conversation and are
left out; repeated rows are turns of their own; very long texts are hashed whole; an empty table has no
node, not even a root; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Running, running
from .common import saved

HEIGHT = 16
RANGE = 1 << 10
#: Turn numbers per segment of a conversation.
TURNS = 1 << 12
LANES = ("l1", "l2", "l3", "l4")
KEY = ["k1", "k2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, four 32-bit numbers of the turn's hash, code points of its text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("points")
    )
    rows = rows.withColumns({"known": F.col("turn").isNotNull(), "turn": F.coalesce("turn", F.lit(0).cast("long"))})
    # Turns without a number stand first, in the order of their hash, and are cut by its first digits.
    segment = F.struct("known", F.floor(F.col("turn") / TURNS), F.when(F.col("known"), F.lit("")).otherwise(F.substring("digest", 1, 3)))
    counted = running(rows, ["conv_id"], ["known", "turn", "digest"], [Running("pos", F.lit(1).cast("long"), "sum")], segment=segment)
    parts = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(lane) for i, lane in enumerate(LANES)]
    return counted.select("conv_id", "pos", *parts, "points")


def with_shared_heads(turns: DataFrame, head: Column, block: int) -> DataFrame:
    """Conversations whose first ``head`` turns (an expression over conv_id, never negative) are those of
    conversation conv_id - conv_id % block, all if fewer, none if absent; then their own later turns.

    Returns depth in place of pos, and one row of depth 0 for every conversation.
    """
    turns = turns.withColumn("head", head.cast("long"))
    convs = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), "head")
    most = convs.agg(F.coalesce(F.max("head"), F.lit(0))).head()[0]
    values = [*LANES, "points"]
    # Joined by (base, position), so that a base shared by many conversations is spread over positions.
    wanted = convs.select("conv_id", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("head"))).alias("pos"))
    heads = turns.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", *values)
    shared = wanted.join(heads, ["base", "pos"], "left").where("pos = 0 or l1 is not null")
    shared = shared.select("conv_id", F.lit(False).alias("own"), "pos", F.lit(0).cast("long").alias("skipped"), F.col("pos").alias("taken"), *values)
    own = turns.where("pos > head").select("conv_id", F.lit(True).alias("own"), "pos", F.col("head").alias("skipped"), F.lit(None).cast("long").alias("taken"), *values)
    segment = F.struct("own", F.floor(F.col("pos") / TURNS))
    both = running(shared.unionByName(own), ["conv_id"], ["own", "pos"], [Running("before", F.col("taken"), "max")], segment=segment)
    depth = F.when(F.col("own"), F.col("pos") - F.col("skipped") + F.col("before")).otherwise(F.col("pos"))
    return both.select("conv_id", depth.alias("depth"), *values)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key of the prefix, key of the prefix before it, points, last): one row for every
    prefix of every conversation. ``turns`` has conv_id, depth (0 for a row without a turn) and LANES."""
    lane = [F.when(F.col("depth") > 0, F.pmod(F.xxhash64(F.lit(i), "depth", *LANES), F.lit(1 << 32))).otherwise(0) for i in range(len(LANES))]
    own = turns.select("conv_id", "depth", *[v.alias(n) for n, v in zip(LANES, lane, strict=True)], F.coalesce("points", F.lit(0).cast("long")).alias("points"))
    segment = F.floor(F.col("depth") / TURNS)
    sums = running(own, ["conv_id"], "depth", [*[Running(f"s{n}", F.col(n), "sum") for n in LANES], Running("later", F.col("depth"), "next")], segment=segment)
    now = [F.col(f"s{n}") for n in LANES]
    before = [F.col(f"s{n}") - F.col(n) for n in LANES]
    return sums.select(
        "conv_id",
        "depth",
        *[F.xxhash64(F.lit(k), "depth", *now).alias(k) for k in KEY],
        *[F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), F.col("depth") - 1, *before)).alias(f"parent_{k}") for k in KEY],
        "points",
        F.col("later").isNull().alias("last"),
    )


def roll_up(values: DataFrame, paths: DataFrame, measures: list[str], deepest: int, height: int = HEIGHT) -> DataFrame:
    """Sums of the measures over each node's subtree, itself included.

    ``values`` has KEY, conv_id (any member), depth and the measures; ``paths`` has conv_id, depth and
    KEY of every prefix of these members. Returns KEY and the measures' sums.
    """

    def send(nodes: DataFrame, step: int, band: int, above: bool) -> DataFrame:
        """The nodes' measures at their ancestors at every ``step`` levels of their own band, or of the
        band above it."""
        place = F.floor(F.col("depth") / band)
        up = paths.where(F.col("depth") % step == 0).select("conv_id", F.col("depth").alias("at"), *KEY, place.alias("band"))
        of = nodes.select("conv_id", "depth", *measures, (place - 1 if above else place).alias("band"))
        return of.join(up, ["conv_id", "band"]).where("at <= depth").select(*KEY, F.col("at").alias("depth"), "conv_id", *measures)

    def summed(sent: DataFrame, label: str) -> DataFrame:
        sums = [F.sum(m).alias(m) for m in measures]
        return saved(sent.groupBy(*KEY, "depth").agg(F.min("conv_id").alias("conv_id"), *sums), f"trie-{label}")

    columns = [*KEY, "depth", "conv_id", *measures]
    levels, nodes, step = [], values, 1
    while True:
        band = step * height
        inside = summed(send(nodes, step, band, above=False), "inside")
        levels.append((step, band, inside))
        if deepest < band:
            break
        nodes, step = inside.where(F.col("depth") % band == 0), band
    total = levels.pop()[2]
    for step, band, inside in reversed(levels):
        down = send(total.where("depth > 0"), step, band, above=True)
        total = summed(inside.select(*columns).unionByName(down.select(*columns)), "total")
    return total.select(*KEY, *measures)


def ends(paths: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids, in ascending order, of the conversations that end at a node."""
    ranges = paths.where("last").groupBy(*KEY, F.shiftright("conv_id", RANGE.bit_length() - 1).alias("range"))
    texts = ranges.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if at != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield _batch(done)
        if key is not None:
            yield _batch([(*key, state.hexdigest())])

    ordered = texts.repartition(*KEY).sortWithinPartitions(*KEY, "range").select(*KEY, "range", "ids")
    return ordered.mapInArrow(task, "k1 long, k2 long, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*KEY, "ends_sha256"])


def trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """All nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. ``turns`` as for ``prefixes``."""
    paths = saved(prefixes(turns), "trie-paths")
    parents = [f"parent_{k}" for k in KEY]
    nodes = saved(
        paths.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("points").alias("points"), *[F.max(p).alias(p) for p in parents]
        ),
        "trie-nodes",
    )
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).head()[0]
    children = nodes.where("depth > 0").groupBy(*[F.col(p).alias(k) for p, k in zip(parents, KEY, strict=True)]).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "trie-children")
    saving = (F.col("n_convs") - 1) * F.col("points")
    values = nodes.select(*KEY, "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saving.alias("saved_tokens"))
    totals = roll_up(values, paths, ["n_leaves", "saved_tokens"], deepest, height)
    above = nodes.select(*[F.col(k).alias(p) for k, p in zip(KEY, parents, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    rows = nodes.join(totals, KEY).join(above, parents, "left").join(ends(paths), KEY, "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, head: Column | None = None, block: int = 1, height: int = HEIGHT) -> DataFrame:
    """The trie of a table (conv_id, turn, role, text), its conversations rebuilt with shared heads or,
    without ``head``, as they are."""
    turns = saved(numbered(conversations), "trie-turns")
    return trie(with_shared_heads(turns, F.lit(0) if head is None else head, block), height)
