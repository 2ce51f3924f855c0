"""Inventory of nodes and processes: classification, attachment, usage, change folding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cases import first_case
from ..functions.subjects import inventory_match
from .ordered import SEGMENT_WIDTH, Running, newest_per_key, running

# Node classes by capability, and process kinds.
NODE_BASE, NODE_DOCKER, NODE_GPU = "land", "nimland", "manaland"
PROCESS_KINDS = ("tree", "treehouse", "nim")
# Subject patterns of each kind, tried in this order.
KIND_PATTERNS = {
    "tree": ("river.>", "river.*", "river.stripe.>", "river.general.>"),
    "treehouse": ("contact.>", "contact.created", "lead.scored"),
    "nim": (
        "payment.>",
        "payment.completed",
        "payment.failed",
        "lead.qualified",
        "followup.>",
        "data.>",
        "status.>",
        "notification.>",
    ),
}
# Subject beginnings of each kind, used when no pattern fits.
KIND_PREFIXES = {"tree": ("river.",), "treehouse": ("contact.", "lead.scored")}
KIND_WORD = ("treehouse", "treehouse")
# Fixed value: memory assumed for a detected process.
PROCESS_RAM = 256 * 1024 * 1024
# Rows a subscription listing returns, changes an event history keeps.
LISTING_ROWS = 1000
HISTORY_ROWS = 100


# --- classification -----------------------------------------------------------------------


def node_class(gpu_vram: Column, has_docker: Column) -> Column:
    return F.when(can_run_gpu(gpu_vram, has_docker), NODE_GPU).when(has_docker, NODE_DOCKER).otherwise(NODE_BASE)


def can_run_agents(has_docker: Column) -> Column:
    return has_docker


def can_run_gpu(gpu_vram: Column, has_docker: Column) -> Column:
    return (gpu_vram > 0) & has_docker


def kind_by_prefix(subject: Column) -> Column:
    """Process kind from the subject's beginning alone; the default is the last kind."""
    text = F.lower(subject)
    starts = {k: reduce(or_, [text.startswith(p) for p in ps]) for k, ps in KIND_PREFIXES.items()}
    word, kind = KIND_WORD
    starts[kind] = starts[kind] | text.contains(word)
    return first_case([(hit, k) for k, hit in starts.items()], PROCESS_KINDS[-1])


def process_kind(subject: Column) -> Column:
    """Process kind from the pattern lists, then from the beginning."""
    text = F.lower(subject)
    hits = [(reduce(or_, [inventory_match(text, p) for p in ps]), k) for k, ps in KIND_PATTERNS.items()]
    return first_case(hits, kind_by_prefix(subject))


def process_name(subject: Column) -> Column:
    """Display name: raw prefix and wildcard ending cut, dots to dashes, ``unknown`` if empty."""
    bare = F.regexp_replace(subject, r"^river\.", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\.>$", ""), r"\.\*$", "")
    return F.coalesce(F.nullif(F.replace(bare, F.lit("."), F.lit("-")), F.lit("")), F.lit("unknown"))


def visible(subject: Column) -> Column:
    """Not empty and not one of the broker's own subjects."""
    return (F.length(subject) > 0) & ~subject.rlike(r"^[_$]")


# --- detection and attachment -------------------------------------------------------------


def detect_processes(subscriptions: DataFrame) -> DataFrame:
    """One process per (subject, queue); ``n_subjects`` counts the merged subscriptions.

    All merged subjects are the same text, so a count stands for the list and no group is ever
    collected.
    """
    groups = (
        subscriptions.where(visible(F.col("subject")))
        .groupBy("subject", F.coalesce("queue", F.lit("")).alias("queue"))
        .agg(F.count("*").alias("n_subjects"))
    )
    return _as_process(groups, F.col("subject"), process_name(F.col("subject")))


def detect_consumers(consumers: DataFrame) -> DataFrame:
    """One process per (stream, consumer); of several rows the one with the smallest filter counts."""
    rows = consumers.where(F.length("filter_subject") > 0)
    keyed = rows.groupBy("stream_name", F.coalesce("name", F.lit("")).alias("name")).agg(F.min("filter_subject").alias("filter_subject"))
    named = F.coalesce(F.nullif("name", F.lit("")), process_name(F.col("filter_subject")))
    return _as_process(keyed.withColumn("n_subjects", F.lit(1).cast("bigint")), F.col("filter_subject"), named)


def detect_connections(connections: DataFrame, service: str) -> DataFrame:
    """One process per (connection, subject) of the service's own connections, which carry its name."""
    inner = connections.where(F.col("name").contains(service) & visible(F.col("subject")))
    groups = inner.groupBy(F.col("name").alias("connection"), "subject").agg(F.lit(1).cast("bigint").alias("n_subjects"))
    return _as_process(groups, F.col("subject"), process_name(F.col("subject")))


def _as_process(rows: DataFrame, subject: Column, name: Column) -> DataFrame:
    return (
        rows.withColumn("name", name)
        .withColumn("kind", process_kind(subject))
        .withColumn("process_id", F.concat_ws("-", "kind", "name"))
        .withColumn("ram_allocated", F.lit(PROCESS_RAM).cast("bigint"))
    )


def first_node(nodes: DataFrame) -> Column:
    """Smallest node id as a scalar subquery."""
    return nodes.agg(F.min("node_id")).scalar()


def attach(processes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Give every process an existing node: its own, else the first; without nodes none remain."""
    known = nodes.select(F.col("node_id").alias("_node"))
    joined = processes.join(known, F.col("node_id") == F.col("_node"), "left")
    return (
        joined.withColumn("node_id", F.coalesce("_node", first_node(nodes)))
        .drop("_node")
        .where(F.col("node_id").isNotNull())
    )


def union_nodes(local: DataFrame, peers: DataFrame) -> DataFrame:
    """Nodes of both sides, the newest ``seen`` per id wins (a combinable aggregate). Among equally
    new ones the local side wins, then the larger row."""
    both = local.withColumn("_local", F.lit(True)).unionByName(peers.withColumn("_local", F.lit(False)))
    columns = [c for c in both.columns if c not in ("node_id", "_local")]
    row = F.struct(*columns)
    return both.groupBy("node_id").agg(F.max_by(row, F.struct("seen", "_local", row)).alias("n")).select("node_id", "n.*")


def union_processes(*kinds: DataFrame) -> DataFrame:
    """All processes of several kinds; columns a kind lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)


# --- roll-ups -----------------------------------------------------------------------------


def node_usage(nodes: DataFrame, processes: DataFrame) -> DataFrame:
    """Per node: memory allocated and available, occupancy in percent, number of processes.

    Processes are summed per node before the join, so a crowded node costs one row.
    """
    used = processes.groupBy("node_id").agg(
        F.sum("ram_allocated").alias("_ram"), F.count("*").alias("_count")
    )
    allocated = F.coalesce("_ram", F.lit(0)).cast("bigint")
    share = F.when(F.col("ram_total") == 0, 0.0).otherwise(
        allocated.cast("double") / F.col("ram_total").cast("double") * 100
    )
    return nodes.join(used, "node_id", "left").withColumns(
        {
            "ram_allocated": allocated,
            "ram_available": F.greatest(F.col("ram_total") - allocated, F.lit(0)).cast("bigint"),
            "occupancy": share,
            "process_count": F.coalesce("_count", F.lit(0)).cast("bigint"),
        }
    ).drop("_ram", "_count")


def summary(nodes: DataFrame, processes: DataFrame) -> DataFrame:
    """Thirteen totals in one row; processes have a ``kind``.

    Nodes and processes are stacked so that one aggregate with map-side combine does it all.
    """
    stacked = nodes.select("ram_total", "cpu_cores", "gpu_vram", F.lit(True).alias("node")).unionByName(
        processes.select("kind", "ram_allocated"), allowMissingColumns=True
    )
    is_node = F.col("node").isNotNull()
    gpu = F.coalesce("gpu_vram", F.lit(0)) > 0

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")

    def of_kind(kind: str) -> list[Column]:
        mine = F.col("kind") == kind
        return [
            F.count_if(mine).alias(f"{kind}_count"),
            F.coalesce(F.sum(F.when(mine, F.col("ram_allocated"))), F.lit(0)).cast("bigint").alias(f"{kind}_ram"),
        ]

    out = stacked.agg(
        F.count_if(is_node & ~gpu).alias("regular_nodes"),
        F.count_if(is_node & gpu).alias("gpu_nodes"),
        total("ram_total").alias("total_ram"),
        total("cpu_cores").alias("total_cores"),
        total("gpu_vram").alias("total_vram"),
        *[c for kind in PROCESS_KINDS for c in of_kind(kind)],
        total("ram_allocated").alias("total_allocated"),
    )
    share = F.col("total_allocated").cast("double") / F.col("total_ram").cast("double") * 100
    return out.withColumn("occupancy", F.when(F.col("total_ram") == 0, 0.0).otherwise(share))


def capacity_by_class(nodes: DataFrame) -> DataFrame:
    """Nodes, memory, cores and GPU memory of regular and GPU nodes, and a total row."""
    gpu = F.when(F.col("gpu_vram") > 0, "gpu").otherwise("regular")
    return (
        nodes.withColumn("class", gpu)
        .rollup("class")
        .agg(
            F.count("*").alias("nodes"),
            F.sum("ram_total").alias("ram"),
            F.sum("cpu_cores").alias("cores"),
            F.sum("gpu_vram").alias("vram"),
        )
        .withColumn("class", F.coalesce("class", F.lit("total")))
    )


def snapshot(nodes: DataFrame, processes: DataFrame) -> DataFrame:
    """The whole inventory as (section, id, ram, body) rows; ``body`` is the member's JSON, and one row
    of the section ``summary`` holds the totals.

    Members stay rows: a fleet is never gathered into one document in one task.
    """
    totals = summary(nodes, processes)
    total_row = totals.select(
        F.lit("summary").alias("section"),
        F.lit("").alias("id"),
        F.col("total_ram").alias("ram"),
        F.to_json(F.struct(*totals.columns)).alias("body"),
    )
    node_rows = nodes.select(
        F.lit("nodes").alias("section"),
        F.col("node_id").alias("id"),
        F.col("ram_total").alias("ram"),
        F.to_json(F.struct(*nodes.columns)).alias("body"),
    )
    process_rows = processes.select(
        F.concat("kind", F.lit("s")).alias("section"),
        F.col("process_id").cast("string").alias("id"),
        F.col("ram_allocated").alias("ram"),
        F.to_json(F.struct(*processes.columns)).alias("body"),
    )
    return node_rows.unionByName(process_rows).unionByName(total_row)


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row that changes when any member changes, whatever the row order or the time."""
    row = F.xxhash64("section", "id", "body")
    return rows.agg(F.count("*").alias("members"), F.bit_xor(row).alias("mix"), F.sum(row.cast("decimal(38,0)")).alias("total"))


def changed_since(rows: DataFrame, previous: DataFrame | None) -> bool:
    """Change-only publishing: compare the fingerprint with the last published one."""
    return previous is None or fingerprint(rows).exceptAll(previous).limit(1).count() > 0


#: Buckets of members in a published snapshot.
MEMBER_BUCKETS = 64


def publish(rows: DataFrame, folder: str, version: int, buckets: int = MEMBER_BUCKETS) -> None:
    """Write a version of the snapshot by buckets of members, with one digest per bucket."""
    bucket = F.pmod(F.xxhash64("section", "id"), F.lit(buckets)).cast("int")
    members = f"{folder}/members/version={version}"
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(members)
    read = rows.sparkSession.read.schema(f"{_MEMBER}, bucket int").parquet(members)
    row = F.xxhash64("section", "id", "ram", "body")
    digests = read.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(row).alias("mix"), F.sum(row.cast("decimal(38,0)")).alias("total"))
    digests.write.mode("overwrite").parquet(f"{folder}/digests/version={version}")


_MEMBER = "section string, id string, ram bigint, body string"


def published_changes(spark: SparkSession, folder: str, before: int, after: int) -> DataFrame:
    """What changed between two published versions: ``change`` (added, changed, removed) and the member,
    for a removed one as it was.

    Digests are compared first; members are read only of the buckets that differ, of both versions.
    """
    old, new = (spark.read.parquet(f"{folder}/digests/version={v}") for v in (before, after))
    same = reduce(and_, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("members", "mix", "total")])
    pairs = old.alias("o").join(new.alias("n"), F.col("o.bucket") == F.col("n.bucket"), "full_outer").where(~same)
    differ = [r[0] for r in pairs.select(F.coalesce("o.bucket", "n.bucket")).collect()]  # at most as many as buckets
    was, now = (
        spark.read.schema(f"{_MEMBER}, bucket int").parquet(f"{folder}/members/version={v}").where(F.col("bucket").isin(differ)).select("section", "id", F.struct("ram", "body").alias(name))
        for v, name in ((before, "was"), (after, "now"))
    )
    both = was.join(now, ["section", "id"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.select(kind.alias("change"), "section", "id", F.coalesce("now", "was").alias("m")).select("change", "section", "id", "m.*")


def listing(subscriptions: DataFrame, rows: int = LISTING_ROWS) -> DataFrame:
    """First subscriptions by subject (a distributed top-k)."""
    return subscriptions.orderBy("subject", "sub_id").limit(rows)


# --- change folding -----------------------------------------------------------------------

_NODE_EVENTS = ("land_added", "land_removed")


def live_nodes(changes: DataFrame) -> DataFrame:
    """Nodes alive after all changes, with the memory last reported.

    A node lives when its last add comes after its last removal. One combinable aggregate.
    """
    t, slot = F.col("type"), F.col("slot")
    reported = t.isin("land_added", "land_updated") & F.col("ram").isNotNull()
    return (
        changes.where(t.isin("land_added", "land_removed", "land_updated"))
        .groupBy("node_id")
        .agg(
            F.max(F.when(t == "land_added", slot)).alias("since"),
            F.max(F.when(t == "land_removed", slot)).alias("_gone"),
            F.max_by("ram", F.when(reported, slot)).alias("ram"),
        )
        .where(F.col("since") > F.coalesce("_gone", F.lit(-1)))
        .drop("_gone")
    )


_TARGETS = "slot bigint, target string"


def _take_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node each removal without a node hits: the first running copy in node order.

    Rows come in order per process; what is kept are the nodes that run the current process.
    """
    process, ends, order = None, {}, []
    for batch in batches:
        slots, targets = [], []
        for row in batch.to_pylist():
            if row["process_id"] != process:
                process, ends, order = row["process_id"], {}, []
            node, slot = row["node_id"], row["slot"]
            if node is not None:
                if row["until"] is None:
                    ends.pop(node, None)
                else:
                    if node not in ends:
                        heapq.heappush(order, node)
                    ends[node] = row["until"]
                continue
            while order and ends.get(order[0], 0) < slot:
                ends.pop(heapq.heappop(order), None)
            if order:
                slots.append(slot)
                targets.append(heapq.heappop(order))
                ends.pop(targets[-1])
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int64()), "target": pa.array(targets, pa.string())})


def _open_removal() -> Column:
    return (F.col("type") == "process_removed") & F.col("node_id").isNull() & F.col("process_id").isNotNull()


def _by_node(changes: DataFrame, width: int) -> DataFrame:
    """Add the node's last add or removal before each change, and the slot of its next one."""
    node_event = F.col("type").isin(*_NODE_EVENTS)
    return running(
        changes,
        ["node_id"],
        "slot",
        [
            Running("_node", F.when(node_event, F.struct("slot", "type")), "last", strict=True),
            Running("_node_next", F.when(node_event, F.col("slot")), "next"),
        ],
        width=width,
    )


def with_targets(changes: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Add ``target`` and what ``_by_node`` knows. The target is the change's node; for a removal
    without a node, the first node in id order that runs the process then (NULL if none does).

    Which copy goes depends on what the removals before it took, so this is the one ordered pass per
    process. It sees only processes that have such removals, and of the changes between two of them
    only the last of each node, counted and grouped before that by the sweeps and one combinable
    aggregate.
    """
    t, slot = F.col("type"), F.col("slot")
    wide = changes.where(_open_removal())
    concerned = wide.select("process_id").distinct()
    by_node = _by_node(changes, width)
    moves = by_node.where(
        (t == "process_removed") | ((t == "process_added") & (F.col("_node.type") == "land_added"))
    ).join(concerned, "process_id", "left_semi")
    until = F.when(t == "process_added", F.coalesce("_node_next", F.lit(1 << 62)))
    rounds = running(
        moves.select("slot", "process_id", "node_id", until.alias("until")),
        ["process_id"],
        "slot",
        [Running("_round", F.when(F.col("node_id").isNull(), F.lit(1).cast("bigint")), "sum", strict=True)],
        width=width,
    )
    last = rounds.groupBy("process_id", F.coalesce("_round", F.lit(0)).alias("_round"), "node_id").agg(
        F.max(slot).alias("slot"), F.max_by("until", slot).alias("until")
    )
    dealt = last.repartition("process_id").sortWithinPartitions("process_id", "slot")
    hits = dealt.select("process_id", "node_id", "slot", "until").mapInArrow(_take_first, _TARGETS)
    rest = by_node.where(~F.coalesce(_open_removal(), F.lit(False))).withColumn("target", F.col("node_id"))
    return rest.unionByName(wide.join(hits, "slot", "left"), allowMissingColumns=True)


def live_processes(changes: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Processes alive after all changes, one row per (node, process).

    A process lives when its node does, and its last add comes after the node's own last add and
    after its last removal. A removal without a node ends the first running copy in node order. An
    update reaches every running copy of the process id.
    """
    t, slot = F.col("type"), F.col("slot")
    added = t == "process_added"
    removed = t == "process_removed"
    per_copy = (
        with_targets(changes.where(added | removed | t.isin(*_NODE_EVENTS)), width)
        .where((added | removed) & F.col("target").isNotNull())
        .groupBy(F.col("target").alias("node_id"), "process_id")
        .agg(
            F.max(F.when(added, slot)).alias("started"),
            F.max_by("ram", F.when(added, slot)).alias("_ram"),
            F.max(F.when(removed, slot)).alias("_gone"),
        )
    )
    per_process = (
        changes.where(t == "process_updated")
        .groupBy("process_id")
        .agg(F.max_by(F.struct("slot", "ram"), slot).alias("_updated"))
    )
    joined = per_copy.join(live_nodes(changes).select("node_id", "since"), "node_id").join(
        per_process, "process_id", "left"
    )
    return joined.where(
        (F.col("started") > F.col("since")) & (F.col("started") > F.coalesce("_gone", F.lit(-1)))
    ).select(
        "node_id",
        "process_id",
        "started",
        F.when(F.col("_updated.slot") > F.col("started"), F.col("_updated.ram")).otherwise(F.col("_ram")).alias("ram"),
    )


def change_outcomes(changes: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Add ``applied`` to every change; a change of an unknown node or process is an error.

    Three sweeps over the changes with their targets: node events per node, adds and removals per
    (node, process), and for updates (which name only a process) the latest end of any earlier stay
    of that process.
    """
    t, slot = F.col("type"), F.col("slot")
    node_live = F.coalesce(F.col("_node.type") == "land_added", F.lit(False))
    by_copy = running(
        with_targets(changes, width),
        ["target", "process_id"],
        "slot",
        [
            Running("_added", F.when(t == "process_added", slot), "last", strict=True),
            Running("_removed", F.when(t == "process_removed", slot), "last", strict=True),
            Running("_removed_next", F.when(t == "process_removed", slot), "next"),
        ],
        width=width,
    )
    copy_live = F.when(_open_removal(), F.col("target").isNotNull()).otherwise(
        node_live
        & (F.col("_added") > F.col("_node.slot"))
        & (F.col("_added") > F.coalesce("_removed", F.lit(-1)))
    )
    forever = F.lit((1 << 62))
    stay_end = F.least(F.coalesce("_node_next", forever), F.coalesce("_removed_next", forever))
    by_process = running(
        by_copy.withColumns({"_node_live": node_live, "_copy_live": F.coalesce(copy_live, F.lit(False))}),
        ["process_id"],
        "slot",
        [Running("_until", F.when((t == "process_added") & F.col("_node_live"), stay_end), "max", strict=True)],
        width=width,
    )
    ok = first_case(
        [
            (t == "land_added", F.lit(True)),
            (t.isin("land_removed", "land_updated", "process_added"), F.col("_node_live")),
            (t == "process_removed", F.col("_copy_live")),
            (t == "process_updated", F.coalesce(F.col("_until") > slot, F.lit(False))),
        ],
        F.lit(False),
    )
    return by_process.select(*changes.columns, ok.alias("applied"))


def event_feed(changes: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """One record per change that took effect."""
    return change_outcomes(changes, width).where("applied").drop("applied")


def recent(changes: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """Newest changes only (a distributed top-k)."""
    return changes.orderBy(F.col("slot").desc()).limit(rows)
