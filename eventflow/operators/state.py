"""Current state from the change log: fold, outcomes, revisions, history, as-of reads, conflicts.

Rules of the log: ``create`` only when the entity is absent (otherwise rejected, state kept),
``update`` always writes (and creates when absent), ``delete`` removes (nothing when absent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import documents as doc
from ..functions.subjects import subject_match
from .changelog import ACTIONS
from .events import blank
from .ordered import SEG, SEGMENT_WIDTH, Running, newest_per_key, number_rows, running, segment_of

# Fixed value: revisions kept per entity.
HISTORY = 10


def _usable() -> Column:
    """Entries the fold can apply; the others are errors and change nothing."""
    action = F.col("action")
    return ~blank(F.col("entity")) & action.isin(*ACTIONS) & ((action == "delete") | ~blank(F.col("data")))


def compact(log: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Reduce a part of the log to a few rows per entity, enough to rebuild the state.

    Kept are the slot of the last delete, the last update, and per log segment the first create
    after the segment's last delete. Updates and deletes are aggregated before the shuffle, so
    a hot entity sends one row per map task. Only creates, and delete slots without data, are
    shuffled as rows, by (entity, segment). Compacting a replayed part gives the same rows, and
    rows of any split of the log can be put together by ``combine``.
    """
    action, slot = F.col("action"), F.col("slot")
    usable = log.where(_usable())
    entry = F.struct("slot", "data")
    settled = usable.where(action != "create").groupBy("entity").agg(
        F.max(F.when(action == "delete", slot)).alias("gone"),
        F.max_by(entry, F.when(action == "update", slot)).alias("written"),
    )
    seg = W.partitionBy("entity", SEG)
    gone = F.max(F.when(action == "delete", slot)).over(seg)
    births = (
        usable.where(action != "update")
        .select("entity", "slot", "action", F.when(action == "create", F.col("data")).alias("data"))
        .withColumn(SEG, segment_of("slot", width))
        .withColumn("_gone", gone)
        .where((action == "create") & F.coalesce(slot > F.col("_gone"), F.lit(True)))
        .groupBy("entity", SEG)
        .agg(F.min_by(entry, slot).alias("created"))
        .drop(SEG)
    )
    return settled.unionByName(births, allowMissingColumns=True)


def combine(parts: DataFrame) -> DataFrame:
    """Compacted rows of any number of log parts reduced to one row per entity."""
    gone = F.max("gone").over(W.partitionBy("entity"))
    marked = parts.withColumn("_gone", gone)

    def after(entry: str) -> Column:
        slot = F.col(f"{entry}.slot")
        return F.when(F.coalesce(slot > F.col("_gone"), slot.isNotNull()), slot)

    return marked.groupBy("entity").agg(
        F.max("_gone").alias("gone"),
        F.max_by("written", after("written")).alias("written"),
        F.min_by("created", after("created")).alias("created"),
    )


def merge(parts: DataFrame) -> DataFrame:
    """Live ``entity, data, slot`` from compacted rows."""
    entry = F.coalesce("written", "created")
    return (
        combine(parts)
        .where(entry.isNotNull())
        .select("entity", entry["data"].alias("data"), entry["slot"].alias("slot"))
    )


def fold(log: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Current state ``entity, data, slot`` of the whole log."""
    return merge(compact(log, width))


def state_at(log: DataFrame, slot: int | Column, width: int = SEGMENT_WIDTH) -> DataFrame:
    """State as of a log position (a number or a scalar subquery); the filter prunes the scan."""
    return fold(log.where(F.col("slot") <= slot), width)


def outcomes(log: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """What each entry did: applied, rejected_exists, created_by_update, noop_delete or error.

    Whether the entity was present follows from the last usable action before the entry: a
    rejected create leaves it present, a no-op delete leaves it absent.
    """
    action = F.col("action")
    marked = running(
        log,
        ["entity"],
        "slot",
        # A flag, not the action's text: fixed-width values aggregate by hash, without a sort.
        [Running("_before", F.when(_usable(), action != "delete"), "last", strict=True)],
        width=width,
    )
    present = F.coalesce("_before", F.lit(False))
    return marked.withColumn(
        "outcome",
        F.when(~_usable(), "error")
        .when((action == "create") & present, "rejected_exists")
        .when((action == "update") & ~present, "created_by_update")
        .when((action == "delete") & ~present, "noop_delete")
        .otherwise("applied"),
    ).drop("_before")


def applied(log: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Entries that changed the state table."""
    return outcomes(log, width).where(F.col("outcome").isin("applied", "created_by_update"))


def revisions(log: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Applied entries with their table-wide revision 1, 2, 3.. in slot order."""
    return number_rows(applied(log, width), "slot", "revision", width=width)


def current(revised: DataFrame) -> DataFrame:
    """Live ``entity, data, revision`` from numbered entries (one combinable aggregate)."""
    newest = revised.groupBy("entity").agg(
        F.max_by(F.struct("action", "data", "revision"), "revision").alias("s")
    )
    return newest.where(F.col("s.action") != "delete").select(
        "entity", F.col("s.data").alias("data"), F.col("s.revision").alias("revision")
    )


def history(revised: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The newest ``keep`` revisions of every entity, deletes included."""
    return newest_per_key(revised, "entity", "revision", keep)


def get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Look up many entities: ``found``, ``data`` and ``revision`` (0 when absent)."""
    hit = keys.join(state, "entity", "left")
    return hit.withColumn("found", F.col("revision").isNotNull()).withColumn(
        "revision", F.coalesce("revision", F.lit(0).cast("bigint"))
    )


def keys(state: DataFrame) -> DataFrame:
    return state.select("entity")


def watch(revised: DataFrame, pattern: str = ">") -> DataFrame:
    """Feed of writes to matching entities; deletes are skipped."""
    return revised.where((F.col("action") != "delete") & subject_match(F.col("entity"), pattern or ">"))


def lookup(events: DataFrame, state: DataFrame, key: str = "entity") -> DataFrame:
    """Events with the current ``state_data`` and ``state_revision`` of their entity (left join)."""
    right = state.select(
        F.col("entity").alias(key), F.col("data").alias("state_data"), F.col("revision").alias("state_revision")
    )
    return events.join(right, key, "left")


def as_of(reads: DataFrame, log: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """What a reader at log position ``slot`` saw: ``seen_slot`` and ``seen_data``.

    ``reads`` has ``read_id, entity, slot``. Entries at the read's own slot count. Reads and
    entries are stacked and swept once per (entity, segment), so no range join is needed.
    """
    ops = outcomes(log, width).where(F.col("outcome").isin("applied", "created_by_update"))
    events = ops.select(
        "entity",
        "slot",
        F.lit(0).alias("_turn"),
        F.struct("slot", "action", "data").alias("_op"),
        F.lit(None).cast("bigint").alias("read_id"),
    )
    probes = reads.select(
        "entity", "slot", F.lit(1).alias("_turn"), F.lit(None).cast(events.schema["_op"].dataType).alias("_op"), "read_id"
    )
    swept = running(
        events.unionByName(probes),
        ["entity"],
        ["slot", "_turn", "read_id"],
        [Running("_seen", F.col("_op"), "last")],
        segment=segment_of("slot", width),
    ).where(F.col("read_id").isNotNull())
    live = F.col("_seen.action") != "delete"
    return swept.select(
        "read_id",
        "entity",
        "slot",
        F.coalesce(F.when(live, F.col("_seen.slot")), F.lit(0)).alias("seen_slot"),
        F.when(live, F.col("_seen.data")).alias("seen_data"),
    )


def compare_and_set(attempts: DataFrame) -> DataFrame:
    """One round of conditional writes: at most one winner per entity, first by ``arrival``.

    ``expected_revision`` 0 means create, and an absent entity has ``current_revision`` 0. The
    winner per entity is a combinable aggregate; it is joined back on (entity, arrival), which
    spreads evenly however many attempts one entity gets.
    """
    fits = F.col("expected_revision") == F.col("current_revision")
    winners = attempts.where(fits).groupBy("entity").agg(F.min("arrival").alias("arrival"))
    marked = attempts.join(winners.withColumn("_won", F.lit(True)), ["entity", "arrival"], "left")
    create = F.col("expected_revision") == 0
    return marked.withColumn(
        "outcome",
        F.when(F.col("_won"), F.when(create, "created").otherwise("updated"))
        .when(create, "conflict_exists")
        .otherwise("conflict_revision"),
    ).drop("_won")


def put_delete(ops: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Outcomes of blind writes and strict deletes: ``put`` always writes, ``delete`` of an
    absent entity is an error."""
    as_log = ops.withColumn("action", F.when(F.col("action") == "put", "update").otherwise(F.col("action")))
    done = outcomes(as_log, width)
    return done.withColumn(
        "outcome",
        F.when(F.col("outcome") == "noop_delete", "not_found")
        .when(F.col("outcome").isin("applied", "created_by_update"), F.when(F.col("action") == "delete", "deleted").otherwise("written"))
        .otherwise(F.col("outcome")),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``added`` and ``removed`` keys between two inventories (each key once per side), in one join."""
    before = old.select(key, F.lit(True).alias("_old"))
    after = new.select(key, F.lit(True).alias("_new"))
    both = before.join(after, key, "full_outer").where(F.col("_old").isNull() | F.col("_new").isNull())
    return both.select(key, F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change"))


def status_upsert(updates: DataFrame, position: str, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Merge status events into their entity, each seeing all earlier ones.

    Columns read: ``entity_id, status, message, ts`` and the position. The first event of an
    entity creates it and fixes ``created_at``; later ones update status, message and time.
    """
    known = updates.where(F.col("entity_id").isNotNull()).withColumn(
        "entity", F.concat(F.lit("entity-"), "entity_id")
    )
    seen = running(
        known,
        ["entity"],
        position,
        [Running("created_at", F.col("ts"), "first"), Running("_n", F.lit(1).cast("bigint"), "sum")],
        width=width,
    )
    return seen.select(
        position,
        "entity",
        F.when(F.col("_n") == 1, "create").otherwise("update").alias("action"),
        "entity_id",
        "status",
        "message",
        "created_at",
        F.col("ts").alias("last_update"),
    )


def status_documents(updates: DataFrame, stored: DataFrame, position: str, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Merge status events into the stored entities: ``position, entity, action, data`` for each event.

    An entity that is stored keeps its id, ``created_at`` and all other fields and is updated; one that is
    not gets its id and ``created_at`` from its first event. Each event then sets status, message and
    ``last_update``. ``stored`` has one row per ``entity`` with its JSON ``data``; data that is no object
    counts as an empty one. As an event replaces all that the ones before it set, no event waits for
    another: the join and one sweep are all it takes.
    """
    merged = status_upsert(updates, position, width)
    old = stored.select("entity", F.col("data").alias("_stored"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    there = F.col("_stored").isNotNull()
    base = F.when(there, F.when(doc.is_object(F.col("_stored")), F.col("_stored")).otherwise("{}")).otherwise(
        F.to_json(F.struct(F.col("entity_id").alias("id"), stamp("created_at").alias("created_at")))
    )
    fields = {"status": F.col("status"), "last_update": stamp("last_update"), "message": F.col("message")}
    return merged.join(old, "entity", "left").select(
        position, "entity", F.when(there, "update").otherwise(F.col("action")).alias("action"), doc.merge_fields(base, fields).alias("data")
    )


def status_compact(updates: DataFrame, position: str) -> DataFrame:
    """First and last status event per entity (one combinable aggregate)."""
    known = updates.where(F.col("entity_id").isNotNull())
    first = F.struct(F.col(position).alias("at"), "ts")
    last = F.struct(F.col(position).alias("at"), "ts", "status", "message")
    return known.groupBy("entity_id").agg(
        F.min_by(first, position).alias("first"), F.max_by(last, position).alias("last")
    )


def status_entities(parts: DataFrame) -> DataFrame:
    """Entities as the latest status event left them, from any number of compacted parts."""
    merged = parts.groupBy("entity_id").agg(
        F.min_by("first", "first.at").alias("first"), F.max_by("last", "last.at").alias("last")
    )
    return merged.select(
        F.concat(F.lit("entity-"), "entity_id").alias("entity"),
        "entity_id",
        F.col("last.status").alias("status"),
        F.col("last.message").alias("message"),
        F.col("first.ts").alias("created_at"),
        F.col("last.ts").alias("last_update"),
    )
