"""The state table, maintained from the change log and laid out for reads by key.

Every micro-batch of the log adds two parts in one commit (``parts``): ``log``, what each entry did,
with its revision and the value it replaced, and ``state``, the newest row of each entity it touched.
State parts are folders by bucket of the entity, sorted by entity, with a bloom filter, so a read by key
opens the folders of its buckets and skips the row groups without its keys. No read numbers or sweeps the
log again.

Entries arrive in slot order from batch to batch. Entries at or below the last slot applied are repeats
and do nothing, so a replayed log changes nothing and its feed has nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.subjects import subject_match
from ..operators import state
from ..operators.ordered import SEGMENT_WIDTH, Running, running
from . import jobs, parts

BUCKETS = 64


def bucket_of(entity: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")


def _newest(rows: DataFrame) -> DataFrame:
    """The row of the largest revision per entity (one combinable aggregate)."""
    newest = rows.groupBy("bucket", "entity").agg(F.max_by(F.struct("action", "data", "slot", "revision"), "revision").alias("s"))
    return newest.select("bucket", "entity", "s.*")


def _merge_state(rows: DataFrame, oldest: bool) -> DataFrame:
    """Deleted entities are kept as such until no older part can hold them."""
    newest = _newest(rows)
    return newest.where("action <> 'delete'") if oldest else newest


STATE = parts.Kind(
    "entity string, action string, data string, slot bigint, revision bigint, bucket int",
    _merge_state,
    partition_by=("bucket",),
    sort_by=("entity",),
    options={"parquet.bloom.filter.enabled#entity": "true"},
)
LOG = parts.Kind("slot bigint, entity string, action string, data string, outcome string, revision bigint, before string", lambda rows, oldest: rows)
KINDS = {"state": STATE, "log": LOG}


def apply(batch: DataFrame, batch_id: int, folder: str, buckets: int = BUCKETS, width: int = SEGMENT_WIDTH) -> None:
    """Apply one batch of ``slot, entity, action, data`` entries to the table."""
    spark = batch.sparkSession
    known = parts.latest(spark, folder)
    if batch_id <= known.batch:
        return
    buckets = known.notes.get("buckets", buckets)
    last_slot, last_revision = known.notes.get("slot", 0), known.notes.get("revision", 0)
    new = _unseen(batch, last_slot).persist()
    try:
        done = _outcomes(new, _touched(spark, folder, known, new, buckets), last_revision, width)
        added = {"log": parts.write_part(done, folder, "log", batch_id, LOG)}
    finally:
        new.unpersist()
    written = parts.scan(spark, folder, "log", LOG, [added["log"]])
    changed = written.where("revision is not null").withColumn("bucket", bucket_of(F.col("entity"), buckets))
    added["state"] = parts.write_part(_newest(changed), folder, "state", batch_id, STATE)
    top = written.agg(F.max("slot").alias("slot"), F.max("revision").alias("revision")).head()
    notes = {"buckets": buckets, "slot": max(last_slot, top["slot"] or 0), "revision": max(last_revision, top["revision"] or 0)}
    parts.commit(spark, folder, known, batch_id, added, KINDS, notes)


def _unseen(batch: DataFrame, last_slot: int) -> DataFrame:
    """Each entry after the last slot once. Rows are dealt by slot before that: hardly any repeat, and where
    they are scanned a task would sort its whole split to find out."""
    young = batch.where(F.col("slot") > last_slot).select("slot", "entity", "action", "data")
    return young.repartition("slot").dropDuplicates(["slot"])


def _touched(spark: SparkSession, folder: str, known: parts.Manifest, new: DataFrame, buckets: int) -> DataFrame | None:
    """Live rows of the entities of a batch, read from their buckets alone; None while there are no parts."""
    if not known.paths("state"):
        return None
    asked = new.select("entity").distinct()
    near = _of_buckets(parts.read(spark, folder, "state", STATE, known), asked, buckets)
    return _newest(near.join(asked, "entity", "left_semi")).where("action <> 'delete'").drop("bucket")


def _of_buckets(stored: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """Only the folders of the buckets that the asked entities fall into."""
    wanted = [r[0] for r in asked.select(bucket_of(F.col("entity"), buckets)).distinct().collect() if r[0] is not None]  # at most ``buckets``
    return stored.where(F.col("bucket").isin(wanted))


def _outcomes(new: DataFrame, stored: DataFrame | None, last_revision: int, width: int) -> DataFrame:
    """Entries with their outcome, revision (null if nothing changed) and the value before them. Stored
    entities stand in as one update each, before all new slots."""
    both = new.withColumn("_stored", F.lit(False))
    if stored is not None:
        both = both.unionByName(stored.select("slot", "entity", F.lit("update").alias("action"), "data", F.lit(True).alias("_stored")))
    both = state.outcomes(both, width)
    applied = F.col("outcome").isin("applied", "created_by_update")
    value = F.when(applied, F.struct("action", "data"))
    seen = running(both, ["entity"], "slot", [Running("_old", value, "last", strict=True)], width=width).where(~F.col("_stored"))
    one = F.when(applied, F.lit(1).cast("bigint"))
    numbered = running(seen, [], "slot", [Running("_n", one, "sum")], width=width)
    return numbered.select(
        "slot",
        "entity",
        "action",
        "data",
        "outcome",
        F.when(applied, F.col("_n") + F.lit(last_revision)).alias("revision"),
        F.when(F.col("_old.action") != "delete", F.col("_old.data")).alias("before"),
    )


def maintain(log_stream: DataFrame, folder: str, buckets: int = BUCKETS, width: int = SEGMENT_WIDTH) -> str:
    """Apply everything available of a change-log stream; returns the table's folder."""
    table = f"{folder}/table"
    jobs.run_batches(log_stream, lambda batch, batch_id: apply(batch, batch_id, table, buckets, width), f"{folder}/checkpoint")
    return table


def current(spark: SparkSession, folder: str) -> DataFrame:
    """Live ``entity, data, slot, revision``."""
    return _newest(parts.read(spark, folder, "state", STATE)).where("action <> 'delete'").drop("bucket", "action")


def get(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Live rows of a few keys; the scan reads their buckets and passes the keys to parquet."""
    known = parts.latest(spark, folder)
    stored = parts.read(spark, folder, "state", STATE, known)
    wanted = F.col("bucket").isin([r[0] for r in spark.createDataFrame([(k,) for k in keys], "entity string").select(bucket_of(F.col("entity"), known.notes["buckets"])).collect()])
    return _newest(stored.where(wanted & F.col("entity").isin(keys))).where("action <> 'delete'").drop("bucket", "action")


def get_many(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """``found``, ``data`` and ``revision`` (0 when absent) of every asked ``entity``, in its own columns
    and rows. Both sides are joined on (bucket, entity); other buckets are not read."""
    known = parts.latest(spark, folder)
    buckets = known.notes["buckets"]
    near = _of_buckets(parts.read(spark, folder, "state", STATE, known), asked, buckets)
    live = _newest(near).where("action <> 'delete'").select("bucket", "entity", "data", "revision")
    hit = asked.withColumn("bucket", bucket_of(F.col("entity"), buckets)).join(live, ["bucket", "entity"], "left")
    return hit.drop("bucket").withColumns({"found": F.col("revision").isNotNull(), "revision": F.coalesce("revision", F.lit(0).cast("bigint"))})


def watch(spark: SparkSession, folder: str, pattern: str = ">", after: int = 0) -> DataFrame:
    """The change feed after a revision: ``revision, entity, action, data, before`` of matching entities;
    deletes are skipped."""
    rows = parts.read(spark, folder, "log", LOG).where((F.col("revision") > after) & (F.col("action") != "delete"))
    return rows.where(subject_match(F.col("entity"), pattern or ">")).select("revision", "entity", "action", "data", "before")
