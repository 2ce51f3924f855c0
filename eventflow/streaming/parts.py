"""Tables kept up to date by micro-batches: parts, merged by size, and one manifest that lists them.

Each batch adds a part to each table and then commits a manifest, a small file put in place by a
rename. Readers go by the newest manifest, so they see all of a batch or nothing of it, in all tables at
once. A batch that runs again finds its number in the manifest and does nothing; one that was cut off
before its commit leaves files that no manifest names, and writes its own anew.

``FANOUT`` neighbouring parts of one tier become one part of the next, so a table of n batches has at most
(FANOUT - 1) * (log_FANOUT(n) + 1) parts. Merged parts stay for ``KEPT`` batches, for readers of an
earlier manifest. There is one writer at a time: the stream with its checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FANOUT = 4
KEPT = 10


@dataclass
class Manifest:
    """The last batch, the parts of each table as (path, tier) from the oldest on, and what the job
    remembers between batches."""

    batch: int = -1
    tables: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    notes: dict[str, int] = field(default_factory=dict)
    retired: list[tuple[str, int]] = field(default_factory=list)

    def paths(self, table: str) -> list[str]:
        return [path for path, _ in self.tables.get(table, [])]


@dataclass(frozen=True)
class Kind:
    """A table's columns, how several neighbouring parts become one, and the folders inside a part.
    ``merge`` is told whether the oldest part is among them."""

    schema: str
    merge: Callable[[DataFrame, bool], DataFrame]
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)


def _hadoop(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _versions(spark: SparkSession, folder: str) -> list[int]:
    system, there = _hadoop(spark, f"{folder}/manifest")
    names = [s.getPath().getName() for s in system.listStatus(there)] if system.exists(there) else []
    return sorted(int(n.removesuffix(".json")) for n in names if not n.startswith("."))


def latest(spark: SparkSession, folder: str) -> Manifest:
    """The newest committed manifest; an empty one before the first batch."""
    versions = _versions(spark, folder)
    if not versions:
        return Manifest()
    text = spark.read.text(f"{folder}/manifest/{versions[-1]}.json", wholetext=True).head()[0]
    known = json.loads(text)
    pairs = lambda rows: [tuple(r) for r in rows]
    return Manifest(known["batch"], {t: pairs(p) for t, p in known["tables"].items()}, known["notes"], pairs(known["retired"]))


def scan(spark: SparkSession, folder: str, table: str, kind: Kind, paths: list[str]) -> DataFrame:
    """All rows of some parts; without any, an empty table of the same columns."""
    if not paths:
        return spark.createDataFrame([], kind.schema)
    reader = spark.read.schema(f"{kind.schema}, part string").option("basePath", f"{folder}/{table}")
    return reader.parquet(*paths).drop("part")


def read(spark: SparkSession, folder: str, table: str, kind: Kind, manifest: Manifest | None = None) -> DataFrame:
    """All rows of a table, by the given or the newest manifest."""
    return scan(spark, folder, table, kind, (manifest or latest(spark, folder)).paths(table))


def write_part(df: DataFrame, folder: str, table: str, batch_id: int, kind: Kind) -> str:
    """Write a new part under a name of its own; it counts once a manifest lists it."""
    path = f"{folder}/{table}/part={batch_id}-{uuid.uuid4().hex}"
    if kind.partition_by:
        df = df.repartition(*kind.partition_by).sortWithinPartitions(*kind.partition_by, *kind.sort_by)
    df.write.options(**kind.options).parquet(path, partitionBy=list(kind.partition_by) or None)
    return path


def commit(spark: SparkSession, folder: str, before: Manifest, batch_id: int, added: dict[str, str], kinds: dict[str, Kind], notes: dict[str, int]) -> Manifest:
    """Add a batch's parts, merge what is due, and put the new manifest in place."""
    after = Manifest(batch_id, {t: list(p) for t, p in before.tables.items()}, {**before.notes, **notes}, list(before.retired))
    for table, path in added.items():
        parts = after.tables.setdefault(table, [])
        parts.append((path, 0))
        while len(parts) >= FANOUT and len({tier for _, tier in parts[-FANOUT:]}) == 1:
            last = parts[-FANOUT:]
            del parts[-FANOUT:]
            merged = kinds[table].merge(scan(spark, folder, table, kinds[table], [p for p, _ in last]), not parts)
            parts.append((write_part(merged, folder, table, batch_id, kinds[table]), last[0][1] + 1))
            after.retired += [(p, batch_id) for p, _ in last]
    gone = [p for p, at in after.retired if at <= batch_id - KEPT]
    after.retired = [(p, at) for p, at in after.retired if at > batch_id - KEPT]
    _put(spark, folder, after)
    _remove(spark, folder, gone, batch_id - KEPT)
    return after


def place(df: DataFrame, path: str) -> None:
    """Write a folder that is there as a whole or not at all; one that is there already stays."""
    system, final = _hadoop(df.sparkSession, path)
    if system.exists(final):
        return
    draft = f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}"
    df.write.parquet(draft)
    if not system.rename(_hadoop(df.sparkSession, draft)[1], final):
        raise OSError(f"could not put {path} in place")


def _put(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    system, final = _hadoop(spark, f"{folder}/manifest/{manifest.batch}.json")
    draft = _hadoop(spark, f"{folder}/manifest/.{uuid.uuid4().hex}")[1]
    out = system.create(draft, True)
    out.write(bytearray(json.dumps(vars(manifest)).encode()))
    out.close()
    if not system.rename(draft, final):
        raise OSError(f"could not put {final} in place")


def _remove(spark: SparkSession, folder: str, parts: list[str], until: int) -> None:
    """Parts merged long ago, and the manifests that named them."""
    for path in [*parts, *[f"{folder}/manifest/{v}.json" for v in _versions(spark, folder) if v < until]]:
        system, there = _hadoop(spark, path)
        system.delete(there, True)
