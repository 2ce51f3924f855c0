"""Helpers the operators of this subpackage share: tables, folds, bounded samples, shared folders."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.session import ship, work_folder

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that go to a Python worker at once. Whole texts are long: with Spark's default of 10,000 a batch
#: of them, held by the JVM and by the worker in several forms, is what fills an executor.
ROWS_AT_ONCE = 1000
#: Nor more bytes than these (and one row more): rows of megabytes would else fill batches of 64 MB.
BYTES_AT_ONCE = 8 << 20


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).lower().removesuffix("b")
    if size.isdigit() and int(size) > BYTES_AT_ONCE:
        spark.conf.set(name, str(BYTES_AT_ONCE))


def give_back() -> None:
    """Return memory that a worker has freed to the system. Workers outlive their tasks, and what the
    allocator keeps of large arrays adds up over the stages of a job."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


#: How to forget what an operator keeps in this worker between its tasks.
_KEPT: dict[str, Callable[[], object]] = {}


def takes_over(operator: str, forget: Callable[[], object] | None = None) -> None:
    """Called when a task of the operator begins: what other operators keep in this worker goes. One worker
    serves all stages of a job, and would else hold their caches together."""
    others = [_KEPT.pop(name) for name in list(_KEPT) if name != operator]
    for drop in others:
        drop()
    if others:
        give_back()
    if forget is not None:
        _KEPT[operator] = forget


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, k: int) -> Column:
    """crc32 of the key as text, modulo k; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % k


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile removes its shuffle files when it ends. Else they stay until the driver
    happens to collect its garbage, and those of a job of many steps add up on the disks."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = work_folder(spark, label)
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, n: int, salt: int = 7) -> DataFrame:
    """At most about n rows, the same ones on every run: those whose key hashes below a threshold.

    The threshold comes from a count, so that only the sampled rows, never all, reach the driver.
    """
    total = df.count()
    if total <= n:
        return df
    span = 1 << 30
    limit = int(span * (n / total))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(span)) < limit)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that the table does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, inner: tuple[str, ...]) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """The table with its columns of the given names renamed, the new name of every column, and how to
    rename them back: an operator can then use those names for itself."""
    there = {c: fresh(df, f"_{c}") for c in df.columns if c in inner}
    renamed = df.withColumnsRenamed(there)
    return renamed, {c: there.get(c, c) for c in df.columns}, {new: old for old, new in there.items()}
