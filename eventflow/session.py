"""Session helpers: UTC session, table loading and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "eventflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on (all overridable)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that functions defined in it can
    run there whatever folder the driver was started from."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="eventflow-package-")) / f"eventflow-{os.getpid()}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(package.rglob("*.py")):
            packed.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def use_utc(spark: SparkSession) -> None:
    """Epochs, day boundaries and text times are all in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def split_hot_joins(spark: SparkSession) -> None:
    """Let the adaptive planner split a hot join key even where that costs one more shuffle."""
    if spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin", "false") != "true":
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def keep_last_of_repeated_keys(spark: SparkSession) -> None:
    """A JSON object that repeats a key is valid, and the last value counts."""
    if spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") != "true":
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become instants (read as UTC); other columns pass through."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name)
            if isinstance(f.dataType, T.TimestampNTZType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Batch scan of one table."""
    ship(spark)
    use_utc(spark)
    split_hot_joins(spark)
    keep_last_of_repeated_keys(spark)
    return _instants(spark.read.parquet(f"{folder}/{table}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out to all cores when it has fewer tasks than that.

    Meant before per-row parsing work. A table of many files has enough tasks and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """File stream over the same table (one file or a folder of part files)."""
    use_utc(spark)
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # The bracket makes the path a glob, which file streams need for a single file.
    globbed = f"{folder}/{table[:-1]}[{table[-1]}].parquet"
    return _instants(spark.readStream.schema(schema).parquet(globbed))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table into a fresh folder of its own and read it again. That cuts lineage, and a lost
    executor costs no earlier stage."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for tables and stream checkpoints.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``. Only when
    that is unset (as in unit tests on one machine) a local folder is made.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="eventflow-")
    return f"{shared.rstrip('/')}/eventflow-{label}-{uuid.uuid4().hex}"
