"""Session helpers: reliable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 50_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="shakegrid-ckpt-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see."""
    return _checkpoint_dir(spark)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the statements inside go when they end, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from there.

    The written copy survives the loss of any executor and fixes the rows, so two readers of the
    result see the same values. A table also forgets what the optimizer knew about the columns;
    in loops that knowledge would grow from step to step.
    """
    path = f"{_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` with its partitioning, so that joins on its partition keys do not move it."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``cut`` in ``parts`` buckets by ``keys``: joins and groups on them do not move it.

    Columns are packed as in any table, while a checkpoint holds every row with its fields side by side. The name in the
    catalogue is needed for the reading alone and goes at once.
    """
    spark = df.sparkSession
    name = f"shakegrid_{uuid.uuid4().hex}"
    with _tidy(spark):
        df.repartition(parts, *keys).write.format("parquet").option("path", f"{_checkpoint_dir(spark)}/{name}").bucketBy(parts, *keys).saveAsTable(name)
    # Left to itself, Spark forgets the buckets behind an explode or a broadcast join and moves the rows after all.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    table = spark.table(name)
    table.schema  # resolved while the name is known
    spark.sql(f"DROP TABLE {name}")
    return table


def width(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all shuffle partitions by keys that are nearly unique, ahead of work that multiplies them."""
    return df.repartition(width(df), *keys)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for ``df`` if it has at most ``rows`` rows, else ``df`` as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
