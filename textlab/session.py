"""Session for local runs, and the places on shared storage that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark import StorageLevel
from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "textlab", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches: ``spark.checkpoint.dir`` of the session.

    Only a session that runs in one process gets a temporary folder where it names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return _local_dir()
    raise ValueError("set spark.checkpoint.dir to a folder that all machines share")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="textlab-")


def work_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/textlab/{purpose}-{uuid.uuid4().hex}"


def written(df, purpose: str):
    """Cut the lineage of ``df`` by a table in the shared folder, which outlives executors."""
    path = work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a batch of a held table. Whatever writes a partition to disk or reads it from there keeps 100 batches.
BATCH_ROWS = 32
BATCH_KEY = "spark.sql.inMemoryColumnarStorage.batchSize"


def hold(df):
    """``df`` persisted at once, in small batches.

    The batches that Spark makes else have up to 4 MB, of which its serializer keeps 100 for each task that
    writes or reads what is no longer in memory. Wide rows then fill an executor.
    """
    conf = df.sparkSession.conf
    before = conf.get(BATCH_KEY)
    # Read when the table is persisted or when its batches are made, depending on the settings of the session.
    conf.set(BATCH_KEY, BATCH_ROWS)
    try:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
    except Exception:
        df.unpersist()
        raise
    finally:
        conf.set(BATCH_KEY, before)
    return kept
