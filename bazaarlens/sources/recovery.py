"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

__all__ = ["ensure_checkpoint_dir", "cut_lineage", "store_by_key", "store_csv", "scratch_table", "remove_stored"]

_stored: dict[str, SparkSession] = {}   # by path
_tables: dict[str, str] = {}            # catalog entry of a stored path, where it has one


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; a temp folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="bazaarlens-checkpoint-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store as Parquet in the shared folder and read back: later steps restart from files, not from what made them, and
    read the columns they need. Call remove_stored when the results are written; what is left goes when Python ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored[path] = spark
    frame = spark.read.schema(df.schema).parquet(path)
    frame.stored_at = path
    return frame


def store_by_key(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Like cut_lineage, but in buckets by the hash of a key: steps that group or join by the key read them as they lie,
    without a shuffle. ``df`` should come from ``repartition(partitions, key)``, so that each task writes one bucket."""
    spark = df.sparkSession
    path = scratch_table(spark)
    name = f"bazaarlens_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions, key).option("path", path).saveAsTable(name, format="parquet")
    _tables[path] = name
    frame = spark.table(name)
    frame.stored_at = path
    return frame


def store_csv(df: DataFrame) -> str:
    """Write as quoted CSV with headers to the shared folder; quotes within fields are doubled. Returns the folder, which
    remove_stored deletes with the others."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    _stored[path] = df.sparkSession
    return path


def scratch_table(spark: SparkSession) -> str:
    """A path of its own in the shared folder for a table that a caller writes; remove_stored deletes it with the others."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    _stored[path] = spark
    return path


def remove_stored(*frames: DataFrame) -> None:
    """Remove what cut_lineage has stored: all of it, or the tables behind these frames. What reads from it cannot be used
    any more."""
    for path in [f.stored_at for f in frames] if frames else list(_stored):
        spark = _stored.pop(path, None)
        if spark is None or spark.sparkContext._jsc is None:  # gone already, or the session has ended
            continue
        if (name := _tables.pop(path, None)) is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(remove_stored)
