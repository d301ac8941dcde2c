"""Result tables: append, idempotent replace, partial replace, keyed update, contracts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nan_to_null

__all__ = ["write", "replace", "keyed_update", "check_contract", "union_branches", "stored_count",
           "update_columns"]

_MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}


def write(df: DataFrame, target: str, mode: str = "append") -> int:
    """Plain write (append does not remove duplicates). Returns the rows now stored."""
    nan_to_null(df).write.mode(_MODES[mode]).parquet(target)
    return stored_count(df.sparkSession, target)


def replace(df: DataFrame, target: str, partition_cols: list[str] | None = None,
            keep_old_when_empty: bool = True) -> int:
    """Idempotent write: running twice stores the rows once.

    The rows are written beside the target and then moved in, so a failed job leaves the target as it was and ``df`` may
    read from the target.

    With ``partition_cols`` only the partitions present in ``df`` are replaced. An empty
    frame leaves the stored rows alone unless ``keep_old_when_empty`` is False.
    """
    if keep_old_when_empty and df.isEmpty():
        return 0
    spark = df.sparkSession
    beside = f"{target.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    w = nan_to_null(df).write
    (w.partitionBy(*partition_cols) if partition_cols else w).parquet(beside)
    fs, path = _files(spark, target)
    if partition_cols and fs.exists(path(target)):
        for folder in _partitions(fs, path(beside), len(partition_cols)):
            _swap(fs, path, f"{beside}/{folder}", f"{target.rstrip('/')}/{folder}")
        fs.delete(path(beside), True)
    else:
        _swap(fs, path, beside, target)
    return stored_count(spark, target)


def _files(spark: SparkSession, target: str):
    """The target's file system and its path constructor."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _partitions(fs, root, depth: int) -> list[str]:
    """Partition folders below root as relative names; as many as the write made."""
    level = [""]
    for _ in range(depth):
        level = [f"{p}/{s.getPath().getName()}".strip("/") for p in level
                 for s in fs.listStatus(root.suffix(f"/{p}") if p else root) if s.isDirectory()]
    return level


def _swap(fs, path, fresh: str, target: str) -> None:
    """Put ``fresh`` in the place of ``target``; the old files go last."""
    old = f"{target.rstrip('/')}-old-{uuid.uuid4().hex[:8]}"
    if fs.exists(path(target)):
        fs.rename(path(target), path(old))
    else:
        fs.mkdirs(path(target).getParent())
    if not fs.rename(path(fresh), path(target)):
        raise OSError(f"cannot move {fresh} to {target}")
    fs.delete(path(old), True)


def update_columns(target: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows of ``target`` with ``cols`` taken from ``updates`` where the key matches.

    Never inserts or multiplies rows: a key given twice in ``updates`` raises ValueError. Rows without a match keep their
    old values; a matched NULL is written.
    """
    twice = updates.groupBy(key).count().where("count > 1").select(key).limit(5).collect()
    if twice:
        raise ValueError(f"update keys are not unique: {[r[0] for r in twice]}")
    u = updates.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"),
                       *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = target.join(u, target[key].eqNullSafe(F.col("_k")), "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(target[c]).alias(c) if c in cols
        else target[c] for c in target.columns])


def keyed_update(spark: SparkSession, updates: DataFrame, path: str, key: str, cols: list[str]) -> str:
    """Write the updated table beside the old one and return the new path to switch to."""
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    nan_to_null(update_columns(spark.read.parquet(path), updates, key, cols)).write.parquet(fresh)
    return fresh


_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_DIGITS = dict(zip(_WHOLE, (3, 5, 10, 19)))


def _fits(have: T.DataType, want: T.DataType) -> bool:
    """Whether every value of ``have`` is a value of ``want``."""
    a, b = type(have), type(want)
    if have == want or a is T.NullType:
        return True
    if a in _WHOLE:
        return (b in _WHOLE and _WHOLE.index(a) <= _WHOLE.index(b)) or (b is T.DoubleType and a is not T.LongType) or (
            b is T.DecimalType and want.precision - want.scale >= _DIGITS[a])
    if a is T.DecimalType and b is T.DecimalType:
        return want.scale >= have.scale and want.precision - want.scale >= have.precision - have.scale
    return a is T.FloatType and b is T.DoubleType


def check_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Column count, names and order must equal the declared ones before a write, and each type must fit the declared one
    without loss (the same, or a widening of numbers)."""
    got, want = df.columns, schema.names
    if got != want:
        raise ValueError(f"columns differ from the target: {got} vs {want}")
    narrow = [f"{f.name}: {g.dataType.simpleString()} to {f.dataType.simpleString()}"
              for g, f in zip(df.schema.fields, schema.fields) if not _fits(g.dataType, f.dataType)]
    if narrow:
        raise ValueError(f"types do not fit the target: {narrow}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def union_branches(*frames: DataFrame) -> DataFrame:
    """Union by name; all branches must have the same columns."""
    names = sorted(frames[0].columns)
    for f in frames[1:]:
        if sorted(f.columns) != names:
            raise ValueError(f"union branches differ: {names} vs {sorted(f.columns)}")
    return reduce(lambda a, b: a.unionByName(b), frames)


def stored_count(spark: SparkSession, target: str) -> int:
    return spark.read.parquet(target).count()
