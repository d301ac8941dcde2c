"""Tables published by version: a manifest, written last, names the folders that make up the table.

A writer puts its rows into folders of its own, then renames a finished manifest into its place. Readers take the newest
manifest, so they see the old version whole until then and the new one whole after it; a job that dies before leaves
folders that no manifest names. Two writers at once: the second finds its number taken and raises FileExistsError, the
table keeps the first one's rows. The rename must not replace a file that exists, as on HDFS; object stores without such
a rename need one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nan_to_null
from .writers import _files, _partitions, update_columns

__all__ = ["publish", "published", "publish_update", "published_versions", "prune"]

_BATCH = "written_in"     # the partition level that holds one write's folders; readers drop it


def _manifests(spark: SparkSession, target: str):
    fs, path = _files(spark, target)
    folder = f"{target.rstrip('/')}/_manifests"
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []
    return fs, path, folder, sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def published_versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the published versions that are still there, oldest first; none for a table never published."""
    return _manifests(spark, target)[3]


def _read(spark: SparkSession, target: str, version: int | None) -> dict | None:
    fs, path, folder, numbers = _manifests(spark, target)
    if version is None:
        version = numbers[-1] if numbers else None
    if version is None:
        return None
    if version not in numbers:
        raise ValueError(f"{target} has no version {version}")
    stream = fs.open(path(f"{folder}/v{version:012d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, target: str, version: int, manifest: dict) -> None:
    fs, path, folder, _ = _manifests(spark, target)
    fs.mkdirs(path(folder))
    draft = path(f"{folder}/draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(manifest), "utf-8"))
    finally:
        out.close()
    final = path(f"{folder}/v{version:012d}.json")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(final), none)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise FileExistsError(f"version {version} of {target} was published meanwhile") from e
        raise


def publish(df: DataFrame, target: str, mode: str = "replace", partition_cols: list[str] | None = None,
            keep_old_when_empty: bool = True) -> int:
    """Write ``df`` as the table's next version and return its number.

    ``replace`` takes the place of all rows, ``append`` adds to them, ``partitions`` replaces the partitions that ``df`` has
    rows for and leaves the others. The last two need the stored columns, types and partitioning (ValueError); on a table
    never published they write its first version. ``df`` may read from the table. NaN is stored as NULL. An empty ``df``
    publishes nothing in any mode unless ``replace`` is told not to keep the old rows; the number is then that of the last version,
    0 if there is none. Null partition values are a partition. Repeated rows stay.
    """
    if mode not in ("replace", "append", "partitions"):
        raise ValueError(f"unknown mode {mode}")
    if _BATCH in df.columns:
        raise ValueError(f"a column may not be called {_BATCH}")
    spark = df.sparkSession
    numbers = published_versions(spark, target)
    last = numbers[-1] if numbers else 0
    old = _read(spark, target, last) if numbers else None
    keep = old is not None and mode != "replace"
    cols = list(partition_cols) if partition_cols else (old["partitioned_by"] if keep else [])
    if mode == "partitions" and not cols:
        raise ValueError("no partition columns")
    df = nan_to_null(df)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    if keep:
        want = T.StructType.fromJson(old["schema"])
        if cols != old["partitioned_by"] or schema.names != want.names or [f.dataType for f in schema] != [f.dataType for f in want]:
            raise ValueError(f"{target} has other columns, types or partitions: {want.simpleString()} by {old['partitioned_by']}")
    if df.isEmpty() and (keep_old_when_empty or mode != "replace"):
        return last
    batch = f"{_BATCH}=w{uuid.uuid4().hex}"
    root = f"{target.rstrip('/')}/{batch}"
    (df.write.partitionBy(*cols) if cols else df.write).parquet(root)
    fs, path = _files(spark, target)
    fresh = [[batch, part] for part in _partitions(fs, path(root), len(cols))] if cols else [[batch, ""]]
    stay = old["folders"] if keep else []
    if mode == "partitions":
        gone = {part for _, part in fresh}
        stay = [f for f in stay if f[1] not in gone]
    _commit(spark, target, last + 1, {"schema": schema.jsonValue(), "partitioned_by": cols, "folders": stay + fresh})
    return last + 1


def published(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest if none is named. Filters on partition columns prune folders.

    ValueError where the table or the version does not exist.
    """
    m = _read(spark, target, version)
    if m is None:
        raise ValueError(f"{target} was never published")
    schema = T.StructType.fromJson(m["schema"])
    if not m["folders"]:
        return spark.createDataFrame([], schema)
    root = target.rstrip("/")
    rows = spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{batch}/{part}".rstrip("/") for batch, part in m["folders"]])
    return rows.select(*[F.col(f"`{c}`") for c in schema.names])


def publish_update(spark: SparkSession, updates: DataFrame, target: str, key: str, cols: list[str]) -> int:
    """Publish the table with ``cols`` taken from ``updates`` where the key matches (see update_columns); nothing is inserted."""
    by = (_read(spark, target, None) or {}).get("partitioned_by")
    return publish(update_columns(published(spark, target), updates, key, cols), target, "replace", by)


def prune(spark: SparkSession, target: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` (at least one) versions and the folders that only they name. Returns their numbers.

    Folders of a write under way are in no manifest and stay, as do those of jobs that died.
    """
    fs, path, folder, numbers = _manifests(spark, target)
    cut = len(numbers) - max(1, keep)
    gone, left = numbers[:max(0, cut)], numbers[max(0, cut):]
    used = {tuple(f) for n in left for f in _read(spark, target, n)["folders"]}
    named = {tuple(f) for n in gone for f in _read(spark, target, n)["folders"]}
    for n in gone:      # manifests first: no reader may find one whose folders are gone
        fs.delete(path(f"{folder}/v{n:012d}.json"), False)
    for batch, part in named - used:
        fs.delete(path(f"{target.rstrip('/')}/{batch}/{part}".rstrip("/")), True)
    return gone
