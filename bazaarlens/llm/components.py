"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_enough, stage

__all__ = ["connected_components", "looked_up"]

BROADCAST_ROWS = 200_000   # of two longs


def looked_up(df: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """df with key replaced by the value of a stored (key, value) table where it has one. A small table is broadcast."""
    t = table.select(F.col(table.columns[0]).alias("__k"), F.col(value).alias("__v"))
    if small_enough(table, BROADCAST_ROWS):
        t = F.broadcast(t)
    return df.join(t, df[key] == t["__k"], "left").withColumn(key, F.coalesce("__v", key)).drop("__k", "__v")


def _roots(hooks: DataFrame) -> DataFrame:
    """Follow (id, to), which never runs in a circle, to its ends; the distance halves each time."""
    while True:
        further = hooks.select(F.col("id").alias("__k"), F.col("to").alias("__v"))
        joined = hooks.join(F.broadcast(further) if small_enough(hooks, BROADCAST_ROWS) else further, F.col("to") == F.col("__k"), "left")
        step = stage(joined.select("id", F.coalesce("__v", "to").alias("to"), F.col("__v").isNotNull().alias("moved")))
        hooks = step.select("id", "to")
        if step.where("moved").isEmpty():
            return hooks


def connected_components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in links (a, b); comp is one id of the component.

    Each round hooks every component to its smallest neighbour, follows the hooks to their ends and contracts the links,
    so links shrink fast and a long chain needs few rounds. All steps are aggregations and joins over links.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = stage(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("comp", F.col("id")))
    while not edges.isEmpty():
        hooks = stage(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")))
        roots = _roots(hooks)
        labels = stage(looked_up(labels, "comp", roots, "to"))
        moved = looked_up(looked_up(edges, "a", roots, "to"), "b", roots, "to")
        edges = stage(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
