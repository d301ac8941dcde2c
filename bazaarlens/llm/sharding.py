"""K-d tree sharding by bytes, in DataFrame functions only."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

__all__ = ["kd_shards", "Split", "kd_tree", "with_slots"]

VALUE_BITS, TIE_BITS, STEP = 26, 24, 10   # a key: scaled value, then a hash that orders equal values
STEPS = (VALUE_BITS + TIE_BITS) // STEP
DIMS = ["length", "language", "origin", "position"]
PIECE = 16            # a group of equal texts above 1 / PIECE of a shard is split
ROWS_PER_SLOT_GROUP = 50_000


@dataclass
class Split:
    """A node of the tree: an inner one sends keys of ``dim`` up to ``cut`` left; a leaf is a shard."""

    shards: int
    first: int
    dim: int = -1
    cut: int = -1
    left: Split | None = None
    right: Split | None = None


def _hash_bits(*cols, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - bits)


def _scaled(c: Column, lo: float, hi: float) -> Column:
    """A number as VALUE_BITS bits of its range; null is 0."""
    top = (1 << VALUE_BITS) - 1
    return F.coalesce(((c - lo) / max(hi - lo, 1e-9) * top).cast("long"), F.lit(0)).cast("long")


def _node(tree: Split, ids: dict[int, int]) -> Column:
    """The number of the open node an item falls in; null when it is in a leaf of one shard."""
    if tree.left is None:
        return F.lit(ids.get(id(tree))).cast("int")
    return F.when(F.col(f"k{tree.dim}") <= F.lit(tree.cut), _node(tree.left, ids)).otherwise(_node(tree.right, ids))


def _leaf(tree: Split) -> Column:
    if tree.left is None:
        return F.lit(tree.first)
    return F.when(F.col(f"k{tree.dim}") <= F.lit(tree.cut), _leaf(tree.left)).otherwise(_leaf(tree.right))


def kd_tree(items: DataFrame, shards: int) -> Split:
    """The tree over items (weight, k0..k3). Each level takes one job for the widest dimensions and up to STEPS for
    the weighted medians of all its nodes; what comes back is at most shards * 2^STEP histogram rows, whatever the input."""
    root = Split(shards, 0)
    level = [root] if shards > 1 else []
    while level:
        ids = {id(n): i for i, n in enumerate(level)}
        at = items.withColumn("node", _node(root, ids)).where("node is not null")
        extent = [e for k in range(len(DIMS)) for e in (F.min(f"k{k}").alias(f"lo{k}"), F.max(f"k{k}").alias(f"hi{k}"))]
        seen = {r["node"]: r for r in at.groupBy("node").agg(F.sum("weight").alias("w"), *extent).collect()}
        goal, below, prefix = {}, {}, {}
        for i, n in enumerate(level):
            r = seen.get(i)
            n.dim = 0 if r is None else max(range(len(DIMS)), key=lambda k: ((r[f"hi{k}"] >> TIE_BITS) - (r[f"lo{k}"] >> TIE_BITS), -k))
            goal[i] = 0.0 if r is None else r["w"] * (n.shards // 2) / n.shards
            below[i], prefix[i] = 0, 0
        key = F.coalesce(*[F.when(F.col("node") == i, F.col(f"k{n.dim}")) for i, n in enumerate(level)])
        for step in range(STEPS):
            rest = (STEPS - 1 - step) * STEP
            inside = at.withColumn("key", key)
            if step:
                held = F.coalesce(*[F.when(F.col("node") == i, F.lit(p)) for i, p in prefix.items()])
                inside = inside.where(F.shiftright("key", rest + STEP) == held)
            bins = defaultdict(list)
            for r in inside.groupBy("node", F.shiftright("key", rest).alias("bin")).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect():
                bins[r["node"]].append((r["bin"], r["w"], r["n"]))
            edge = {}
            for i in range(len(level)):
                acc, found = below[i], (prefix[i] << STEP, 0, 0)
                for b, w, cnt in sorted(bins.get(i, [])):
                    found = (b, w, cnt)
                    if acc + w >= goal[i]:
                        break
                    acc += w
                prefix[i], below[i], edge[i] = found[0], acc, found
            if rest == 0 or all(cnt <= 1 for _, _, cnt in edge.values()):
                break
        for i in range(len(level)):  # what lies across the median goes where the halves come out closer
            if below[i] + edge[i][1] - goal[i] > goal[i] - below[i]:
                prefix[i] -= 1
        nxt = []
        for i, n in enumerate(level):
            n.cut = ((prefix[i] + 1) << rest) - 1
            half = n.shards // 2
            n.left, n.right = Split(half, n.first), Split(n.shards - half, n.first + half)
            nxt += [c for c in (n.left, n.right) if c.shards > 1]
        level = nxt
    return root


def kd_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row.

    A k-d tree over metadata (log size, language, source, smallest doc_id of equal texts): a node that owns s shards is
    cut at the weighted median (share s//2 of s) of its widest dimension until a leaf owns one shard. Equal texts are
    one item and stay together unless they outweigh 1/16 of a shard; such groups are cut by the hash of a stored row number,
    so rows that repeat in id and text, or have no id, are cut like others.

    Size is the UTF-8 bytes of the text (null: none) plus 16. Null metadata sorts first. Rows equal in all columns get
    slots of their own. Only the named columns are read, so clashing extra columns do no harm; a missing metadata column
    counts as null. An empty table gives an empty result.
    """
    spare = {c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string") for c in (lang_col, source_col)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"), F.monotonically_increasing_id().alias("row"), spare[lang_col].alias("lang"), spare[source_col].alias("source")))
    total = rows.agg(F.sum("size").alias("w"), F.max("size").alias("m"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"),
                     F.max("doc_id").alias("hi"), F.log(F.min("size")).alias("l0"), F.log(F.max("size")).alias("l1")).first()
    limit = max((total["w"] or 0) / shards / PIECE, total["m"] or 0, 1)
    # at most shards * PIECE groups weigh more than the limit
    heavy = rows.groupBy("text_key").agg(F.sum("size").alias("w")).where(F.col("w") > limit).select(
        "text_key", F.ceil(F.col("w") / limit * 2).alias("parts"))
    keyed = stage(rows.join(F.broadcast(heavy), "text_key", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))).drop("parts"))
    grouped = keyed.groupBy("text_key", "part").agg(
        F.sum("size").alias("weight"), F.max("size").alias("size"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("doc_id").alias("doc_id"))
    tie = _hash_bits("text_key", "part", bits=TIE_BITS)
    values = [_scaled(F.log("size"), total["l0"] or 0.0, total["l1"] or 1.0), F.when(F.col("lang").isNotNull(), _hash_bits("lang", bits=VALUE_BITS)).otherwise(0),
              F.when(F.col("source").isNotNull(), _hash_bits("source", bits=VALUE_BITS)).otherwise(0), _scaled(F.col("doc_id").cast("double"), float(total["lo"] or 0), float(total["hi"] or 1))]
    items = stage(grouped.select("text_key", "part", "weight", *[(F.shiftleft(v.cast("long"), TIE_BITS) + tie).alias(f"k{k}") for k, v in enumerate(values)]))
    tree = kd_tree(items, shards)
    groups = max(16, -(-total["n"] // shards // ROWS_PER_SLOT_GROUP))
    placed = items.select("text_key", "part", _leaf(tree).cast("int").alias("shard"))
    owned = stage(keyed.join(placed, ["text_key", "part"]).select("doc_id", "size", "text_crc32", "shard", "row", F.pmod(
        F.xxhash64("row"), F.lit(groups)).cast("int").alias("sub")))
    return with_slots(owned).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(owned: DataFrame) -> DataFrame:
    """slot: gapless from 0 in each shard, numbered within the shard's hash groups (sub) plus what comes before them."""
    w = Window.partitionBy("shard").orderBy("sub")
    before = owned.groupBy("shard", "sub").count().select("shard", "sub", (F.sum("count").over(w) - F.col("count")).alias("before"))
    own = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size", "row")
    ranked = owned.withColumn("rank", F.row_number().over(own) - 1)
    return ranked.join(before, ["shard", "sub"]).withColumn("slot", (F.col("rank") + F.col("before")).cast("long")).drop("rank", "before")
