"""Exact dedup: two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, small_enough, stage

__all__ = ["normalised", "digests", "repeated_bits", "exact_dedup"]

BITS = 64            # bits of a filter block: one long
BROADCAST_ROWS = 400_000  # blocks of 16 bytes; beyond it the digests are shuffled to the filter


def normalised(text: str | Column = "text") -> Column:
    """The text without white space; null is the empty text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per row of docs: doc_id, sha (of the normalised text), chars (of the original)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col).cast("binary"), 256).alias("sha"),
                       F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"))


def _places(rows: DataFrame, blocks: int) -> DataFrame:
    h, g = F.xxhash64("sha"), F.xxhash64(F.lit(7), "sha")
    first = F.pmod(g, F.lit(BITS))
    second = F.pmod(first + 1 + F.pmod(F.shiftright(g, 8), F.lit(BITS - 1)), F.lit(BITS))
    return rows.withColumns({"block": F.pmod(h, F.lit(blocks)), "bit1": first.cast("int"), "bit2": second.cast("int")})


def repeated_bits(placed: DataFrame) -> DataFrame:
    """Pass one: (block, mask) of filter bits that two rows or more set. Unrepeated bits leave no row."""
    set_bits = placed.select("block", F.explode(F.array("bit1", "bit2")).alias("bit"))
    twice = set_bits.groupBy("block", "bit").count().where("count > 1")
    one = F.expr("shiftleft(1L, bit)")
    return twice.groupBy("block").agg(F.bit_or(one).alias("mask"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when identical without white space. Of equal texts the row with the most code points stays, then
    the smallest doc_id. The first pass counts the bits that the digests set in a Bloom filter sized by the row count;
    the second passes rows whose bits were set only once straight through. Only possibly repeated digests are shuffled
    and compared whole, so a false positive of the filter costs a shuffled row and changes nothing.

    Null text counts as empty. A null doc_id sorts after all others. Rows that agree in doc_id and text share one
    verdict. Other columns of docs are not carried, so their names cannot clash. An empty table gives an empty result.
    """
    rows = stage(digests(docs, id_col, text_col))
    blocks = max(1, rows.count())
    placed = _places(rows, blocks)
    bits = stage(repeated_bits(placed))
    if small_enough(bits, BROADCAST_ROWS):
        bits = F.broadcast(bits)
    flagged = placed.join(bits, "block", "left").withColumn(
        "again", F.coalesce(F.expr("getbit(mask, bit1) = 1 AND getbit(mask, bit2) = 1"), F.lit(False)))
    alone = flagged.where("not again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"))
    again = flagged.where("again").select("doc_id", "sha", "chars")
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d")))
    groups = stage(again.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))
    settled = again.join(groups, "sha").select(
        "doc_id", F.col("best.d").alias("keep_id"), "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.d")) & (F.col("chars") == -F.col("best.c"))).alias("kept"),
        F.col("sha").alias("text_sha256"))
    return alone.unionByName(settled)
