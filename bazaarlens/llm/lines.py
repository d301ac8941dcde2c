"""Line dedup: overlapping windows of consecutive lines, repeated windows removed after their first place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

__all__ = ["WINDOW", "line_windows", "repeated_lines", "dedup_lines"]

WINDOW = 3


def _name(id_col: str, text_col: str) -> list[Column]:
    """A row's name and global order: id (nulls last), then two hashes that tell rows with one id apart."""
    return [F.col(id_col).isNull().alias("r0"), F.col(id_col).alias("r1"), F.xxhash64(F.lit(11), text_col).alias("r2"), F.xxhash64(F.lit(29), text_col).alias("r3")]


NAME = ["r0", "r1", "r2", "r3"]


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")


def line_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every run of ``window`` lines with a word, lines without one in between skipped: r0..r3, at (line numbers), d0, d1
    (two digests of the lines, trimmed and with white space made one space)."""
    tidy = F.transform(_lines(text_col), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    rows = docs.select(*_name(id_col, text_col), tidy.alias("line"))
    rows = rows.withColumn("full", F.filter(F.transform("line", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())).where(F.size("full") >= window)

    def digest(j: Column, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *[F.get("line", F.get("full", j + k)) for k in range(window)])

    made = F.transform(F.sequence(F.lit(0), F.size("full") - window), lambda j: F.struct(
        F.slice("full", j + 1, window).alias("at"), digest(j, 3).alias("d0"), digest(j, 5).alias("d1")))
    return rows.select(*NAME, F.inline(made))


def repeated_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """r0..r3 and gone: the numbers of the lines that later occurrences of a repeated window cover, for rows that have any."""
    windows = line_windows(docs, window, id_col, text_col)
    place = F.struct(*NAME, F.get("at", F.lit(0)).alias("line"))
    # the first places are stored, so that the join shuffles both sides and can split a window that is everywhere
    first = stage(windows.groupBy("d0", "d1").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    later = windows.join(first, ["d0", "d1"]).where(place != F.col("first"))
    return later.select(*NAME, "at").groupBy(NAME).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of text_col, and n_lines, n_removed added (columns of these names are replaced).

    Windows are ordered by doc_id (nulls last) and line; the first place of a window stays, every line that a later place
    covers goes. Lines without a word belong to no window and stay. Texts of fewer lines than a window, empty and null
    texts stay as they are. Rows that agree in id and text are one occurrence and come out alike. An empty table gives
    an empty result.
    """
    gone = repeated_lines(docs, window, id_col, text_col)
    names = {n: f"__{n}" for n in [*NAME, "gone"]}
    gone = gone.withColumnsRenamed(names)
    named = docs.withColumns({f"__o{i}": c for i, c in enumerate(_name(id_col, text_col))})
    same = F.lit(True)
    for i in range(4):
        same = same & (named[f"__o{i}"].eqNullSafe(gone[f"__r{i}"]))
    both = named.join(gone, same, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(_lines(text_col)) - 1), F.col("__gone"))
    cut = F.array_join(F.transform(left, lambda i: F.get(_lines(text_col), i)), "\n")
    hit = F.col("__gone").isNotNull()
    out = both.withColumns({"n_lines": F.size(_lines(text_col)).cast("long"), "n_removed": F.when(hit, F.size("__gone")).otherwise(0).cast("long"),
                            text_col: F.when(hit, cut).otherwise(F.col(text_col))})
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_removed") if c not in docs.columns])
