"""Trend tests and mean change points, many keys at once.

A calendar series has one point per period, so a key never holds more rows than the calendar has periods whatever the size
of the fact tables behind it. ``mann_kendall_long`` is for series of events, which grow with the facts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mk_min_p, two_sided_p
from ..params import ALPHA, MAX_BREAKS, MIN_SEGMENT
from ..sources.recovery import cut_lineage
from .ordering import ordered_totals

__all__ = ["mann_kendall", "mann_kendall_long", "log_slope", "change_points", "segment_report"]


def mann_kendall(df: DataFrame, keys: list[str], t: str, y: str, alpha: float = ALPHA) -> DataFrame:
    """Mann-Kendall per key: S, tie-corrected variance, continuity-corrected z, tau, p and a label.

    Labels: increasing, decreasing, no trend, insufficient (n too small to ever reach the
    level), too few (fewer than 4 points). NaN points are dropped.
    """
    pts = df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    g = pts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(t).alias("t"), (F.col(y).cast("double") + 0.0).alias("y")))).alias("_s"))   # -0.0 ties with 0.0
    g = g.withColumn("_y", F.transform("_s", lambda p: p["y"])).withColumn("n", F.size("_y"))
    y_ = F.col("_y")
    s = F.when(F.col("n") >= 2, F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), F.lit(0.0),
        lambda acc, i: acc + F.aggregate(F.slice(y_, i + 1, F.size(y_) - i), F.lit(0.0),
                                         lambda a, v: a + F.signum(v - F.get(y_, i - 1)))))
    def tie_term(a, v):
        c = F.size(F.filter(y_, lambda x: x == v)).cast("double")
        return a + c * (c - 1) * (2 * c + 5)
    g = g.withColumns({"s": s, "_ties": F.aggregate(F.array_distinct(y_), F.lit(0.0), tie_term)})
    return _tested(g, keys, alpha)


def _tested(g: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """The test's columns from n, s and the tie term."""
    n = F.col("n").cast("double")
    var = (n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18
    enough = F.col("n") >= 4
    g = g.withColumns({
        "s": F.when(enough, F.col("s")),
        "z": F.when(enough, F.when(var <= 0, F.lit(0.0)).otherwise(
            (F.col("s") - F.signum("s")) / F.sqrt(F.greatest(var, F.lit(1e-300))))),
        "tau": F.when(enough, F.col("s") / (n * (n - 1) / 2)),
        "min_p": mk_min_p(F.col("n"))})
    g = g.withColumn("p_value", two_sided_p(F.col("z")))
    g = g.withColumn("can_detect", F.coalesce(F.col("min_p") < alpha, F.lit(False)))
    label = (F.when(~enough, F.lit("too few"))
             .when(F.col("p_value") < alpha, F.when(F.col("z") > 0, "increasing").otherwise("decreasing"))
             .when(~F.col("can_detect"), F.lit("insufficient")).otherwise(F.lit("no trend")))
    return g.withColumn("trend", label).select(*keys, "n", "s", "z", "tau", "p_value", "min_p",
                                               "can_detect", "trend")


BLOCK_BITS = 10   # points of a block whose pairs are compared in one task: 2 ** 10


def _signs(y: pa.Array) -> pa.Array:
    """Of each list, the pairs that rise less those that fall."""
    out = []
    for values in y:
        v = np.asarray(values.values.to_numpy(zero_copy_only=False), dtype=float)
        out.append(int(sum(np.sign(v[i + 1:] - v[i]).sum() for i in range(len(v) - 1))))
    return pa.array(out, pa.int64())


def mann_kendall_long(df: DataFrame, keys: list[str], t: str, y: str, alpha: float = ALPHA) -> DataFrame:
    """mann_kendall for series of any length: n log n work, no series in one task. Times are numbers and differ within a key.

    Points are numbered by time. Two numbers first differ in some bit; of a pair, the one without the bit is earlier. So for
    each bit from BLOCK_BITS on, the points that agree above it are two runs, and the pairs across them are counted by
    adding up the earlier run along the values, as sorted runs are merged. What differs in lower bits only lies in one
    block and is compared there. Rows with a null or NaN value drop out, as do those without a time.
    """
    pts = df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")) & F.col(t).isNotNull())
    pts = pts.select(*keys, F.col(t).cast("double").alias("_t"), (F.col(y).cast("double") + 0.0).alias("_y"))
    placed = cut_lineage(ordered_totals(pts, "_t", {"_i": F.lit(1)}, keys).select(*keys, "_y", F.col("_i_before").cast("long").alias("_i")))
    same = placed.groupBy(*keys, "_y").agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c").cast("double")
    size = same.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(c * (c - 1) * (2 * c + 5)).alias("_ties"))
    block = F.shiftright("_i", BLOCK_BITS)
    lists = placed.groupBy(*keys, block.alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_i", "_y"))).alias("_p"))
    parts = lists.select(*keys, F.arrow_udf(_signs, "long")(F.col("_p._y")).alias("_s"))
    most = placed.agg(F.max("_i")).first()[0] or 0
    levels = list(range(BLOCK_BITS, int(most).bit_length()))
    if levels:
        bit = placed.withColumn("_bit", F.explode(F.array(*[F.lit(b) for b in levels])))
        bit = bit.select(*keys, "_y", "_bit", F.expr("shiftright(_i, _bit + 1)").alias("_run"), F.expr("shiftright(_i, _bit) & 1").alias("_late"))
        runs = bit.groupBy(*keys, "_bit", "_run", "_y").agg(F.sum(1 - F.col("_late")).alias("_l"), F.sum("_late").alias("_r"))
        group = [*keys, "_bit", "_run"]
        runs = cut_lineage(runs)
        all_left = runs.groupBy(*group).agg(F.sum("_l").alias("_all"))
        below = ordered_totals(runs, "_y", {"_less": F.col("_l")}, group).join(all_left, group)
        rise = F.col("_less_before") - (F.col("_all") - F.col("_less_before") - F.col("_l"))
        parts = parts.unionByName(below.select(*keys, (F.col("_r") * rise).cast("long").alias("_s")))
    s = parts.groupBy(*keys).agg(F.sum("_s").cast("double").alias("s"))
    return _tested(size.join(s, keys).withColumn("n", F.col("n").cast("int")), keys, alpha)


def log_slope(df: DataFrame, keys: list[str], t: str, y: str, out: str = "slope_log") -> DataFrame:
    """OLS slope of ln(y) on 0..k-1 over the positive values; fewer than 3 give NULL."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(t)
    pos = (df.where(F.col(y) > 0).withColumn("_x", F.row_number().over(w).cast("double"))
           .withColumn("_ly", F.log(F.col(y).cast("double"))))
    return pos.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, F.regr_slope("_ly", "_x")).alias(out))


def change_points(df: DataFrame, keys: list[str], t: str, y: str, min_size: int = MIN_SEGMENT,
                  max_breaks: int = MAX_BREAKS) -> DataFrame:
    """Mean change points by binary segmentation with a BIC penalty.

    Adds ``idx``, ``breakpoint_flag`` and ``segment_id`` to each point. Every round scores all
    cuts of all current segments of all keys from prefix sums, and cuts each key once at its
    best cut. All windows share the key's partitioning, so the rounds add no shuffle.
    """
    by_key = Window.partitionBy(*(keys or [F.lit(0)]))
    ordered = by_key.orderBy(t)
    base = df.withColumns({"_y": F.col(y).cast("double"), "idx": F.row_number().over(ordered) - 1})
    base = base.withColumns({"_n": F.count(F.lit(1)).over(by_key), "_mean": F.avg("_y").over(by_key),
                             "_range": F.max("_y").over(by_key) - F.min("_y").over(by_key)})
    base = base.withColumn("_c", F.col("_y") - F.col("_mean"))
    base = base.withColumn("_var", F.sum(F.col("_c") * F.col("_c")).over(by_key) / F.col("_n"))
    live = ((F.col("_n") >= 2 * min_size) & (F.col("_var") > 0)
            & (F.col("_range") > 1e-12 * F.greatest(F.lit(1.0), F.abs("_mean"))))
    out = base.withColumns({"_live": live, "_seg": F.lit(0), "breakpoint_flag": F.lit(0)})
    for round_no in range(1, max_breaks + 1):
        seg = Window.partitionBy(*(keys or [F.lit(0)]), "_seg")
        run = seg.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({
            "_k": F.count(F.lit(1)).over(run), "_m": F.count(F.lit(1)).over(seg),
            "_s": F.coalesce(F.sum("_c").over(run), F.lit(0.0)), "_t": F.sum("_c").over(seg)})
        k, m, s, tot = (F.col(c) for c in ("_k", "_m", "_s", "_t"))
        gain = s * s / k + (tot - s) * (tot - s) / (m - k) - tot * tot / m
        ok = F.col("_live") & (k >= min_size) & (m - k >= min_size)
        cand = F.when(ok, F.struct(gain.alias("gain"), (-F.col("_seg")).alias("a"), (-F.col("idx")).alias("b")))
        out = out.withColumn("_best", F.max(cand).over(by_key))
        take = F.coalesce((F.col("_best.gain") > 0)
                          & (F.col("_best.gain") > F.col("_var") * F.log(F.col("_n"))), F.lit(False))
        cut_seg, cut_at = -F.col("_best.a"), -F.col("_best.b")
        hit = take & (F.col("_seg") == cut_seg)
        out = out.withColumns({
            "breakpoint_flag": F.when(hit & (F.col("idx") == cut_at), 1).otherwise(F.col("breakpoint_flag")),
            "_live": take,
            "_seg": F.when(hit, F.when(F.col("idx") < cut_at, 2 * round_no).otherwise(2 * round_no + 1))
                     .otherwise(F.col("_seg"))})
    seg_no = F.sum("breakpoint_flag").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (out.withColumn("segment_id", seg_no)
            .select(*df.columns, "idx", "breakpoint_flag", "segment_id"))


def segment_report(points: DataFrame, keys: list[str], t: str, y: str, alpha: float = ALPHA) -> DataFrame:
    """Trend test, slope, growth and a power warning per segment."""
    by = keys + ["segment_id"]
    points = cut_lineage(points)  # short series, read three times
    span = points.groupBy(*by).agg(F.min(t).alias("from_t"), F.max(t).alias("to_t"),
                                   F.min_by(y, t).alias("first_value"), F.max_by(y, t).alias("last_value"),
                                   F.count(F.lit(1)).alias("points"))
    return (span.join(mann_kendall(points, by, t, y, alpha), by, "left")
            .join(log_slope(points, by, t, y), by, "left")
            .withColumn("growth_pct", (F.exp("slope_log") - 1) * 100)
            .withColumn("power_warning", ~F.col("can_detect") & (F.col("points") >= 4)))
