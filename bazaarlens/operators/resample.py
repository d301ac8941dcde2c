"""Block bootstraps built on sums per block.

Facts are aggregated to blocks (days, months) once, by Spark; replicates only ever see block
sums, so their cost does not grow with the fact tables. A draw is md5(seed | label | key |
replicate | position) mod blocks, which depends on nothing but its labels: any task can make
it again, so drawn weights are neither stored nor shuffled. Replicates of a key are numpy
sums inside a task and only (key, replicate) rows or finished intervals leave it.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ratio, two_sided_p
from ..params import ALPHA, B_DELIVERY, B_MATCHED, B_REVENUE, B_STRUCTURE, SEED
from ..sources.recovery import cut_lineage
from .decompose import REVENUE_FACTORS, lmdi

__all__ = ["percentile_ci", "excludes_zero", "replicate_sums", "bootstrap_states", "bootstrap_lmdi",
           "bootstrap_contrib", "block_mean_diff", "block_mean_diff_ci", "block_group_means",
           "bootstrap_means", "matched_effect"]

REPS_PER_TASK = 50
ROWS_PER_STEP = 1000
MAX_DAYS = 31


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def excludes_zero(lo, hi) -> Column:
    lo, hi = (F.col(c) if isinstance(c, str) else c for c in (lo, hi))
    return ((lo > 0) | (hi < 0)).cast("int")


def percentile_ci(reps: DataFrame, value: str, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """Percentile interval per key with linear interpolation; NaN and NULL replicates are ignored."""
    v = F.when(~F.isnan(value), F.col(value))
    g = reps.groupBy(*keys).agg(F.percentile(v, [alpha / 2, 1 - alpha / 2]).alias("_q"))
    return (g.select(*keys, F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("ci_high"))
            .withColumn("is_significant", excludes_zero("ci_low", "ci_high")))


def _draws(prefix: str, reps, n: int) -> np.ndarray:
    """Block positions 0..n-1 for each replicate: the 60-bit md5 rule of ``functions.draws``."""
    return np.array([[(int.from_bytes(md5(f"{prefix}|{r}|{j}".encode()).digest()[:8], "big") >> 4) % n
                      for j in range(1, n + 1)] for r in reps], dtype=np.int64).reshape(-1, n)


def _weights(prefix: str, b: int, n: int) -> np.ndarray:
    """(replicates, blocks) counts of how often each block was drawn."""
    idx = _draws(prefix, range(1, b + 1), n)
    return np.bincount((idx + np.arange(b)[:, None] * n).ravel(), minlength=b * n).reshape(b, n)


def replicate_sums(per: DataFrame, keys: list[str], block: str, sums: list[str], b: int, seed: int,
                   label: str, shared: bool = False) -> DataFrame:
    """(keys, rep, sums) of block bootstraps; ``per`` has one row per key and calendar block.

    ``shared`` gives all keys the same drawn positions. A key's blocks are packed in one row:
    they are calendar periods, so the row is bounded however large the facts were.
    """
    packed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(block).alias("_b"), *[F.col(c).cast("double").alias(c) for c in sums]))).alias("_a"))
    tag = F.lit("") if shared or not keys else F.concat(F.lit("|"), F.concat_ws("|", *[
        F.col(k).cast("string") for k in keys]))
    work = packed.select(*keys, tag.alias("_tag"), F.explode(F.sequence(F.lit(1), F.lit(b),
                         F.lit(REPS_PER_TASK))).alias("_from"),
                         *[F.col("_a").getField(c).alias(c) for c in sums])
    work = work.repartition(_partitions(per), *keys, "_from")
    schema = T.StructType([work.schema[k] for k in keys] + [T.StructField("rep", T.IntegerType())]
                          + [T.StructField(c, T.DoubleType()) for c in sums])

    def run(frames):
        for f in frames:
            for row in f.itertuples(index=False, name=None):
                rec = dict(zip(f.columns, row))
                n = len(rec[sums[0]])
                reps = range(rec["_from"], min(rec["_from"] + REPS_PER_TASK, b + 1))
                idx = _draws(f"{seed}|{label}{rec['_tag']}", reps, n)
                out = {k: [rec[k]] * len(reps) for k in keys}
                out["rep"] = np.array(reps, dtype=np.int32)
                for c in sums:
                    out[c] = np.asarray(rec[c], dtype=float)[idx].sum(axis=1)
                yield pd.DataFrame(out)

    return work.mapInPandas(run, schema)


def _day_slots(panel: DataFrame) -> DataFrame:
    """Number the days with data inside each month: (stat_month, d, slot, days)."""
    w = Window.partitionBy("stat_month").orderBy("d")
    return (panel.select("stat_month", "d").distinct()
            .withColumns({"slot": F.row_number().over(w),
                          "days": F.count(F.lit(1)).over(Window.partitionBy("stat_month"))}))


def bootstrap_states(daily: DataFrame, b: int = B_REVENUE, seed: int = SEED) -> DataFrame:
    """Monthly buyers, delivered orders and revenue of each replicate.

    Distinct buyers are exact: a buyer's active days of a month form a 31-bit mask, equal masks
    are counted once, and a replicate counts the masks that meet its drawn days. Each month is
    drawn once per replicate and serves as the current month of one pair and the previous month
    of the next, so the two months of a pair are always independent.
    """
    daily = cut_lineage(daily)
    slots = _day_slots(daily)
    per = daily.groupBy("stat_month", "d").agg(F.sum("delivered_cnt").alias("delivered_cnt"),
                                               F.sum("gmv").alias("gmv"))
    flows = replicate_sums(per, ["stat_month"], "d", ["delivered_cnt", "gmv"], b, seed, "month")
    masks = (daily.where(F.col("customer_unique_id").isNotNull()).join(slots, ["stat_month", "d"])
             .groupBy("stat_month", "customer_unique_id")
             .agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), slot - 1)")).alias("mask"),
                  F.max("days").alias("days"))
             .groupBy("stat_month", "mask", "days").agg(F.count(F.lit(1)).alias("n")))
    masks = masks.repartitionByRange(_partitions(daily), "stat_month", "mask")

    def meet(frames):
        drawn, total = {}, {}
        for f in frames:
            for (month, days), g in f.groupby(["stat_month", "days"]):
                if month not in drawn:
                    hit = _weights(f"{seed}|month|{month}", b, int(days)) > 0
                    drawn[month] = (hit * (1 << np.arange(int(days), dtype=np.int64))).sum(axis=1)
                    total[month] = np.zeros(b, dtype=np.int64)
                mask, n = g["mask"].to_numpy(np.int64), g["n"].to_numpy(np.int64)
                for i in range(0, len(mask), ROWS_PER_STEP):
                    both = (mask[i:i + ROWS_PER_STEP, None] & drawn[month][None, :]) != 0
                    total[month] += n[i:i + ROWS_PER_STEP] @ both
        for month, v in total.items():
            yield pd.DataFrame({"stat_month": [month] * b, "rep": np.arange(1, b + 1, dtype=np.int32), "buyers": v})

    buyers = (masks.mapInPandas(meet, "stat_month date, rep int, buyers long")
              .groupBy("stat_month", "rep").agg(F.sum("buyers").alias("buyers")))
    return flows.join(buyers, ["stat_month", "rep"], "left")


def bootstrap_lmdi(daily: DataFrame, pairs: DataFrame, b: int = B_REVENUE, seed: int = SEED,
                   alpha: float = ALPHA) -> DataFrame:
    """Intervals of the three revenue factors per month pair. Replicates with a quantity that
    is not positive are left out."""
    names = ("buyers", "delivered_cnt", "gmv")
    s = bootstrap_states(daily, b, seed)
    # both roles of a month in one pass: the replicate rows meet by (pair, replicate)
    role = (s.join(pairs.select(F.col("stat_month").alias("_m"), F.lit(1).alias("_now"), F.col("stat_month").alias("_pair"))
                   .unionByName(pairs.select(F.col("prev_month").alias("_m"), F.lit(0).alias("_now"),
                                             F.col("stat_month").alias("_pair"))),
                   F.col("stat_month") == F.col("_m")))
    j = role.groupBy(F.col("_pair").alias("stat_month"), "rep").agg(*[
        F.max(F.when(F.col("_now") == t, F.col(c).cast("double"))).alias(f"{c}_{t}") for c in names for t in (0, 1)])
    def factors(t):
        nb, d, v = (F.col(f"{c}_{t}") for c in names)
        return nb, F.try_divide(d, nb), F.try_divide(v, d)
    x0, x1 = factors(0), factors(1)
    ok = reduce(lambda p, q: p & q, [F.coalesce(F.col(f"{c}_{t}"), F.lit(0.0)) > 0 for c in names for t in (0, 1)])
    parts = lmdi(F.col("gmv_0"), F.col("gmv_1"), dict(zip(REVENUE_FACTORS, zip(x0, x1))))
    wide = j.where(ok).select("stat_month", "rep", (F.col("gmv_1") - F.col("gmv_0")).alias("delta_gmv"),
                              *[parts[f].alias(f) for f in REVENUE_FACTORS])
    q = wide.groupBy("stat_month").agg(
        *[F.percentile(f, [alpha / 2, 1 - alpha / 2]).alias(f) for f in REVENUE_FACTORS],
        F.max(F.abs(reduce(add, [F.col(f) for f in REVENUE_FACTORS]) - F.col("delta_gmv"))).alias("max_residual"))
    return (q.select("stat_month", "max_residual", F.inline(F.array(*[
        F.struct(F.lit(f).alias("factor"), F.get(f, F.lit(0)).alias("ci_low"), F.get(f, F.lit(1)).alias("ci_high"))
        for f in REVENUE_FACTORS])))
        .withColumn("is_significant", excludes_zero("ci_low", "ci_high")))


def bootstrap_contrib(daily_dim: DataFrame, pairs: DataFrame, b: int = B_STRUCTURE, seed: int = SEED,
                      alpha: float = ALPHA, label: str = "dim") -> DataFrame:
    """Interval of the growth contribution of each dimension value per month pair.

    A (month, value) row carries its day sums; the replicates of a row are two small matrix
    products, and only its interval leaves the task.
    """
    panel = cut_lineage(daily_dim.where(F.col("dim_value").isNotNull()).withColumn("gmv", F.col("gmv").cast("double")))
    slots = _day_slots(panel)
    keyed = panel.join(slots, ["stat_month", "d"])
    pack = F.array_sort(F.collect_list(F.struct("slot", "gmv")))
    by_dim = keyed.groupBy("stat_month", "dim_value", "days").agg(pack.alias("a"))
    total = (keyed.groupBy("stat_month", "slot").agg(F.sum("gmv").alias("gmv"))
             .groupBy("stat_month").agg(pack.alias("total"), F.max("slot").alias("days")))
    cells = "array<struct<slot:int,gmv:double>>"
    cur = by_dim.join(pairs, "stat_month").select("stat_month", "dim_value", F.col("a").cast(cells).alias("now"),
                                                  F.lit(None).cast(cells).alias("was"))
    old = (by_dim.withColumnRenamed("stat_month", "prev_month").join(pairs, "prev_month")
           .select("stat_month", "dim_value", F.lit(None).cast(cells).alias("now"), F.col("a").cast(cells).alias("was")))
    both = cur.unionByName(old).groupBy("stat_month", "dim_value").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    span = (pairs.join(total.select("stat_month", F.col("days").alias("days_now")), "stat_month")
            .join(total.select(F.col("stat_month").alias("prev_month"), F.col("days").alias("days_was"), "total"), "prev_month"))
    def dense(c):  # slot cells to a plain array of 31 doubles
        return F.transform(F.sequence(F.lit(1), F.lit(MAX_DAYS)), lambda i: F.aggregate(
            F.coalesce(F.col(c), F.array().cast(cells)), F.lit(0.0),
            lambda acc, x: acc + F.when(x["slot"] == i, x["gmv"]).otherwise(0.0)))
    rows = (both.join(span, "stat_month")
            .select("stat_month", "prev_month", "dim_value", "days_now", "days_was", dense("now").alias("now"),
                    dense("was").alias("was"), dense("total").alias("total"))
            .repartitionByRange(_partitions(daily_dim), "stat_month", "dim_value"))
    value_type = daily_dim.schema["dim_value"].dataType.simpleString()

    def run(frames):
        cache = {}

        def weights(month, days):
            if month not in cache:
                cache[month] = _weights(f"{seed}|{label}|{month}", b, int(days)).astype(float)
            return cache[month]

        for f in frames:
            for (m1, m0, n1, n0), g in f.groupby(["stat_month", "prev_month", "days_now", "days_was"]):
                w1, w0 = weights(m1, n1), weights(m0, n0)
                t0 = w0 @ np.asarray(g["total"].iloc[0], dtype=float)[:n0]
                for i in range(0, len(g), ROWS_PER_STEP):
                    part = g.iloc[i:i + ROWS_PER_STEP]
                    now = np.stack(part["now"].to_numpy())[:, :n1]
                    was = np.stack(part["was"].to_numpy())[:, :n0]
                    ok = t0 > 0
                    pp = (now @ w1[ok].T - was @ w0[ok].T) / t0[ok] * 100
                    lo, hi = np.quantile(pp, [alpha / 2, 1 - alpha / 2], axis=1) if ok.any() else \
                        np.full((2, len(part)), np.nan)
                    yield pd.DataFrame({"stat_month": [m1] * len(part), "dim_value": pd.Series(part["dim_value"].tolist(), dtype=object),
                                        "ci_low": lo, "ci_high": hi})

    out = rows.mapInPandas(run, f"stat_month date, dim_value {value_type}, ci_low double, ci_high double")
    return out.withColumn("is_significant", excludes_zero("ci_low", "ci_high"))


def block_mean_diff(df: DataFrame, block: str, group: str, value: str, b: int = B_DELIVERY,
                    seed: int = SEED, label: str = "diff") -> DataFrame:
    """Replicates of mean(value | group 1) - mean(value | group 0); both groups share the drawn
    blocks. A replicate without one of the groups gives NULL."""
    v = F.col(value).cast("double")
    per = df.where(F.col(value).isNotNull() & F.col(group).isin(0, 1)).groupBy(block).agg(*[
        a for g in (0, 1) for a in (F.count_if(F.col(group) == g).alias(f"n{g}"),
                                    F.coalesce(F.sum(F.when(F.col(group) == g, v)), F.lit(0.0)).alias(f"s{g}"))])
    r = replicate_sums(per, [], block, ["n0", "s0", "n1", "s1"], b, seed, label)
    return r.select("rep", (ratio(F.col("s1"), F.col("n1")) - ratio(F.col("s0"), F.col("n0"))).alias("diff"))


def block_mean_diff_ci(df: DataFrame, block: str, group: str, value: str, b: int = B_DELIVERY,
                       seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    return percentile_ci(block_mean_diff(df, block, group, value, b, seed), "diff", [], alpha)


def block_group_means(df: DataFrame, keys: list[str], block: str, value: str, b: int = B_DELIVERY,
                      seed: int = SEED, alpha: float = ALPHA, label: str = "mean") -> DataFrame:
    """Mean of ``value`` per key with an interval from that key's own blocks, keys drawn
    independently."""
    per = (df.where(F.col(value).isNotNull()).groupBy(*keys, block)
           .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("s")))
    per = cut_lineage(per)  # read for the means and for the replicates
    reps = replicate_sums(per, keys, block, ["n", "s"], b, seed, label).withColumn("m", ratio(F.col("s"), F.col("n")))
    point = per.groupBy(*keys).agg(F.sum("n").alias("n_orders"), (F.sum("s") / F.sum("n")).alias("mean_value"))
    return point.join(percentile_ci(reps, "m", keys, alpha), keys)


def bootstrap_means(rows: DataFrame, key: str, unit: str, value: str, b: int = B_STRUCTURE,
                    seed: int = SEED, alpha: float = ALPHA, label: str = "unit") -> DataFrame:
    """Interval of the mean of a short series per key, all keys sharing the drawn units."""
    per = rows.select(key, unit, F.col(value).alias("s"), F.lit(1).alias("n"))
    reps = replicate_sums(per, [key], unit, ["n", "s"], b, seed, label, shared=True)
    return percentile_ci(reps.withColumn("m", F.col("s") / F.col("n")), "m", [key], alpha)


def matched_effect(pairs: DataFrame, b: int = B_MATCHED, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """Average effect on the treated over matched pairs (columns y_t, y_c in 0/1), its bootstrap
    interval, and a normal p from the bootstrap spread.

    A pair difference is -1, 0 or 1, so resampling n pairs is one multinomial draw of the three
    counts: the exact same distribution at a cost that does not grow with the pairs.
    """
    d = F.col("y_t") - F.col("y_c")
    point = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("y_t").alias("treat_value"),
                      F.avg("y_c").alias("control_value"), F.avg(d.cast("double")).alias("diff"),
                      F.count_if(d == -1).alias("_m"), F.count_if(d == 0).alias("_z"),
                      F.count_if(d == 1).alias("_p"))

    def draw(frames):
        for f in frames:
            out = []
            for r, m, z, p in f[["rep", "_m", "_z", "_p"]].itertuples(index=False):
                n = m + z + p
                if n:
                    c = np.random.default_rng([seed, int(r)]).multinomial(n, [m / n, z / n, p / n])
                    out.append((c[2] - c[0]) / n)
            yield pd.DataFrame({"v": np.array(out, dtype=float)})

    reps = (point.select("_m", "_z", "_p", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("rep"))
            .mapInPandas(draw, "v double"))
    spread = (reps.agg(F.percentile("v", [alpha / 2, 1 - alpha / 2]).alias("_q"), F.stddev_samp("v").alias("_se"))
              .select(F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("ci_high"), "_se",
                      F.lit(1).alias("_k")))
    return (point.drop("_m", "_z", "_p").withColumn("_k", F.lit(1)).join(spread, "_k").drop("_k")
            .withColumn("p_value", two_sided_p(F.when(F.col("_se") > 0, F.col("diff") / F.col("_se"))))
            .withColumn("is_significant", excludes_zero("ci_low", "ci_high")).drop("_se"))
