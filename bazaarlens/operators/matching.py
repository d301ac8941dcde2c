"""Propensity scores, one-to-one matching without replacement, balance and effects.

Matching is one-dimensional (logit of the propensity), serial and greedy by definition: in a
random order each treated unit takes the nearest control still free among its nearest
``neighbours``, if within the caliper. The result of that serial rule is reproduced exactly
in parallel:

1. Controls get a global rank along the logit. A treated unit's nearest controls are a run of
   ranks around its own position, so candidates come from a bounded window of ranks and no
   pair of one bucket with another is ever enumerated.
2. The rank axis is cut into blocks. Inside a block the serial rule is simulated in priority
   order; a decision that could depend on something outside the block is left open.
3. Open units (those near block edges) are decided in further rounds with shifted blocks.
   The unit with the best priority among the open ones can always be decided once its window
   lies inside a block, so the rounds end; in practice two or three are enough.

Treated units that have the same acceptable controls compete for at most ``neighbours`` of
them, so only that many with the best priority can ever match; the others are dropped early
and counted as unmatched. This keeps a block bounded when many units share one score.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clipped_log1p, hash60, logit, month_index, ratio, two_sided_p, z_quantile
from ..params import (ALPHA, B_MATCHED, BALANCE_LIMIT, CALIPER, MIN_ARM, NEIGHBOURS, REPEAT_HORIZONS,
                      SEED, TOP_STATES)
from ..sources.recovery import cut_lineage
from .ordering import ordered_totals
from .resample import matched_effect

__all__ = ["horizon_outcome", "naive_effect", "top_values", "propensity_features", "propensity_scores",
           "match_nearest", "balance", "experience_effects"]

BLOCK = 4096
AT_ONCE = 2     # horizons worked on at a time


def horizon_outcome(first: DataFrame, horizon: int) -> DataFrame:
    """Customers observed for the whole horizon with a known treatment; outcome = repeat in it."""
    y = (F.col("event") == 1) & (F.col("days_to_repeat") <= horizon)
    return (first.where((F.col("tenure_days") >= horizon) & F.col("first_is_late").isNotNull())
            .withColumns({"treat": F.col("first_is_late").cast("int"), "y": F.coalesce(y, F.lit(False)).cast("int")}))


def naive_effect(df: DataFrame, treat: str = "treat", y: str = "y", alpha: float = ALPHA) -> DataFrame:
    """Unmatched difference of means with a normal interval."""
    v = F.col(y).cast("double")
    t, c = F.col(treat) == 1, F.col(treat) == 0
    g = df.agg(F.count_if(t).alias("n_treat"), F.count_if(c).alias("n_control"),
               F.avg(F.when(t, v)).alias("treat_value"), F.avg(F.when(c, v)).alias("control_value"),
               F.var_samp(F.when(t, v)).alias("_vt"), F.var_samp(F.when(c, v)).alias("_vc"))
    d, z = F.col("treat_value") - F.col("control_value"), z_quantile(alpha)
    g = g.withColumns({"diff": d, "_se": F.sqrt(ratio(F.col("_vt"), F.col("n_treat")) + ratio(F.col("_vc"), F.col("n_control")))})
    zs = F.try_divide(F.col("diff"), F.when(F.col("_se") > 0, F.col("_se")))
    return (g.withColumns({"ci_low": F.col("diff") - z * F.col("_se"), "ci_high": F.col("diff") + z * F.col("_se"),
                           "p_value": two_sided_p(zs), "is_significant": (F.abs(zs) > z).cast("int")})
            .drop("_vt", "_vc", "_se"))


def top_values(df: DataFrame, col: str, n: int = TOP_STATES) -> list[str]:
    """The n most frequent values (ties by value); a bounded list."""
    rows = (df.where(F.col(col).isNotNull()).groupBy(col).count()
            .orderBy(F.col("count").desc(), F.col(col)).limit(n).collect())
    return [r[0] for r in rows]


def propensity_features(df: DataFrame, states: list[str]) -> tuple[DataFrame, list[str]]:
    """Standardised covariates known when the order was placed. The review score is left out on
    purpose: it lies on the path from lateness to repeat."""
    cols: dict[str, Column] = {
        "log_amount": clipped_log1p(F.coalesce(F.col("first_amount").cast("double"), F.lit(0.0))),
        "item_cnt": F.coalesce(F.col("first_item_cnt").cast("double"), F.lit(1.0)),
        "seller_cnt": F.coalesce(F.col("first_seller_cnt").cast("double"), F.lit(1.0)),
        "log_dist": clipped_log1p(F.coalesce("first_dist_km", F.lit(0.0))),
        "dist_missing": F.col("first_dist_km").isNull().cast("double"),
        "installments": F.coalesce(F.col("first_installments").cast("double"), F.lit(1.0)),
        "pay_type_cnt": F.coalesce(F.col("first_pay_type_cnt").cast("double"), F.lit(1.0)),
        "freight_ratio": F.coalesce("first_freight_ratio", F.lit(0.0)),
        "cohort_index": month_index("first_cohort_month").cast("double"),
    }
    cols |= {f"state_{s}": F.coalesce((F.col("first_state") == s).cast("double"), F.lit(0.0)) for s in states}
    wide = df.select("customer_unique_id", "treat", "y", *[c.alias(n) for n, c in cols.items()])
    names = list(cols)
    stats = wide.agg(*[f(n).alias(f"{p}{i}") for i, n in enumerate(names)
                       for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    scaled = [((F.col(n) - float(stats[f"m{i}"] or 0)) / float(stats[f"s{i}"] or 1.0)).alias(n)
              for i, n in enumerate(names)]
    return wide.select("customer_unique_id", "treat", "y", *scaled), names


def propensity_scores(features: DataFrame, names: list[str], max_iter: int = 100) -> DataFrame:
    """Adds ``logit``, from an L2 logistic regression with unit penalty on the summed loss."""
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(features)
    n = data.count()
    model = LogisticRegression(featuresCol="_x", labelCol="treat", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                               standardization=False, maxIter=max_iter, tol=1e-8).fit(data)
    p = vector_to_array(F.col("probability"))
    return (model.transform(data).withColumn("logit", logit(F.get(p, F.lit(1))))
            .drop("_x", "rawPrediction", "probability", "prediction"))


def _candidates(pos: int, x: float, ctl_rank: np.ndarray, ctl_logit: np.ndarray, k: int, caliper: float):
    """Acceptable controls of one treated unit, nearest first, out of its k nearest. Ties go to the
    rank nearer to the unit's position, then to the lower rank, so the k form one run of ranks.

    ``ctl_rank`` is sorted and gap-free around ``pos``, the number of controls before the unit.
    """
    at = np.searchsorted(ctl_rank, pos)
    lo, hi = max(0, at - k), min(len(ctl_rank), at + k)
    dist = np.abs(ctl_logit[lo:hi] - x)
    pick = np.lexsort((ctl_rank[lo:hi], np.abs(ctl_rank[lo:hi] - pos + 0.5), dist))[:k]
    pick = pick[dist[pick] <= caliper]
    return ctl_rank[lo:hi][pick]


def _settle(units, core_lo: int, core_hi: int, taken: set):
    """Serial rule inside a block. ``units`` are (id, candidates, is_core) in priority order.

    Controls outside [core_lo, core_hi) may be wanted by units not seen here, and units that are
    not core are decided elsewhere, so both make a control uncertain for later units.
    """
    unsure: set = set()
    matched, open_ids = [], []
    for uid, cand, core in units:
        cand = [c for c in cand if c not in taken]
        decided = core
        choice = None
        if core:
            for c in cand:
                if c in unsure or not core_lo <= c < core_hi:
                    decided = False
                    break
                choice = c
                break
        if decided:
            if choice is not None:
                taken.add(choice)
                matched.append((uid, choice))
        else:
            unsure.update(cand)
            if core:
                open_ids.append(uid)
    return matched, open_ids


def match_nearest(scored: DataFrame, unit: str = "customer_unique_id", caliper: float = CALIPER,
                  neighbours: int = NEIGHBOURS, seed: int = SEED, block: int = BLOCK,
                  max_rounds: int = 200) -> DataFrame:
    """Matched pairs (treat_id, control_id, y_t, y_c) of the serial greedy rule."""
    spark, k = scored.sparkSession, neighbours
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # one global order of treated and controls gives control ranks and treated positions together
    placed = cut_lineage(
        ordered_totals(scored.select(F.col(unit).cast("string").alias("uid"), "treat", "y",
                                     (F.col("logit") + 0.0).alias("logit")), "logit",  # -0.0 sorts apart from 0.0
                       {"c": (F.col("treat") == 0).cast("long")}, tie="uid").withColumnRenamed("c_before", "pos"))
    controls = placed.where("treat = 0").select("uid", F.col("pos").alias("rank"), "logit", "y")
    prio = hash60(seed, F.col("uid"))
    # equal logits mean equal candidate lists: only the first k of them can match
    w = Window.partitionBy("logit").orderBy("prio", "uid")
    treated = (placed.where("treat = 1").select("uid", "pos", "logit", "y", prio.alias("prio"))
               .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n"))

    # ranks of equal logits: the position used for candidates is before all of them
    lowest = F.min("pos").over(Window.partitionBy("logit"))  # at most k rows per logit by now
    treated = treated.withColumn("pos", lowest)

    def near(col: Column, halo: int, shift: int) -> Column:
        """Blocks whose range, widened by the halo, contains the rank."""
        lo = F.floor((col + shift - halo) / block)
        return F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.floor((col + shift + halo) / block)))

    def collect_candidates(key, tr: pd.DataFrame, ct: pd.DataFrame) -> pd.DataFrame:
        ct = ct.sort_values("rank")
        rank, lg = ct["rank"].to_numpy(), ct["at"].to_numpy()
        out = [_candidates(p, x, rank, lg, k, caliper) for p, x in zip(tr["pos"], tr["logit"])] if len(rank) else \
            [np.array([], dtype=np.int64)] * len(tr)
        return pd.DataFrame({"uid": pd.Series(tr["uid"].tolist(), dtype=object), "prio": tr["prio"].to_numpy(), "pos": tr["pos"].to_numpy(),
                             "cand": pd.Series(out, dtype=object)})

    ct_blocks = controls.select("rank", F.col("logit").alias("at"), near(F.col("rank"), k + 1, 0).alias("b"))
    # units of a crowded block are spread over several groups; each gets the block's few controls
    load = treated.groupBy(F.floor(F.col("pos") / block).alias("b")).agg(
        F.ceil(F.count(F.lit(1)) / (4 * block)).alias("copies"))
    tr_blocks = (treated.withColumn("b", F.floor(F.col("pos") / block)).join(load, "b")
                 .withColumn("s", F.pmod(F.col("prio"), F.col("copies"))))
    ct_spread = ct_blocks.join(load, "b").select(
        "rank", "at", F.col("b").alias("cb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("cs"))
    listed = (tr_blocks.groupBy("b", "s").cogroup(ct_spread.groupBy("cb", "cs"))
              .applyInPandas(collect_candidates, "uid string, prio long, pos long, cand array<long>")
              .where(F.size("cand") > 0))
    # units with the same acceptable set compete for |set| controls at most
    same = Window.partitionBy(F.array_min("cand"), F.size("cand")).orderBy("prio", "uid")
    todo = cut_lineage(listed.withColumn("_n", F.row_number().over(same))
                       .where((F.col("_n") <= k) & (F.col("_n") <= F.size("cand"))).drop("_n"))

    taken = None
    halo = 2 * k + 2
    for round_no in range(max_rounds):
        shift = (block // 2) if round_no % 2 else 0

        def settle(key, tr: pd.DataFrame, tk: pd.DataFrame) -> pd.DataFrame:
            b = key[0]
            lo, hi = int(b) * block - shift, (int(b) + 1) * block - shift
            tr = tr.sort_values(["prio", "uid"])
            units = [(u, list(c), lo <= p < hi) for u, c, p in zip(tr["uid"], tr["cand"], tr["pos"])]
            low = lo if lo > 0 else -1
            done, left = _settle(units, low, hi, set(tk["rank"]))
            return pd.DataFrame({"uid": pd.Series([u for u, _ in done] + left, dtype=object),
                                 "rank": pd.Series([int(c) for _, c in done] + [None] * len(left), dtype=object)})

        spread = todo.withColumn("b", near(F.col("pos"), halo, shift))
        gone = (taken.select("rank", near(F.col("rank"), halo, shift).alias("tb")) if taken is not None
                else spark.createDataFrame([], "rank long, tb long"))
        result = cut_lineage(spread.groupBy("b").cogroup(gone.groupBy("tb"))
                             .applyInPandas(settle, "uid string, rank long"))
        fresh = result.where("rank IS NOT NULL")
        taken = fresh if taken is None else taken.unionByName(fresh)
        open_ids = result.where("rank IS NULL").select("uid")
        if open_ids.isEmpty():
            break
        taken = cut_lineage(taken)
        todo = cut_lineage(todo.join(open_ids, "uid"))
    else:
        raise RuntimeError("matching did not settle; raise max_rounds or the block size")
    return (taken.withColumnRenamed("uid", "treat_id")
            .join(controls.select("rank", F.col("uid").alias("control_id"), F.col("y").alias("y_c")), "rank")
            .join(placed.where("treat = 1").select(F.col("uid").alias("treat_id"), F.col("y").alias("y_t")), "treat_id")
            .select("treat_id", "control_id", "y_t", "y_c"))


def balance(df: DataFrame, names: list[str], treat: str = "treat") -> DataFrame:
    """Standardised mean difference per covariate; equal constants give 0."""
    long = df.select(treat, F.inline(F.array(*[
        F.struct(F.lit(n).alias("covariate"), F.col(n).cast("double").alias("x")) for n in names])))
    t, c = F.col(treat) == 1, F.col(treat) == 0
    g = long.groupBy("covariate").agg(
        F.avg(F.when(t, F.col("x"))).alias("_mt"), F.avg(F.when(c, F.col("x"))).alias("_mc"),
        F.var_samp(F.when(t, F.col("x"))).alias("_vt"), F.var_samp(F.when(c, F.col("x"))).alias("_vc"))
    sd = F.sqrt((F.col("_vt") + F.col("_vc")) / 2)
    return g.select("covariate", F.when(sd == 0, 0.0).otherwise((F.col("_mt") - F.col("_mc")) / sd).alias("smd"))


def experience_effects(first: DataFrame, horizons=REPEAT_HORIZONS, caliper: float = CALIPER,
                       neighbours: int = NEIGHBOURS, b: int = B_MATCHED, seed: int = SEED,
                       min_arm: int = MIN_ARM, balance_limit: float | None = BALANCE_LIMIT) -> DataFrame:
    """Naive and matched effect of a late first order on repeat purchase, per horizon."""
    states = top_values(first, "first_state")
    cols = ["outcome", "method", "n_treat", "n_control", "treat_value", "control_value", "diff", "ci_low",
            "ci_high", "p_value", "is_significant", "smd_max_before", "smd_max_after", "n_unmatched"]
    null = lambda t: F.lit(None).cast(t)

    def effects(h: int) -> DataFrame:
        sub = cut_lineage(horizon_outcome(first, h))
        rows = naive_effect(sub).withColumns({
            "outcome": F.lit(f"repeat_{h}"), "method": F.lit("naive"), "smd_max_before": null("double"),
            "smd_max_after": null("double"), "n_unmatched": null("long")}).select(cols)
        arms = sub.agg(F.count_if(F.col("treat") == 1).alias("t"), F.count_if(F.col("treat") == 0).alias("c")).first()
        if min(arms["t"], arms["c"]) < min_arm:
            return rows
        x, names = propensity_features(sub, states)
        x = cut_lineage(propensity_scores(x, names))
        pairs = cut_lineage(match_nearest(x, caliper=caliper, neighbours=neighbours, seed=seed))
        if pairs.isEmpty():
            return rows
        ids = pairs.select(F.inline(F.array(F.struct(F.col("treat_id").alias("id")),
                                            F.struct(F.col("control_id").alias("id")))))
        kept = x.join(ids, x["customer_unique_id"].cast("string") == F.col("id"), "left_semi")
        before = balance(x, names).agg(F.max(F.abs("smd"))).first()[0]
        after = balance(kept, names).agg(F.max(F.abs("smd"))).first()[0]
        if balance_limit is not None and after > balance_limit:
            raise AssertionError(f"covariates are not balanced after matching: {after:.4f}")
        m = matched_effect(pairs, b, seed).withColumns({
            "outcome": F.lit(f"repeat_{h}"), "method": F.lit("matched_1to1"),
            "n_treat": F.col("n_pairs"), "n_control": F.col("n_pairs"),
            "smd_max_before": F.lit(before), "smd_max_after": F.lit(after),
            "n_unmatched": F.lit(int(arms["t"])) - F.col("n_pairs")}).select(cols)
        return rows.unionByName(m)

    # the horizons do not need each other: the many short jobs of one run while the other's leave cores free
    with ThreadPoolExecutor(max_workers=AT_ONCE) as pool:
        return reduce(lambda one, other: one.unionByName(other), pool.map(effects, horizons))
