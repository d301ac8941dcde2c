"""Registered queries: every operator run over the given tables.

Each takes (spark, folder). Thresholds that depend on data size are derived from the data
(half the median monthly order count), never from the folder.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import clipped_log1p, day_of, month_start, rounded
from .operators import boosting as G
from .operators import compare as C
from .operators import decompose as D
from .operators import history as H
from .operators import marts as M
from .operators import matching as PM
from .operators import ordering as O
from .operators import panels as P
from .operators import quality as Q
from .operators import resample as B
from .operators import risk as R
from .operators import segment as S
from .operators import strategy as X
from .operators import survival as V
from .operators import trend as E
from .params import BAD_VALUE, RESCUE_RATES, RISK_FEATURES
from .plans import customers, delivery, revenue, risk_report
from .sources import Canonical, cut_lineage, query, read_csv, store_csv, read_table, scratch_table, ship_package, union_branches, update_columns
from .sources import versions as PV

# assumed strategy parameters of the registered what-if queries
ASSUMED = {"p1_expedite_cost": 8.0, "p2_voucher_face": 15.0, "p2_redeem_rate": 0.6, "p2_contact_cost": 2.0,
           "p3_voucher_face": 10.0, "p3_redeem_rate": 0.65, "bad_review_cost": 40.75, "repeat_effect_pp": -1.46}
TEST_MONTH = "2000-06-01"
MIN_RATIO = 0.5

QUERIES: dict = {}


def _plain(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Dates as text, numbers as BIGINT or rounded DOUBLE: one way to write each value."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date").cast("string")
        elif isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits.get(f.name, 6)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(cols)


class Tables:
    """The tables one query needs, built on demand."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.c = spark, Canonical(spark, base)
        self._memo: dict = {}

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._memo:
            self._memo[name] = getattr(type(self), "make_" + name)(self)
        return self._memo[name]

    def make_orders(self): return self.c.orders_wide(state=False)
    def make_state_orders(self): return self.c.orders_wide()
    def make_items(self): return self.c.order_items()
    def make_lines(self): return Canonical(self.spark, self.c.base, one_pass=True)
    def make_detail(self): return self.lines.orders_detail()
    def make_min_orders(self):
        return P.suggest_min_orders(self.month_orders)
    def make_month_orders(self):
        # order counts need no item or customer join
        return (self.c.raw("orders").groupBy(month_start("o_orderdate").alias("stat_month"))
                .agg(F.count(F.lit(1)).alias("order_cnt")))
    def make_panel(self): return P.month_panel(self.orders, self.min_orders)
    def make_window(self):
        n = self.month_orders
        return P.complete_window(n.withColumn("is_complete_month", (F.col("order_cnt") >= P.suggest_min_orders(n)).cast("int")))
    def make_inside(self): return P.within(self.orders, self.window)
    def make_inside_detail(self): return P.within(self.detail, self.window)
    def make_daily(self): return P.daily_customer_panel(self.inside)  # stored where it is read more than once
    def make_states(self): return P.month_states(self.daily)
    def make_pairs(self):
        return cut_lineage(P.month_pairs(P.within(self.month_orders, self.window, ts=None)))
    def make_category_daily(self): return P.daily_dim_panel(self.inside, self.items, "category")
    def make_state_daily(self): return P.daily_dim_panel(P.within(self.state_orders, self.window), self.items, "state")
    def make_aov(self):
        return D.aov_inputs(P.category_month(self.inside, self.items), P.month_totals(self.inside), self.pairs)
    def make_scored(self):
        v = C.valid_deliveries(self.inside).where(F.col("review_score").isNotNull())
        # several statistics read these few columns: join once, store, read back
        return cut_lineage(C.with_delay(v).select("order_id", day_of("purchase_ts").alias("d"), "is_late",
                                                  "review_score", "delay_hours", "bucket_code"))
    def make_first(self): return cut_lineage(customers.survival_input(self.detail))
    def make_profile(self): return cut_lineage(S.user_profile(self.orders))
    def make_pool(self): return cut_lineage(M.intervention_pool(self.orders))
    def make_params(self): return M.measured_params(self.pool, ASSUMED)
    def make_features(self):
        c = self.lines
        return M.order_features(c.orders_detail(c.orders_wide(state=False), goods=True), c.order_sellers(), c.order_items())
    def make_base(self): return M.bottleneck_base(self.inside_detail, self.lines.order_items())
    def make_model_scores(self):
        """A fixed score with many ties on every reviewed delivery."""
        v = C.with_delay(C.valid_deliveries(self.orders)).where(F.col("review_score").isNotNull())
        tick = F.pmod(F.col("order_id") * 37, F.lit(101)).cast("double") / 101
        return cut_lineage(v.select("order_id", month_start("purchase_ts").alias("stat_month"),
                                    (F.col("review_score") <= 2).cast("int").alias("is_bad"),
                                    F.round((tick + F.col("is_late")) / 2, 3).alias("score")))


def register(name: str | None = None, **digits):
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, base: str) -> DataFrame:
            ship_package(spark)
            return _plain(fn(Tables(spark, base)), digits)
        QUERIES[name or fn.__name__] = run
        return fn
    return deco


# ---------------------------------------------------------------- panels
@register(orders_per_buyer=8, aov=8)
def month_panel(t): return t.panel


@register()
def complete_window(t):
    p = t.panel.where("is_complete_month = 1")
    return p.agg(F.min("stat_month").alias("start_month"), F.max("stat_month").alias("end_month"))


@register()
def month_pairs(t): return t.pairs


@register(gmv=4)
def daily_customer_panel(t): return t.daily


@register(gmv=4, aov=8, orders_per_buyer=8)
def month_states(t): return t.states


@register(gmv=4)
def category_month_revenue(t): return P.dim_month(t.category_daily)


@register(gmv=4)
def state_month_revenue(t): return P.dim_month(t.state_daily)


@register(item_amount=2, freight_amount=4)
def category_month_items(t): return P.category_month(t.inside, t.items)


@register(item_amount=2, freight_amount=4)
def month_totals(t): return P.month_totals(t.inside)


# ---------------------------------------------------------------- revenue
FACTOR_DIGITS = dict(factor_prev=8, factor_curr=8, delta_gmv=3, contribution_amount=3, contribution_pct=5)


@register(**FACTOR_DIGITS)
def revenue_factors(t): return D.revenue_factors(t.states)


@register(ci_low=2, ci_high=2)
def revenue_factor_intervals(t): return B.bootstrap_lmdi(t.daily, t.pairs).drop("max_residual")


@register(total_amount=2, share_pct=2)
def revenue_factor_totals(t): return D.cumulative_share(D.revenue_factors(t.states), "factor", "contribution_amount")


@register(total_amount=2, share_pct=2)
def revenue_factor_significance(t):
    """Totals per factor with the months whose interval excludes zero."""
    amounts = D.revenue_factors(t.states).select("stat_month", "factor", "contribution_amount")
    flags = B.bootstrap_lmdi(t.daily, t.pairs).select("stat_month", "factor", "is_significant")
    return D.cumulative_share(amounts.join(flags, ["stat_month", "factor"]), "factor", "contribution_amount", "is_significant")


@register(contribution_amount=3)
def revenue_main_driver(t): return D.main_driver(D.revenue_factors(t.states))


@register(bar_start=2, bar_end=2, contribution_amount=2)
def revenue_waterfall(t):
    f = D.revenue_factors(t.states).select("stat_month", "factor", "contribution_amount")
    n = F.when(F.col("factor") == "buyers", 1).when(F.col("factor") == "orders_per_buyer", 2).otherwise(3)
    return D.waterfall(f.withColumn("seq", n), "seq", "contribution_amount", ["stat_month"])


STRUCTURE_DIGITS = dict(gmv=4, gmv_prev=4, contrib_amount=4, growth_pct=4, contrib_pp=5)


@register(**STRUCTURE_DIGITS)
def structure_by_category(t): return D.structure_contribution(P.dim_month(t.category_daily), t.pairs)


@register(**STRUCTURE_DIGITS)
def structure_by_state(t): return D.structure_contribution(P.dim_month(t.state_daily), t.pairs)


@register(ci_low=5, ci_high=5)
def structure_intervals_category(t): return B.bootstrap_contrib(t.category_daily, t.pairs, label="category")


@register(ci_low=5, ci_high=5)
def structure_intervals_state(t): return B.bootstrap_contrib(t.state_daily, t.pairs, label="state")


@register()
def structure_significance_category(t):
    """Months per category whose contribution interval excludes zero."""
    rows = B.bootstrap_contrib(t.category_daily, t.pairs, label="category")
    return rows.groupBy("dim_value").agg(F.count(F.lit(1)).alias("months"), F.sum("is_significant").alias("flagged_months"))


@register(contrib_pp=5)
def structure_latest_ends(t):
    rows = D.latest(D.structure_contribution(P.dim_month(t.category_daily), t.pairs).withColumn("dim_type", F.lit("category")))
    return D.ends(rows, ["dim_type"], ["contrib_pp", "dim_value"], 6).select("dim_value", "contrib_pp", "side", "position")


AOV_DIGITS = dict(contribution_pct=5)


@register(**AOV_DIGITS)
def aov_effects(t): return D.aov_effects(t.aov)


@register(price_prev=8, price_curr=8)
def aov_detail(t): return D.aov_detail(t.aov)


@register(total_amount=3, mean_per_month=3, ci_low=3, ci_high=3)
def aov_effect_window(t):
    e = cut_lineage(D.aov_effects(t.aov))
    ci = B.bootstrap_means(e, "factor", "stat_month", "contribution_amount", label="month").drop("is_significant")
    return D.effect_window(e).join(ci, "factor")


@register(price_total=3, mix_total=3)
def aov_category_totals(t):
    return D.aov_detail(t.aov).groupBy("category_en").agg(
        F.sum("price_contrib").alias("price_total"), F.sum("mix_contrib").alias("mix_total"),
        F.min_by("item_cnt_prev", "stat_month").alias("first_items"), F.max_by("item_cnt_curr", "stat_month").alias("last_items"))


# ---------------------------------------------------------------- trend
@register(tau=5, z=5)
def trend_by_state(t): return E.mann_kendall(P.dim_month(t.state_daily), ["dim_value"], "stat_month", "gmv")


@register(slope_log=7)
def log_slope_by_category(t): return E.log_slope(P.dim_month(t.category_daily), ["dim_value"], "stat_month", "gmv")


@register()
def change_points_by_category(t):
    m = P.dim_month(t.category_daily).withColumn("log_gmv", F.log(F.col("gmv").cast("double")))
    return E.change_points(m, ["dim_value"], "stat_month", "log_gmv").select(
        "dim_value", "stat_month", "idx", "breakpoint_flag", "segment_id")


SEGMENT = dict(z=5, tau=5, slope_log=7, growth_pct=4, first_value=2, last_value=2)


@register(**SEGMENT)
def revenue_trend_segments(t):
    s = P.within(t.panel, t.window, ts=None).withColumns({"lg": F.log(F.col("gmv").cast("double")), "series": F.lit("gmv")})
    return E.segment_report(E.change_points(s, ["series"], "stat_month", "lg"), ["series"], "stat_month", "gmv")


@register(**SEGMENT)
def trend_segments_by_category(t):
    m = P.dim_month(t.category_daily).withColumn("lg", F.log(F.col("gmv").cast("double")))
    return E.segment_report(E.change_points(m, ["dim_value"], "stat_month", "lg"), ["dim_value"], "stat_month", "gmv")


@register(delivered_share=5, median_share=5, gmv=2, gmv_all=2)
def tail_diagnostic(t): return Q.tail_diagnostic(P.within(t.panel, t.window, ts=None))


# ---------------------------------------------------------------- delivery
@register()
def fulfilment_monthly(t): return M.fulfilment_monthly(t.orders)


@register(tau=5, z=5)
def late_rate_trend(t):
    m = Q.drop_truncated(P.within(M.fulfilment_monthly(t.orders), t.window, ts=None), floor=MIN_RATIO)
    m = cut_lineage(m.withColumn("series", F.lit("late_rate")))
    e = m.groupBy("series").agg(F.min_by("late_rate", "stat_month").alias("first_rate"),
                                F.max_by("late_rate", "stat_month").alias("last_rate"), F.avg("late_rate").alias("mean_rate"))
    return e.join(E.mann_kendall(m, ["series"], "stat_month", "late_rate"), "series")


@register()
def delay_profile(t): return M.delay_profile(t.orders)


@register()
def dose_response(t): return C.dose_response(t.scored)


@register(u_statistic=1, tie_term=0, z=5)
def mann_whitney_score(t): return C.mann_whitney(t.scored, "is_late", "review_score")


@register(rho=6)
def spearman_delay_score(t): return C.spearman(t.scored, "delay_hours", "review_score", normal=True)


@register(rho=6)
def spearman_distance_lastmile(t):
    v = t.inside_detail.where("is_delivered = 1").withColumn("avg_distance_km", F.round("avg_distance_km", 3))
    return C.spearman(v, "avg_distance_km", "lastmile_hours", normal=True)


@register(rho=6)
def spearman_month_late_rate(t):
    """Busy months and late rates: a few points, so the exact Student tail."""
    return C.spearman(M.fulfilment_monthly(t.orders), "valid_cnt", "late_rate")


@register(value=5)
def score_difference(t): return C.score_difference(t.scored)


@register(avg_lastmile_hours=5, avg_distance_km=4, gmv=4)
def bottleneck_base(t): return t.base


@register(avg_lastmile_hours=5, avg_distance_km=4, gmv=4, z_stat=5, diff_vs_overall_pp=5)
def bottleneck_table(t): return C.bottleneck_table(t.base)


@register(mean_hours=4, ci_low=4, ci_high=4)
def stage_durations(t):
    v = C.valid_deliveries(t.inside).withColumn("d", day_of("purchase_ts"))
    return C.stage_durations(v).drop("is_significant")


@register(**{f"{v}_{g}": 4 for v in ("mean_hours", "ci_low", "ci_high") for g in ("late", "on_time")})
def stage_durations_wide(t):
    """The stage table as it is read: a row per stage, the groups side by side."""
    v = C.valid_deliveries(t.inside).withColumn("d", day_of("purchase_ts"))
    return P.wide(C.stage_durations(v), ["stage_code"], "group_code", ["mean_hours", "ci_low", "ci_high"], ["late", "on_time"])


# ---------------------------------------------------------------- subject tables
@register(gmv=4)
def daily_revenue(t): return M.daily_revenue(t.orders)


@register(gmv=4)
def seller_table(t): return M.seller_table(t.orders, t.items)


@register(gmv=4)
def state_month(t): return M.state_month(t.state_orders)


@register()
def retention(t): return V.retention(t.orders)


# ---------------------------------------------------------------- customers
@register(first_amount=4, first_dist_km=4)
def survival_input(t): return t.first


@register()
def survival_curves(t): return V.survival_curves(t.first)


@register(expected=5, variance=5, chi2=5)
def logrank_late(t):
    d = V.censor_at(t.first).where(F.col("first_is_late").isNotNull())
    return V.logrank(d.withColumn("side", 1 - F.col("first_is_late")), "obs_days", "obs_event", "side", [])


@register()
def survival_by_state(t): return V.kaplan_meier(V.censor_at(t.first), "obs_days", "obs_event", ["first_state"])


@register()
def survival_first_purchase_event(t):
    """Hours from a user's first event to the first purchase after it, censored at 72 hours."""
    ev = read_table(t.spark, "events", t.c.base)
    g = ev.groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"),
                                  F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("tp"))
    h = lambda c: F.timestamp_diff("HOUR", F.col("t0"), F.col(c)).cast("int")
    g = g.select("user_id", F.col("tp").isNotNull().cast("int").alias("event"), h("tp").alias("days_to_repeat"),
                 h("t1").alias("tenure_days"))
    return V.kaplan_meier(V.censor_at(g, 72), "obs_days", "obs_event", [])


@register()
def experience_base(t): return V.experience_base(t.first)


@register(z_stat=5, diff_vs_overall_pp=5)
def repeat_rate_table(t): return C.repeat_rate_table(V.experience_base(t.first))


@register()
def naive_effect_180(t): return PM.naive_effect(PM.horizon_outcome(t.first, 180))


@register()
def naive_effect_365(t): return PM.naive_effect(PM.horizon_outcome(t.first, 365))


@register()
def covariate_balance(t):
    sub = PM.horizon_outcome(t.first, 365)
    x, names = PM.propensity_features(sub, PM.top_values(sub, "first_state"))
    return PM.balance(x, names)


@register()
def matched_effects(t): return PM.experience_effects(t.first)


@register(monetary=4)
def user_profile(t): return t.profile


@register(monetary=4, thr_monetary=4)
def rfm_cells(t): return S.rfm_summary(S.rfm_cells(t.profile))


@register(monetary=4)
def rfm_segments(t): return S.rfm_segments(t.profile)


@register()
def rfm_agreement(t):
    both = cut_lineage(S.rfm_segments(S.rfm_cells(t.profile)))
    return S.adjusted_rand(both, "rfm_code", "rfm_segment")


@register()
def rfm_crosstab(t): return S.crosstab(S.rfm_segments(S.rfm_cells(t.profile)), "rfm_code", "rfm_segment")


@register()
def rfm_standardised(t):
    return S.log_standardise(t.profile, S.RFM_COLUMNS).select("customer_unique_id", *[f"z_{c}" for c in S.RFM_COLUMNS])


@register()
def cell_silhouette(t):
    """Silhouette of the rule cells on the standardised profile."""
    z = S.log_standardise(S.rfm_cells(t.profile), S.RFM_COLUMNS)
    return S.silhouette(z, [f"z_{c}" for c in S.RFM_COLUMNS], "rfm_code")


@register()
def cell_silhouette_euclidean(t):
    """The same with Euclidean distances, over all rows."""
    z = S.log_standardise(S.rfm_cells(t.profile), S.RFM_COLUMNS)
    return S.euclidean_silhouette(z, [f"z_{c}" for c in S.RFM_COLUMNS], "rfm_code")


@register()
def cluster_evaluation(t): return customers.cluster_evaluation(t.profile)


@register(q1=4, med=4, q3=4)
def price_quartiles_by_category(t):
    return O.quantiles(t.items.where(F.col("category_en").isNotNull()), "price", {"q1": 0.25, "med": 0.5, "q3": 0.75}, ["category_en"])


# ---------------------------------------------------------------- risk
@register(avg_distance_km=4, order_amount=4)
def order_features(t): return t.features


@register()
def seller_history_answered(t):
    """Earlier reviews of an order's sellers that were answered by then: assumed at 0 to 39 days after delivery."""
    v = C.valid_deliveries(t.orders).where(F.col("review_score").isNotNull())
    days = F.make_interval(days=(F.col("order_id") % 40).cast("int"))
    reviews = v.select("order_id", "purchase_ts", (F.col("customer_delivered_ts") + days).alias("answered_ts"), (F.col("review_score") <= 2).cast("int").alias("is_bad"))
    pairs = cut_lineage(t.c.order_sellers().join(reviews, "order_id"))
    return H.answered_rates(pairs, "seller_id", "order_id", "purchase_ts", "answered_ts", "is_bad", "seller")


def _leafwise(t):
    train, test = R.time_split(cut_lineage(t.features), TEST_MONTH)
    s = train.agg(F.count(F.lit(1)).alias("n"), F.sum("is_bad").alias("pos")).first()
    w0, w1 = R.class_weights(s["n"], s["pos"] or 0)
    train = cut_lineage(train.withColumn("_w", F.when(F.col("is_bad") == 1, w1).otherwise(w0)))
    return train, test, G.fit_leafwise(train, list(RISK_FEATURES), weight="_w")


@register()
def leafwise_evaluation(t):
    """Leaf-wise boosted trees with native missing values: ranking metrics of both time parts."""
    train, test, model = _leafwise(t)
    return G.evaluated(model, train, test)


@register()
def leafwise_certificate(t):
    """What must hold of any such model, counted over its training rows: no violations."""
    train, _, model = _leafwise(t)
    return G.certificate(model, train, "is_bad", "_w")


@register()
def average_precision(t): return R.average_precision(t.model_scores)


@register()
def roc_auc(t): return R.roc_auc(t.model_scores)


@register()
def brier_score(t): return R.brier(t.model_scores)


@register()
def f1_threshold_outcome(t):
    train, test = R.time_split(t.model_scores, TEST_MONTH)
    best = R.best_f1_threshold(train)
    thr = best.select("threshold").scalar()
    out = R.confusion_at(test.withColumn("thr", thr), F.col("thr"))
    return out.withColumns({"threshold": thr, "train_f1": best.select("f1").scalar()})


@register()
def gain_table(t): return R.gain_table(t.model_scores)


@register()
def risk_evaluation(t): return risk_report.RiskModels(t.features, TEST_MONTH).evaluation()


@register()
def risk_gain(t): return risk_report.RiskModels(t.features, TEST_MONTH).gain()


@register()
def risk_importance(t): return risk_report.RiskModels(t.features, TEST_MONTH).importance()


# ---------------------------------------------------------------- strategies
MONEY = dict(covered_gmv=4, total_cost=3, revenue_review=3, revenue_repeat=2, revenue_total=2, net_benefit_a=2,
             net_benefit_b=2, bad_upper=4, rescued_repeat=5, roi_a=5, roi_b=5, breakeven_p_a=5, breakeven_p_b=5)


@register(covered_gmv=4)
def strategy_coverage(t): return X.strategy_coverage(t.pool)


@register(covered_gmv=4, bad_rate=6)
def strategy_by_segment(t): return X.strategy_by_segment(t.pool, S.rfm_segments(t.profile))


@register(covered_gmv=4)
def strategy_month(t): return M.strategy_month(X.hit_strategies(t.pool))


@register(param_value=4)
def strategy_params(t): return t.params


@register(**MONEY)
def strategy_roi(t): return X.roi(X.strategy_coverage(t.pool), t.params)


@register(total_cost=3, revenue=2, net_benefit=2, roi=5)
def strategy_sensitivity(t): return X.sensitivity(X.strategy_coverage(t.pool), t.params)


@register(**{f"p{round(100 * p)}": 5 for p in RESCUE_RATES})
def strategy_sensitivity_wide(t):
    """ROI at the middle value of a bad review: a row per strategy, the rescue rates side by side."""
    s = X.sensitivity(X.strategy_coverage(t.pool), t.params).where(F.abs(F.col("bad_value") - BAD_VALUE) < 1e-9)
    name = F.concat(F.lit("p"), F.round(F.col("rescue_rate") * 100).cast("int").cast("string"))
    return P.wide(s.withColumn("rate", name), ["strategy"], "rate", ["roi"], [f"p{round(100 * p)}" for p in RESCUE_RATES])


@register(allocated=3, expected_net=2, expected_roi=4, alloc_pct=4)
def strategy_budget(t): return X.budget_plan(X.roi(X.strategy_coverage(t.pool), t.params))


@register()
def strategy_invariants(t): return X.invariants(X.strategy_coverage(t.pool), t.params)


# ---------------------------------------------------------------- quality and storage
@register()
def shape_report(t):
    o = t.c.raw("orders")
    return Q.shape_report(o, {"o_orderkey": r"^[0-9]+$", "o_orderstatus": "^[OFP]$", "o_orderpriority": r"^[1-5]-[A-Z]",
                              "o_custkey": r"^[0-9]{1,3}$"})


@register(z=5, tau=5)
def event_value_trend(t):
    """Trend of the values of each event type, event by event: series that grow with the facts."""
    ev = read_table(t.spark, "events", t.c.base)
    return E.mann_kendall_long(ev, ["event_type"], "event_id", "value")


@register()
def multi_line_file(t):
    """Events written as a CSV file with quotes and line breaks in its fields and read back by many tasks: records, those whose
    text came back whole, the highest record number of a file's, and values that did not fit."""
    ev = read_table(t.spark, "events", t.c.base)
    # as a raw export would be: JSON next to free text of several lines; every hundredth value is no number
    told = ev.select("event_id", F.concat(F.col("event_type"), F.lit("\nsaid \""), F.col("props"), F.lit("\",\n\nthen left")).alias("note"),
                     F.when(F.col("event_id") % 100 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"))
    path = store_csv(told)
    back = read_csv(t.spark, path, T.StructType.fromDDL("event_id BIGINT, note STRING, value DOUBLE"), multi_line=True)
    both = back.join(told.select(F.col("event_id"), F.col("note").alias("was")), "event_id", "left")
    return both.groupBy(F.col("_bad").isNotNull().alias("is_bad")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("note") == F.col("was")).alias("whole"), F.count_if(F.col("_record") >= 1).alias("numbered"))


@register()
def bad_rows(t):
    o = t.c.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return (Q.bad_rows(o, {"o_custkey": r"^[0-9]{1,3}$", "o_orderpriority": r"^[1-4]-"})
            .select("o_orderkey", F.concat_ws(",", "bad_columns").alias("bad_columns")))


@register(k_value=0)
def typed_conversion(t):
    """The events' JSON value as text, converted with a check; text that is not a number is NULL."""
    ev = read_table(t.spark, "events", t.c.base).select(
        "event_type", F.get_json_object("props", "$.k").alias("k_text"), F.substring("event_type", 1, 3).alias("word"))
    g = Q.typed(ev, {"k_text": "int", "word": "int"})
    return g.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("k_text").alias("k_value"),
                                       F.count("word").alias("words_converted"))


@register(l_extendedprice=2)
def latest_line(t):
    """The lines repeat (order, line number); the last shipped one is kept."""
    l = t.c.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return Q.latest_per_key(l, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice"])


@register()
def duplicate_keys(t): return Q.duplicate_keys(t.c.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@register()
def domain_violations(t):
    return Q.domain_violations(t.orders, {
        "score_1_to_5": F.col("review_score").isNull() | F.col("review_score").between(1, 5),
        "late_is_flag": F.col("is_late").isin(0, 1), "amount_positive": F.col("order_amount") > 0})


@register()
def timestamp_audit(t):
    """Order dates against an explicit parse of their own text, with one broken format branch."""
    o = t.c.raw("orders")
    text = F.when(F.col("o_orderkey") % 1000 == 7, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    bad = Q.parse_mismatches(o.withColumn("raw_text", text), "o_orderdate", "raw_text", "yyyy-MM-dd HH:mm:ss")
    return bad.select("o_orderkey", "raw_text")


@register()
def zero_dates(t):
    return Q.zero_date_count(t.c.raw("orders"), "o_orderdate").unionByName(Q.zero_date_count(t.c.raw("lineitem"), "l_shipdate"))


@register(by_category=4, by_state=4, overall=4, category_gap=4, state_gap=4)
def cross_section_tie_out(t):
    done = t.inside.where("is_delivered = 1").select(F.col("order_amount").alias("gmv"))
    return Q.tie_out(P.dim_month(t.category_daily), P.dim_month(t.state_daily), done)


@register()
def factor_gap(t): return Q.state_gap(t.panel, t.states)


@register()
def grain_gap(t): return Q.category_gap(P.category_month(t.orders, t.items), P.month_totals(t.orders), t.panel)


@register()
def orders_without_items(t): return Q.unmatched_orders(t.orders, t.items).select("order_id", "purchase_ts")


@register()
def keyed_update(t):
    """Late rates of complete months written onto the fulfilment table by month."""
    target = M.fulfilment_monthly(t.orders).select("stat_month", "order_cnt", F.lit(-1.0).alias("mk_tau"), F.lit("stale").alias("note"))
    fresh = P.within(t.panel, t.window, ts=None).where("gmv > gmv_all * 0.66").select(
        "stat_month", (F.col("delivered_cnt") / F.col("order_cnt")).alias("mk_tau"), F.lit("fresh").alias("note"))
    return update_columns(target, fresh, "stat_month", ["mk_tau", "note"])


@register(value=2)
def published_events(t):
    """Events published by type, purchases replaced by corrected ones, errors added once more as another type, users' values
    updated by event: rows and values by type in each version."""
    path = scratch_table(t.spark)
    ev = read_table(t.spark, "events", t.c.base).select("event_id", F.col("value").cast("decimal(18,4)").alias("value"), "event_type")
    PV.publish(ev, path, partition_cols=["event_type"])
    PV.publish(ev.where("event_type = 'purchase' AND event_id % 5 > 0").withColumn("value", (F.col("value") * 2).cast("decimal(18,4)")), path, "partitions")
    PV.publish(ev.where("event_type = 'error'").withColumn("event_type", F.lit("incident")), path, "append")
    PV.publish_update(t.spark, ev.where("event_id % 3 = 0").select("event_id", F.lit(1).cast("decimal(18,4)").alias("value")), path, "event_id", ["value"])
    parts = [PV.published(t.spark, path, n).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
             .select(F.lit(n).alias("version"), "*") for n in PV.published_versions(t.spark, path)]
    return union_branches(*parts)


@register(gmv=2)
def bound_query(t):
    """A SQL text with bound parameters over the month panel."""
    t.panel.createOrReplaceTempView("bazaarlens_month_panel")
    return query(t.spark, "SELECT stat_month, gmv, order_cnt FROM bazaarlens_month_panel "
                          "WHERE is_complete_month = 1 AND stat_month >= CAST(:since AS DATE)", since="1997-01-01")
