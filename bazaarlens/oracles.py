"""The registered queries as plain SQL over the same tables, written independently of the jobs."""

from __future__ import annotations

from statistics import NormalDist

from .params import (BAD_VALUE, BAD_VALUES, BUDGET_LEVELS, B_DELIVERY, B_REVENUE, B_STRUCTURE, DELAY_BUCKETS, MAX_BREAKS,
                     RESCUE_RATE, RESCUE_RATES, RISK_FEATURES, SEED, TOP_PCTS)
from .queries import ASSUMED, MIN_RATIO, TEST_MONTH

Z = repr(NormalDist().inv_cdf(0.975))


def r(expr: str, n: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {n}) + 0.0)"


def d(expr: str) -> str:
    return f"CAST(CAST({expr} AS DATE) AS VARCHAR)"


def i(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def h(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


def p2(z: str) -> str:
    """Two-sided normal p by Simpson's rule (no error function in SQL)."""
    a = f"abs({z})"
    return (f"(CASE WHEN {z} IS NULL THEN NULL WHEN {a} >= 8 THEN 0.0 ELSE greatest(0.0, 1 - 2 * ({a} / 3600.0) * "
            f"list_sum(list_transform(range(0, 1201), lambda k: (CASE WHEN k = 0 OR k = 1200 THEN 1 WHEN k % 2 = 1 THEN 4 "
            f"ELSE 2 END) * exp(-0.5 * pow({a} * k / 1200.0, 2)))) / sqrt(2 * pi())) END)")


def pt(t: str, freedom: str) -> str:
    """Two-sided Student p by Simpson's rule over the density."""
    a, n = f"abs({t})", f"({freedom})"
    return (f"(CASE WHEN {t} IS NULL THEN NULL ELSE greatest(0.0, 1 - 2 * ({a} / 6000.0) * exp(lgamma(({n} + 1) / 2.0) - lgamma({n} / 2.0)) / sqrt({n} * pi()) * "
            f"list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) "
            f"* pow(1 + pow({a} * k / 2000.0, 2) / {n}, -({n} + 1) / 2.0)))) END)")


def bucket(hours: str) -> str:
    out = "CASE"
    for code, _, lo, hi in DELAY_BUCKETS:
        tests = ([f"{hours} > {lo}"] if lo is not None else []) + ([f"{hours} <= {hi}"] if hi is not None else [])
        out += f" WHEN {' AND '.join(tests)} THEN '{code}'"
    return out + " END"


BASE = f"""
items AS (
  SELECT l_orderkey AS order_id, l_suppkey AS seller_id, l_partkey AS product_id, p_brand AS category_en, p_size, p_name,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS freight_value,
         l_shipdate
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
item_totals AS (
  SELECT order_id, count(*) AS item_cnt, sum(price) AS item_amount, sum(freight_value) AS freight_amount,
         max(l_shipdate) AS ship FROM items GROUP BY order_id),
o1 AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_unique_id, o_orderdate AS purchase_ts,
         CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS is_delivered, n_name AS customer_state, c_nationkey AS buyer_nation,
         coalesce(item_cnt, 0) AS item_cnt, coalesce(item_amount, 0) AS item_amount, coalesce(freight_amount, 0) AS freight_amount,
         o_orderdate + INTERVAL 24 DAY AS estimated_ts,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(CAST(
           ((date_diff('day', CAST(o_orderdate AS DATE), CAST(ship AS DATE)) % 45) + 45) % 45 AS INTEGER)) END AS customer_delivered_ts
  FROM orders LEFT JOIN item_totals ON order_id = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey),
ow AS (
  SELECT *, item_amount + freight_amount AS order_amount,
         CASE WHEN customer_delivered_ts IS NULL THEN NULL WHEN customer_delivered_ts > estimated_ts THEN 1 ELSE 0 END AS is_late,
         CASE WHEN customer_delivered_ts IS NULL THEN NULL ELSE greatest(1, 1 + ((order_id * 7 + 3) % 5)
           - CASE WHEN customer_delivered_ts > estimated_ts THEN 2 ELSE 0 END) END AS review_score,
         CAST((order_id * 13) % 48 AS DOUBLE) AS approve_hours, CAST((order_id * 29) % 72 + 6 AS DOUBLE) AS carrier_hours,
         CAST(date_sub('hour', purchase_ts, customer_delivered_ts) AS DOUBLE) AS total_delivery_hours,
         CASE WHEN date_sub('hour', purchase_ts, customer_delivered_ts) - (order_id * 13) % 48 - (order_id * 29) % 72 - 6 >= 0
           THEN CAST(date_sub('hour', purchase_ts, customer_delivered_ts) - (order_id * 13) % 48 - (order_id * 29) % 72 - 6 AS DOUBLE)
         END AS lastmile_hours,
         date_sub('hour', estimated_ts, customer_delivered_ts) AS delay_hours,
         CAST(date_trunc('month', purchase_ts) AS DATE) AS stat_month, CAST(purchase_ts AS DATE) AS d
  FROM o1),
legs AS (
  SELECT s.order_id, s_nationkey AS sn, ow.buyer_nation AS bn FROM (SELECT DISTINCT order_id, seller_id FROM items) s
  JOIN supplier ON s_suppkey = seller_id JOIN ow ON ow.order_id = s.order_id),
legs2 AS (
  SELECT order_id, radians(((bn * 37) % 120) - 60) AS a1, radians(((bn * 83) % 360) - 180) AS b1,
         radians(((sn * 37) % 120) - 60) AS a2, radians(((sn * 83) % 360) - 180) AS b2 FROM legs),
dist AS (
  SELECT order_id, count(*) AS seller_cnt, avg(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((a2 - a1) / 2), 2)
         + cos(a1) * cos(a2) * pow(sin((b2 - b1) / 2), 2))))) AS avg_distance_km FROM legs2 GROUP BY order_id),
goods AS (
  SELECT order_id, count(DISTINCT product_id) AS product_cnt, max(1 + p_size % 5) AS photos_qty,
         max(length(p_name) * 20) AS description_length, sum(p_size * 100) AS weight_g,
         sum(p_size * p_size * 50) AS volume_cm3 FROM items GROUP BY order_id),
od AS (
  SELECT ow.*, avg_distance_km, coalesce(seller_cnt, 0) AS seller_cnt, coalesce(product_cnt, 0) AS product_cnt, photos_qty,
         description_length, weight_g, volume_cm3, 1 + CASE WHEN ow.order_id % 10 = 0 THEN 1 ELSE 0 END AS pay_type_cnt,
         CASE WHEN ow.order_id % 4 <> 0 THEN 1 ELSE 0 END AS has_credit_card, 1 + ow.order_id % 8 AS max_installments,
         CASE WHEN carrier_hours > 48 THEN 1 ELSE 0 END AS is_seller_late
  FROM ow LEFT JOIN dist USING (order_id) LEFT JOIN goods USING (order_id)),
month_orders AS (SELECT stat_month, count(*) AS order_cnt FROM ow GROUP BY stat_month),
panel AS (
  SELECT stat_month, count(*) AS order_cnt, sum(is_delivered) AS delivered_cnt, count(DISTINCT customer_unique_id) AS buyers,
         round(sum(CASE WHEN is_delivered = 1 THEN order_amount ELSE 0 END), 2) AS gmv, round(sum(order_amount), 2) AS gmv_all
  FROM ow GROUP BY stat_month),
panel2 AS (
  SELECT *, delivered_cnt / buyers AS orders_per_buyer, CAST(gmv AS DOUBLE) / delivered_cnt AS aov,
         CASE WHEN order_cnt >= (SELECT floor(median(order_cnt) / 2) FROM month_orders) THEN 1 ELSE 0 END AS is_complete_month
  FROM panel),
win AS (SELECT min(stat_month) AS s, max(stat_month) AS e FROM panel2 WHERE is_complete_month = 1),
inside AS (SELECT od.* FROM od, win WHERE stat_month BETWEEN s AND e),
pairs AS (SELECT * FROM (SELECT stat_month, lag(stat_month) OVER (ORDER BY stat_month) AS prev_month
          FROM (SELECT DISTINCT stat_month FROM inside)) WHERE prev_month IS NOT NULL),
daily AS (
  SELECT d, stat_month, customer_unique_id, sum(is_delivered) AS delivered_cnt,
         sum(CASE WHEN is_delivered = 1 THEN order_amount ELSE 0 END) AS gmv
  FROM inside GROUP BY d, stat_month, customer_unique_id),
states AS (
  SELECT stat_month, count(DISTINCT customer_unique_id) AS buyers, sum(delivered_cnt) AS delivered_cnt, sum(gmv) AS gmv,
         CAST(sum(delivered_cnt) AS DOUBLE) / count(DISTINCT customer_unique_id) AS orders_per_buyer,
         CAST(sum(gmv) AS DOUBLE) / CAST(sum(delivered_cnt) AS DOUBLE) AS aov FROM daily GROUP BY stat_month),
factors_wide AS (
  SELECT stat_month, CAST(gmv AS DOUBLE) AS v1, lag(CAST(gmv AS DOUBLE)) OVER w AS v0, CAST(buyers AS DOUBLE) AS b1,
         lag(CAST(buyers AS DOUBLE)) OVER w AS b0, orders_per_buyer AS f1, lag(orders_per_buyer) OVER w AS f0, aov AS a1,
         lag(aov) OVER w AS a0 FROM states WINDOW w AS (ORDER BY stat_month)),
factors3 AS (
  SELECT stat_month, v1, v0, 'buyers' AS factor, b0 AS x0, b1 AS x1 FROM factors_wide
  UNION ALL SELECT stat_month, v1, v0, 'orders_per_buyer', f0, f1 FROM factors_wide
  UNION ALL SELECT stat_month, v1, v0, 'aov', a0, a1 FROM factors_wide),
factors AS (
  SELECT stat_month, factor, x0 AS factor_prev, x1 AS factor_curr, v1 - v0 AS delta_gmv,
         CASE WHEN v0 = v1 THEN 0 ELSE (v1 - v0) / ln(v1 / v0) * ln(x1 / x0) END AS contribution_amount
  FROM factors3 WHERE v0 IS NOT NULL),
cat_daily AS (
  SELECT d, stat_month, category_en AS dim_value, sum(price + freight_value) AS gmv
  FROM items JOIN inside USING (order_id) WHERE is_delivered = 1 GROUP BY ALL),
state_daily AS (
  SELECT d, stat_month, customer_state AS dim_value, sum(order_amount) AS gmv
  FROM inside WHERE is_delivered = 1 AND customer_state IS NOT NULL GROUP BY ALL),
cat_month AS (SELECT stat_month, dim_value, sum(gmv) AS gmv FROM cat_daily WHERE dim_value IS NOT NULL GROUP BY ALL),
state_month_rev AS (SELECT stat_month, dim_value, sum(gmv) AS gmv FROM state_daily GROUP BY ALL),
cat_items AS (
  SELECT stat_month, category_en, count(*) AS item_cnt, sum(price) AS item_amount, sum(freight_value) AS freight_amount
  FROM items JOIN inside USING (order_id) WHERE is_delivered = 1 AND category_en IS NOT NULL GROUP BY ALL),
tot AS (
  SELECT stat_month, sum(is_delivered) AS delivered_orders,
         sum(CASE WHEN is_delivered = 1 THEN inside.item_cnt ELSE 0 END) AS item_cnt,
         sum(CASE WHEN is_delivered = 1 THEN inside.item_amount ELSE 0 END) AS item_amount,
         sum(CASE WHEN is_delivered = 1 THEN inside.freight_amount ELSE 0 END) AS freight_amount,
         sum(CASE WHEN is_delivered = 1 AND inside.item_cnt = 0 THEN 1 ELSE 0 END) AS delivered_no_item
  FROM inside GROUP BY stat_month),
aov_pair AS (
  SELECT p.stat_month, CAST(c.delivered_orders AS DOUBLE) AS o1, CAST(c.item_cnt AS DOUBLE) AS q1, CAST(c.item_amount AS DOUBLE) AS a1,
         CAST(c.freight_amount AS DOUBLE) AS f1, CAST(b.delivered_orders AS DOUBLE) AS o0, CAST(b.item_cnt AS DOUBLE) AS q0,
         CAST(b.item_amount AS DOUBLE) AS a0, CAST(b.freight_amount AS DOUBLE) AS f0
  FROM pairs p JOIN tot c ON c.stat_month = p.stat_month JOIN tot b ON b.stat_month = p.prev_month),
aov_cat AS (
  SELECT coalesce(x.stat_month, y.stat_month) AS stat_month, coalesce(x.category_en, y.category_en) AS category_en,
         coalesce(x.item_cnt, 0) AS n1, coalesce(y.item_cnt, 0) AS n0, CAST(coalesce(x.item_amount, 0) AS DOUBLE) AS m1,
         CAST(coalesce(y.item_amount, 0) AS DOUBLE) AS m0
  FROM (SELECT c.* FROM cat_items c JOIN pairs USING (stat_month)) x
  FULL JOIN (SELECT pairs.stat_month, category_en, item_cnt, item_amount FROM cat_items c JOIN pairs ON c.stat_month = prev_month) y
    ON x.stat_month = y.stat_month AND x.category_en = y.category_en),
aov_in AS (
  SELECT *, q0 / o0 AS big_n0, q1 / o1 AS big_n1, a0 / q0 AS big_p0, a1 / q1 AS big_p1, n0 / q0 AS s0, n1 / q1 AS s1,
         CASE WHEN n0 > 0 THEN m0 / n0 WHEN n1 > 0 THEN m1 / n1 ELSE 0 END AS p0,
         CASE WHEN n1 > 0 THEN m1 / n1 WHEN n0 > 0 THEN m0 / n0 ELSE 0 END AS p1
  FROM aov_cat JOIN aov_pair USING (stat_month)),
aov_sum AS (
  SELECT stat_month, any_value(big_p0 * big_n0 + f0 / o0) AS aov_prev, any_value(big_p1 * big_n1 + f1 / o1) AS aov_curr,
         sum(big_n0 * s0 * (p1 - p0)) AS price, sum(big_n0 * p0 * (s1 - s0)) AS mix,
         any_value(big_p0 * (big_n1 - big_n0)) AS quantity, any_value(f1 / o1 - f0 / o0) AS freight,
         any_value((big_p1 - big_p0) * (big_n1 - big_n0)) + sum(big_n0 * (s1 - s0) * (p1 - p0)) AS interaction
  FROM aov_in GROUP BY stat_month),
aov_long AS (
  SELECT stat_month, aov_prev, aov_curr, aov_curr - aov_prev AS delta_aov, factor, contribution_amount FROM aov_sum
  UNPIVOT (contribution_amount FOR factor IN (price, mix, quantity, freight, interaction))),
valid AS (SELECT * FROM inside WHERE is_delivered = 1 AND customer_delivered_ts IS NOT NULL),
valid_all AS (SELECT * FROM od WHERE is_delivered = 1 AND customer_delivered_ts IS NOT NULL),
scored AS (SELECT *, {bucket('delay_hours')} AS bucket_code FROM valid WHERE review_score IS NOT NULL),
fulfil AS (
  SELECT stat_month, count(*) AS order_cnt, sum(CASE WHEN customer_delivered_ts IS NOT NULL THEN 1 ELSE 0 END) AS valid_cnt,
         sum(CASE WHEN is_late = 1 THEN 1 ELSE 0 END) AS late_cnt, CAST(sum(is_delivered) AS DOUBLE) / count(*) AS delivered_ratio,
         CAST(sum(CASE WHEN is_late = 1 THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN customer_delivered_ts IS NOT NULL THEN 1 ELSE 0 END) AS late_rate
  FROM ow GROUP BY stat_month),
per_cat AS (SELECT order_id, category_en, sum(price + freight_value) AS v FROM items WHERE category_en IS NOT NULL GROUP BY ALL),
bbase AS (
  SELECT dim_type, dim_value, stat_month, count(*) AS delivered_cnt, sum(is_late) AS late_cnt, sum(v) AS gmv,
         avg(lastmile_hours) AS avg_lastmile_hours, avg(avg_distance_km) AS avg_distance_km, avg(review_score) AS avg_review_score
  FROM (SELECT 'state' AS dim_type, customer_state AS dim_value, stat_month, is_late, order_amount AS v, lastmile_hours, avg_distance_km, review_score
        FROM valid WHERE customer_state IS NOT NULL
        UNION ALL
        SELECT 'category', category_en, stat_month, is_late, p.v, lastmile_hours, avg_distance_km, review_score
        FROM valid JOIN per_cat p USING (order_id)) GROUP BY ALL),
snap AS (SELECT max(CAST(purchase_ts AS DATE)) AS day FROM ow WHERE is_delivered = 1),
snap_all AS (SELECT max(CAST(purchase_ts AS DATE)) AS day FROM ow),
seq AS (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY purchase_ts, order_id) AS rn FROM od WHERE is_delivered = 1),
first AS (
  SELECT a.customer_unique_id, a.d AS first_day, CASE WHEN b.d IS NULL THEN 0 ELSE 1 END AS event, b.d - a.d AS days_to_repeat,
         (SELECT day FROM snap) - a.d AS tenure_days, a.stat_month AS first_cohort_month, a.is_late AS first_is_late,
         a.review_score AS first_review_score, a.order_amount AS first_amount, a.item_cnt AS first_item_cnt, a.seller_cnt AS first_seller_cnt,
         a.avg_distance_km AS first_dist_km, a.max_installments AS first_installments, a.pay_type_cnt AS first_pay_type_cnt,
         CASE WHEN a.item_amount <> 0 THEN CAST(a.freight_amount AS DOUBLE) / CAST(a.item_amount AS DOUBLE) END AS first_freight_ratio,
         a.customer_state AS first_state
  FROM seq a LEFT JOIN seq b ON b.customer_unique_id = a.customer_unique_id AND b.rn = 2 WHERE a.rn = 1),
cens AS (
  SELECT *, greatest(1, least(365, CASE WHEN event = 1 THEN days_to_repeat ELSE tenure_days END)) AS t,
         CASE WHEN event = 1 AND days_to_repeat <= 365 THEN 1 ELSE 0 END AS ev FROM first),
profile AS (
  SELECT customer_unique_id, (SELECT day FROM snap_all) - max(d) AS recency_days, count(*) AS order_cnt, sum(order_amount) AS monetary
  FROM ow WHERE is_delivered = 1 GROUP BY customer_unique_id),
cells AS (
  SELECT *, (SELECT quantile_cont(CAST(monetary AS DOUBLE), 0.5) FROM profile) AS thr,
         (CASE WHEN recency_days <= 180 THEN '1' ELSE '0' END) || (CASE WHEN order_cnt >= 2 THEN '1' ELSE '0' END)
         || (CASE WHEN CAST(monetary AS DOUBLE) > (SELECT quantile_cont(CAST(monetary AS DOUBLE), 0.5) FROM profile) THEN '1' ELSE '0' END) AS rfm_code
  FROM profile),
hashed AS (SELECT *, {h("CAST(customer_unique_id AS VARCHAR)")} AS hk FROM cells),
scores5 AS (
  SELECT *, ntile(5) OVER (ORDER BY -recency_days, hk, customer_unique_id) AS r_score,
         ntile(5) OVER (ORDER BY order_cnt, hk, customer_unique_id) AS f_score,
         ntile(5) OVER (ORDER BY CAST(monetary AS DOUBLE), hk, customer_unique_id) AS m_score FROM hashed),
segs AS (
  SELECT *, CASE WHEN r_score >= 4 THEN CASE WHEN f_score >= 4 AND m_score >= 4 THEN 'champion' WHEN f_score >= 4 THEN 'loyal'
           WHEN m_score >= 4 THEN 'big_recent' ELSE 'new' END
         ELSE CASE WHEN f_score >= 4 AND m_score >= 4 THEN 'at_risk_top' WHEN f_score >= 4 THEN 'at_risk_regular'
           WHEN m_score >= 4 THEN 'lapsed_big' ELSE 'lapsed' END END AS rfm_segment FROM scores5),
pool AS (
  SELECT order_id, customer_unique_id, stat_month, order_amount, CASE WHEN review_score <= 2 THEN 1 ELSE 0 END AS is_bad, is_late, delay_hours
  FROM valid_all WHERE review_score IS NOT NULL),
hits AS (
  SELECT 'p1_expedite' AS strategy, * FROM pool WHERE delay_hours > 72 AND delay_hours <= 168
  UNION ALL SELECT 'p2_intercept', * FROM pool WHERE delay_hours > 72
  UNION ALL SELECT 'p3_voucher', * FROM pool WHERE delay_hours > 0),
coverage AS (
  SELECT s.strategy, count(h.order_id) AS covered_orders, count(DISTINCT customer_unique_id) AS covered_customers,
         coalesce(sum(order_amount), 0) AS covered_gmv, coalesce(sum(is_bad), 0) AS bad_orders
  FROM (VALUES ('p1_expedite'), ('p2_intercept'), ('p3_voucher')) s(strategy) LEFT JOIN hits h ON h.strategy = s.strategy GROUP BY s.strategy),
measured AS (
  SELECT avg(CASE WHEN is_late = 1 THEN CAST(order_amount AS DOUBLE) END) AS aov_delayed,
         avg(CASE WHEN is_late = 0 THEN CAST(order_amount AS DOUBLE) END) AS aov_ontime,
         avg(CASE WHEN is_late = 1 THEN is_bad END) * 100 AS baseline_bad_late,
         avg(CASE WHEN is_late = 0 THEN is_bad END) * 100 AS baseline_bad_ontime FROM pool),
costed AS (
  SELECT *, CASE strategy WHEN 'p1_expedite' THEN {ASSUMED['p1_expedite_cost']}
           WHEN 'p2_intercept' THEN {ASSUMED['p2_voucher_face']} * {ASSUMED['p2_redeem_rate']} + {ASSUMED['p2_contact_cost']}
           ELSE {ASSUMED['p3_voucher_face']} * {ASSUMED['p3_redeem_rate']} END::DOUBLE AS cost_per_order,
         covered_orders * (baseline_bad_late - baseline_bad_ontime) / 100 AS bad_upper,
         CASE WHEN strategy = 'p1_expedite' THEN covered_customers * abs({ASSUMED['repeat_effect_pp']}) / 100 ELSE 0 END::DOUBLE AS per_rate
  FROM coverage, measured),
mscore AS (
  SELECT order_id, stat_month, CASE WHEN review_score <= 2 THEN 1 ELSE 0 END AS is_bad,
         round((CAST((order_id * 37) % 101 AS DOUBLE) / 101 + is_late) / 2, 3) AS score
  FROM valid_all WHERE review_score IS NOT NULL)
"""


def roi_sql(scenarios) -> str:
    grid = ", ".join(f"({float(p)}::DOUBLE, {float(v)}::DOUBLE)" for p, v in scenarios)
    return f"""roi AS (
  SELECT strategy, covered_orders, covered_customers, covered_gmv, bad_orders, p AS rescue_rate, v AS bad_value, cost_per_order, bad_upper,
         per_rate * p AS rescued_repeat, covered_orders * cost_per_order AS total_cost, bad_upper * p * v AS revenue_review,
         per_rate * p * aov_delayed AS revenue_repeat, bad_upper * p * v + per_rate * p * aov_delayed AS revenue_total,
         bad_upper * v AS da, bad_upper * v + per_rate * aov_delayed AS db
  FROM costed, (VALUES {grid}) g(p, v))"""


def q(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *ctes]) + "\n" + body


def slots(daily: str, suffix: str = "") -> str:
    return (f"slots{suffix} AS (SELECT stat_month, d, row_number() OVER (PARTITION BY stat_month ORDER BY d) AS slot, "
            f"count(*) OVER (PARTITION BY stat_month) AS days FROM (SELECT DISTINCT stat_month, d FROM {daily}))")


def month_weights(label: str, b: int, suffix: str = "") -> str:
    return (f"weights{suffix} AS (SELECT stat_month, rep, slot, count(*) AS w FROM (SELECT stat_month, rep, "
            f"1 + {h(f"'{SEED}|{label}|' || stat_month || '|' || rep || '|' || j")} % days AS slot "
            f"FROM (SELECT DISTINCT stat_month, days FROM slots{suffix}), range(1, {b + 1}) a(rep), range(1, 32) c(j) WHERE j <= days) "
            "GROUP BY ALL)")


def block_weights(label: str, b: int, blocks: str, key: str = "", tag: str = "''") -> str:
    keys = f"{key}, " if key else ""
    return (f"bw AS (SELECT {keys}rep, blk, count(*) AS w FROM (SELECT {keys}rep, "
            f"1 + {h(f"'{SEED}|{label}' || {tag} || '|' || rep || '|' || j")} % n AS blk FROM (SELECT {keys}max(blk) AS n FROM {blocks} "
            f"{'GROUP BY ' + key if key else ''}), range(1, {b + 1}) a(rep), LATERAL (SELECT unnest(range(1, n + 1)) AS j)) GROUP BY ALL)")


def structure(month_table: str) -> str:
    return q(f"""SELECT {d('stat_month')} AS stat_month, dim_value, {r('g1', 4)} AS gmv, {r('g0', 4)} AS gmv_prev, {r('g1 - g0', 4)} AS contrib_amount,
      {r('g1 / t1')} AS gmv_share, {r('g0 / t0')} AS gmv_share_prev, CASE WHEN g0 > 0 THEN {r('(g1 / g0 - 1) * 100', 4)} END AS growth_pct,
      {r('(g1 - g0) / t0 * 100', 5)} AS contrib_pp FROM st WHERE t0 > 0 AND t1 > 0 AND (round(g0, 2) <> 0 OR round(g1, 2) <> 0)""",
             structure_cte(month_table))


def structure_cte(month_table: str) -> str:
    return f"""st AS (SELECT *, sum(g1) OVER (PARTITION BY stat_month) AS t1, sum(g0) OVER (PARTITION BY stat_month) AS t0 FROM (
      SELECT coalesce(x.stat_month, y.stat_month) AS stat_month, coalesce(x.dim_value, y.dim_value) AS dim_value,
             CAST(coalesce(x.gmv, 0) AS DOUBLE) AS g1, CAST(coalesce(y.gmv, 0) AS DOUBLE) AS g0
      FROM (SELECT m.* FROM {month_table} m JOIN pairs USING (stat_month)) x
      FULL JOIN (SELECT pairs.stat_month, dim_value, gmv FROM {month_table} m JOIN pairs ON m.stat_month = prev_month) y
      ON x.stat_month = y.stat_month AND x.dim_value = y.dim_value))"""


def structure_ci(daily: str, label: str) -> str:
    return q(f"""SELECT {d('stat_month')} AS stat_month, dim_value, {r('lo', 5)} AS ci_low, {r('hi', 5)} AS ci_high,
      {i('CASE WHEN lo > 0 OR hi < 0 THEN 1 ELSE 0 END')} AS is_significant
      FROM (SELECT stat_month, dim_value, quantile_cont(pp, 0.025) AS lo, quantile_cont(pp, 0.975) AS hi FROM pp GROUP BY ALL)""",
             f"dd AS (SELECT stat_month, d, dim_value, CAST(gmv AS DOUBLE) AS gmv FROM {daily} WHERE dim_value IS NOT NULL)",
             slots("dd"), month_weights(label, B_STRUCTURE),
             "cell AS (SELECT stat_month, slot, dim_value, sum(gmv) AS gmv FROM dd JOIN slots USING (stat_month, d) GROUP BY ALL)",
             "rg AS (SELECT stat_month, rep, dim_value, sum(w * gmv) AS g FROM weights JOIN cell USING (stat_month, slot) GROUP BY ALL)",
             "rt AS (SELECT stat_month, rep, sum(g) AS t FROM rg GROUP BY ALL)",
             "members AS (SELECT DISTINCT p.stat_month, p.prev_month, dim_value FROM pairs p JOIN (SELECT DISTINCT stat_month, dim_value FROM dd) c "
             "ON c.stat_month IN (p.stat_month, p.prev_month))",
             "pp AS (SELECT m.stat_month, m.dim_value, (coalesce(a.g, 0) - coalesce(b.g, 0)) / t.t * 100 AS pp FROM members m "
             "JOIN rt t ON t.stat_month = m.prev_month AND t.t > 0 "
             "LEFT JOIN rg a ON a.stat_month = m.stat_month AND a.rep = t.rep AND a.dim_value = m.dim_value "
             "LEFT JOIN rg b ON b.stat_month = m.prev_month AND b.rep = t.rep AND b.dim_value = m.dim_value)")


def mann_kendall(series: str, key: str) -> list[str]:
    return [f"mk0 AS (SELECT {key}, t, CAST(y AS DOUBLE) AS y FROM {series} WHERE y IS NOT NULL)",
            f"mks AS (SELECT a.{key}, sum(sign(b.y - a.y)) AS s FROM mk0 a JOIN mk0 b ON a.{key} = b.{key} AND a.t < b.t GROUP BY ALL)",
            f"mkt AS (SELECT {key}, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT {key}, y, count(*) AS c FROM mk0 GROUP BY ALL) GROUP BY ALL)",
            f"mk1 AS (SELECT *, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS v FROM mkt JOIN mks USING ({key}))",
            "mk2 AS (SELECT *, CASE WHEN v <= 0 THEN 0 ELSE (s - sign(s)) / sqrt(v) END AS z, s / (n * (n - 1) / 2.0) AS tau, "
            "(n * (n - 1) / 2.0 - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) AS zmin FROM mk1)",
            f"mk AS (SELECT *, {p2('z')} AS p_value, {p2('zmin')} AS min_p FROM mk2)"]


MK_COLS = (f"{i('n')} AS n, {r('s')} AS s, {r('z', 5)} AS z, {r('tau', 5)} AS tau, {r('p_value')} AS p_value, {r('min_p')} AS min_p, "
           f"{i('CASE WHEN min_p < 0.05 THEN 1 ELSE 0 END')} AS can_detect, CASE WHEN p_value < 0.05 THEN CASE WHEN z > 0 THEN 'increasing' "
           "ELSE 'decreasing' END WHEN min_p >= 0.05 THEN 'insufficient' ELSE 'no trend' END AS trend")


def tests(k: str, n: str, family: str, src: str, min_n: int) -> list[str]:
    """Wilson, z, p and BH q on ``src`` (which carries p0)."""
    wil = (f"({k}::DOUBLE/{n} + {Z}*{Z}/(2.0*{n}))/(1+{Z}*{Z}/{n})",
           f"{Z}*sqrt(({k}::DOUBLE/{n})*(1-{k}::DOUBLE/{n})/{n} + {Z}*{Z}/(4.0*{n}*{n}))/(1+{Z}*{Z}/{n})")
    return [f"t1 AS (SELECT *, {k}::DOUBLE / {n} AS rate, {wil[0]} - {wil[1]} AS rate_low, {wil[0]} + {wil[1]} AS rate_high, "
            f"CASE WHEN {n} >= {min_n} AND p0 > 0 AND p0 < 1 THEN ({k}::DOUBLE / {n} - p0) / sqrt(p0 * (1 - p0) / {n}) END AS z FROM {src})",
            f"t2 AS (SELECT *, {p2('z')} AS p FROM t1)",
            f"t3 AS (SELECT *, CASE WHEN p IS NOT NULL THEN p * count(p) OVER (PARTITION BY {family}) / row_number() OVER (PARTITION BY {family}, p IS NULL ORDER BY p) END AS q0 FROM t2)",
            f"t4 AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(q0) OVER (PARTITION BY {family}, p IS NULL ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM t3)"]


TEST_COLS = (f"{r('rate_low')} AS rate_low, {r('rate_high')} AS rate_high, {r('(rate - p0) * 100', 5)} AS diff_vs_overall_pp, {r('z', 5)} AS z_stat, "
             f"{r('p')} AS p_value_raw, {r('q')} AS p_value_fdr, {i('CASE WHEN q < 0.05 THEN 1 WHEN q IS NOT NULL THEN 0 END')} AS is_significant")


def km(src: str, key: str, time: str = "t", event: str = "ev") -> list[str]:
    part = f"PARTITION BY {key}" if key else ""
    k = f"{key}, " if key else ""
    return [f"k1 AS (SELECT {k}{time} AS t, count(*) AS x, sum({event}) AS dd FROM {src} GROUP BY ALL)",
            f"k2 AS (SELECT *, sum(x) OVER ({part} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM k1)",
            f"k3 AS (SELECT *, product(1 - dd / n::DOUBLE) OVER ({part} ORDER BY t) AS s, "
            f"sum(CASE WHEN n > dd THEN dd / (n::DOUBLE * (n - dd)) ELSE 0 END) OVER ({part} ORDER BY t) AS gw FROM k2 WHERE dd > 0)",
            f"k4 AS (SELECT *, CASE WHEN s > 0 AND s < 1 THEN sqrt(gw) / abs(ln(s)) END AS se FROM k3)",
            f"curve AS (SELECT {k}t, n AS at_risk, dd AS events, {r('s')} AS surv, {r(f'CASE WHEN se IS NULL THEN s ELSE pow(s, exp({Z} * se)) END')} AS ci_low, "
            f"{r(f'CASE WHEN se IS NULL THEN s ELSE pow(s, exp(-{Z} * se)) END')} AS ci_high FROM k4)"]


def logrank(src: str, key: str) -> list[str]:
    """``src`` has key, side (0/1), t, ev."""
    return [f"l1 AS (SELECT {key}, t, sum(1 - side) AS x0, sum(side) AS x1, sum(ev * (1 - side)) AS d0, sum(ev * side) AS d1 FROM {src} GROUP BY ALL)",
            f"l2 AS (SELECT *, sum(x0) OVER w AS n0, sum(x1) OVER w AS n1 FROM l1 WINDOW w AS (PARTITION BY {key} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
            f"l3 AS (SELECT {key}, sum(d1)::DOUBLE AS observed, sum((d0 + d1) * n1::DOUBLE / (n0 + n1)) AS expected, "
            f"sum(n1::DOUBLE * n0 * (d0 + d1) * (n0 + n1 - d0 - d1) / ((n0 + n1)::DOUBLE * (n0 + n1) * (n0 + n1 - 1))) AS variance "
            f"FROM l2 WHERE d0 + d1 > 0 AND n0 + n1 > 1 GROUP BY ALL)",
            f"lr AS (SELECT *, CASE WHEN variance > 0 THEN pow(observed - expected, 2) / variance END AS chi2, {p2('sqrt(CASE WHEN variance > 0 THEN pow(observed - expected, 2) / variance END)')} AS p_value FROM l3)"]


def breaks() -> list[str]:
    """Binary segmentation of ``series`` (key, stat_month, y), one round after the other."""
    out = ["n0 AS (SELECT *, n >= 6 AND var > 0 AND rng > 1e-12 * greatest(1.0, abs(mu)) AS live, 0 AS seg, 0 AS bp FROM ("
           "SELECT *, avg(c * c) OVER (PARTITION BY key) AS var FROM (SELECT key, stat_month, row_number() OVER (PARTITION BY key ORDER BY stat_month) - 1 AS idx, "
           "y - avg(y) OVER w AS c, avg(y) OVER w AS mu, max(y) OVER w - min(y) OVER w AS rng, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY key))))"]
    for k in range(1, MAX_BREAKS + 1):
        prev = f"n{k - 1}"
        out += [f"p{k} AS (SELECT *, count(*) OVER a AS kk, coalesce(sum(c) OVER a, 0) AS s, count(*) OVER b AS m, sum(c) OVER b AS tot FROM {prev} "
                "WINDOW a AS (PARTITION BY key, seg ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY key, seg))",
                f"g{k} AS (SELECT *, CASE WHEN live AND kk >= 3 AND m - kk >= 3 THEN s * s / kk + (tot - s) * (tot - s) / (m - kk) - tot * tot / m END AS gain FROM p{k})",
                f"b{k} AS (SELECT key, gain AS bg, seg AS bs, idx AS bi FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gain DESC NULLS LAST, seg, idx) AS rk FROM g{k}) WHERE rk = 1)",
                f"n{k} AS (SELECT key, stat_month, idx, c, var, n, coalesce(bg > 0 AND bg > var * ln(n), false) AS live, "
                f"CASE WHEN coalesce(bg > 0 AND bg > var * ln(n), false) AND seg = bs THEN CASE WHEN idx < bi THEN {2 * k} ELSE {2 * k + 1} END ELSE seg END AS seg, "
                f"CASE WHEN coalesce(bg > 0 AND bg > var * ln(n), false) AND seg = bs AND idx = bi THEN 1 ELSE bp END AS bp FROM {prev} JOIN b{k} USING (key))"]
    return out


def segments(name: str, vals: str) -> str:
    """Trend per segment of every series of ``vals`` (key, stat_month, gmv)."""
    few = lambda x: f"CASE WHEN k.n >= 4 THEN {x} END"
    return q(f"""SELECT g.key AS {name}, {i('g.segment_id')} AS segment_id, {d('g.a')} AS from_t, {d('g.b')} AS to_t, {r('g.fv', 2)} AS first_value, {r('g.lv', 2)} AS last_value,
        {i('g.points')} AS points, {i('k.n')} AS n, {r(few('k.s'))} AS s, {r(few('k.z'), 5)} AS z, {r(few('k.tau'), 5)} AS tau, {r(few('k.p_value'))} AS p_value, {r(few('k.min_p'))} AS min_p,
        {i(f"CASE WHEN {few('k.min_p')} < 0.05 THEN 1 ELSE 0 END")} AS can_detect,
        CASE WHEN k.n < 4 THEN 'too few' WHEN k.p_value < 0.05 THEN CASE WHEN k.z > 0 THEN 'increasing' ELSE 'decreasing' END WHEN k.min_p >= 0.05 THEN 'insufficient' ELSE 'no trend' END AS trend,
        {r('sl', 7)} AS slope_log, {r('(exp(sl) - 1) * 100', 4)} AS growth_pct,
        {i(f"CASE WHEN g.points >= 4 AND NOT coalesce({few('k.min_p')} < 0.05, false) THEN 1 ELSE 0 END")} AS power_warning
      FROM seg g LEFT JOIN mk k USING (ks) LEFT JOIN lsl USING (ks)""",
             f"vals AS ({vals})", "series AS (SELECT key, stat_month, ln(CAST(gmv AS DOUBLE)) AS y FROM vals)", *breaks(),
             f"pts AS (SELECT v.key, v.stat_month, CAST(v.gmv AS DOUBLE) AS gmv, sum(bp) OVER (PARTITION BY v.key ORDER BY idx) AS segment_id FROM n{MAX_BREAKS} n JOIN vals v ON v.key = n.key AND v.stat_month = n.stat_month)",
             "ptk AS (SELECT *, key || '#' || segment_id AS ks FROM pts)",
             "seg AS (SELECT ks, key, segment_id, min(stat_month) AS a, max(stat_month) AS b, arg_min(gmv, stat_month) AS fv, arg_max(gmv, stat_month) AS lv, count(*) AS points FROM ptk GROUP BY ALL)",
             "lsl AS (SELECT ks, CASE WHEN count(*) >= 3 THEN regr_slope(ln(gmv), x) END AS sl FROM (SELECT *, row_number() OVER (PARTITION BY ks ORDER BY stat_month) AS x FROM ptk WHERE gmv > 0) GROUP BY ks)",
             "mkin AS (SELECT ks, stat_month AS t, gmv AS y FROM ptk)", *mann_kendall("mkin", "ks"))


def naive(hz: int) -> str:
    return q(f"""SELECT {i('nt')} AS n_treat, {i('nc')} AS n_control, {r('mt')} AS treat_value, {r('mc')} AS control_value, {r('mt - mc')} AS diff,
      {r(f'mt - mc - {Z} * se')} AS ci_low, {r(f'mt - mc + {Z} * se')} AS ci_high, {r(p2('(mt - mc) / se'))} AS p_value,
      {i(f'CASE WHEN abs((mt - mc) / se) > {Z} THEN 1 ELSE 0 END')} AS is_significant
      FROM (SELECT *, sqrt(vt / nt + vc / nc) AS se FROM (SELECT sum(tr) AS nt, sum(1 - tr) AS nc, avg(CASE WHEN tr = 1 THEN y END) AS mt,
        avg(CASE WHEN tr = 0 THEN y END) AS mc, var_samp(CASE WHEN tr = 1 THEN y END) AS vt, var_samp(CASE WHEN tr = 0 THEN y END) AS vc
        FROM (SELECT first_is_late AS tr, CASE WHEN event = 1 AND days_to_repeat <= {hz} THEN 1 ELSE 0 END AS y FROM first
              WHERE tenure_days >= {hz} AND first_is_late IS NOT NULL)))""")


def spearman(src: str, x: str, y: str, student: bool = False) -> str:
    t = "rho * sqrt((n - 2) / (1 - rho * rho))"
    return q(f"""SELECT {i('n')} AS n, {r('rho')} AS rho, {r(pt(t, 'n - 2') if student else p2(t))} AS p_value
      FROM (SELECT count(*) AS n, corr(rx, ry) AS rho FROM (
        SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
               rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
        FROM (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)))""")


MWU = ["mw1 AS (SELECT review_score AS v, count(*) AS c, sum(1 - is_late) AS c0 FROM scored GROUP BY ALL)",
       "mw2 AS (SELECT *, coalesce(sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0 AS mr FROM mw1)",
       "mw3 AS (SELECT sum(c0)::DOUBLE AS n0, sum(c - c0)::DOUBLE AS n1, sum(c0 * mr) - sum(c0) * (sum(c0) + 1) / 2.0 AS u, "
       "sum(c::DOUBLE * c * c - c) AS tie FROM mw2)",
       "mw AS (SELECT *, (greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - tie / ((n0 + n1) * (n0 + n1 - 1)))) AS z FROM mw3)"]

EXPERIENCE = """qs AS (SELECT quantile_cont(CAST(first_amount AS DOUBLE), 0.25) AS a, quantile_cont(CAST(first_amount AS DOUBLE), 0.5) AS b,
  quantile_cont(CAST(first_amount AS DOUBLE), 0.75) AS c FROM first),
exp_long AS (SELECT event, unnest([
  {'t': 'first_is_late', 'v': coalesce(CAST(first_is_late AS VARCHAR), 'unknown')},
  {'t': 'first_score', 'v': coalesce(CAST(first_review_score AS VARCHAR), 'unknown')},
  {'t': 'first_amount_q', 'v': CASE WHEN CAST(first_amount AS DOUBLE) <= a THEN 'q1' WHEN CAST(first_amount AS DOUBLE) <= b THEN 'q2' WHEN CAST(first_amount AS DOUBLE) <= c THEN 'q3' ELSE 'q4' END},
  {'t': 'first_dist_km', 'v': CASE WHEN first_dist_km IS NULL THEN 'unknown' WHEN first_dist_km < 500 THEN 'under_500' WHEN first_dist_km < 2000 THEN '500_2000' WHEN first_dist_km < 8000 THEN '2000_8000' ELSE '8000_up' END},
  {'t': 'first_item_cnt', 'v': CASE WHEN first_item_cnt >= 3 THEN '3+' ELSE CAST(first_item_cnt AS VARCHAR) END},
  {'t': 'first_state', 'v': coalesce(first_state, 'unknown')},
  {'t': 'first_cohort_month', 'v': strftime(first_cohort_month, '%Y-%m')}]) AS e FROM first, qs),
exp_base AS (SELECT e.t AS dim_type, e.v AS dim_value, count(*) AS customers, sum(event) AS repeat_customers FROM exp_long GROUP BY ALL)"""

CURVE_GROUPS = """grp AS (SELECT 'all' AS g, t, ev FROM cens UNION ALL SELECT 'first_late', t, ev FROM cens WHERE first_is_late = 1
  UNION ALL SELECT 'first_ontime', t, ev FROM cens WHERE first_is_late = 0 UNION ALL SELECT 'first_bad_review', t, ev FROM cens WHERE first_review_score <= 2
  UNION ALL SELECT 'first_good_review', t, ev FROM cens WHERE first_review_score >= 4)"""

BALANCE = """h AS (SELECT *, first_is_late AS tr FROM first WHERE tenure_days >= 365 AND first_is_late IS NOT NULL),
tops AS (SELECT first_state AS s FROM h WHERE first_state IS NOT NULL GROUP BY first_state ORDER BY count(*) DESC, first_state LIMIT 10),
cov AS (SELECT tr, unnest([{'c': 'log_amount', 'x': ln(1 + greatest(0, CAST(coalesce(first_amount, 0) AS DOUBLE)))},
  {'c': 'item_cnt', 'x': CAST(coalesce(first_item_cnt, 1) AS DOUBLE)}, {'c': 'seller_cnt', 'x': CAST(coalesce(first_seller_cnt, 1) AS DOUBLE)},
  {'c': 'log_dist', 'x': ln(1 + coalesce(first_dist_km, 0.0))}, {'c': 'dist_missing', 'x': CASE WHEN first_dist_km IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE},
  {'c': 'installments', 'x': CAST(coalesce(first_installments, 1) AS DOUBLE)}, {'c': 'pay_type_cnt', 'x': CAST(coalesce(first_pay_type_cnt, 1) AS DOUBLE)},
  {'c': 'freight_ratio', 'x': coalesce(first_freight_ratio, 0.0)},
  {'c': 'cohort_index', 'x': CAST((year(first_cohort_month) - 2017) * 12 + month(first_cohort_month) AS DOUBLE)}]) AS u FROM h
  UNION ALL SELECT tr, {'c': 'state_' || s, 'x': CASE WHEN first_state = s THEN 1.0 ELSE 0.0 END::DOUBLE} FROM h, tops),
smd AS (SELECT u.c AS covariate, avg(CASE WHEN tr = 1 THEN u.x END) - avg(CASE WHEN tr = 0 THEN u.x END) AS diff,
  sqrt((var_samp(CASE WHEN tr = 1 THEN u.x END) + var_samp(CASE WHEN tr = 0 THEN u.x END)) / 2) AS sd FROM cov GROUP BY ALL)"""


def history(pairs: str, key: str, name: str) -> str:
    return f"""{name}_p AS ({pairs}),
{name}_h AS (SELECT {key}, purchase_ts, sum(n) OVER w AS pn, sum(b) OVER w AS pb FROM (SELECT {key}, purchase_ts, count(*) AS n, sum(is_bad) AS b FROM {name}_p GROUP BY ALL)
  WINDOW w AS (PARTITION BY {key} ORDER BY purchase_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT order_id, sum(coalesce(pn, 0)) AS cnt, sum(coalesce(pb, 0)) AS bad FROM {name}_p JOIN {name}_h USING ({key}, purchase_ts) GROUP BY order_id)"""


FEATURES = f"""rev AS (SELECT *, CASE WHEN review_score <= 2 THEN 1 ELSE 0 END AS is_bad FROM valid_all WHERE review_score IS NOT NULL),
{history("SELECT DISTINCT items.order_id, items.seller_id, purchase_ts, is_bad FROM items JOIN rev USING (order_id)", "seller_id", "hs")},
{history("SELECT DISTINCT items.order_id, items.category_en, purchase_ts, is_bad FROM items JOIN rev USING (order_id) WHERE items.category_en IS NOT NULL", "category_en", "hc")},
feat AS (SELECT rev.*, date_sub('hour', purchase_ts, estimated_ts) AS estimated_hours,
  CASE WHEN item_amount <> 0 THEN CAST(freight_amount AS DOUBLE) / CAST(item_amount AS DOUBLE) END AS freight_ratio,
  hs.cnt AS seller_hist_cnt, CASE WHEN hs.cnt > 0 THEN hs.bad::DOUBLE / hs.cnt END AS seller_hist_bad_rate,
  hc.cnt AS cat_hist_cnt, CASE WHEN hc.cnt > 0 THEN hc.bad::DOUBLE / hc.cnt END AS cat_hist_bad_rate, isodow(purchase_ts) - 1 AS dow
  FROM rev LEFT JOIN hs USING (order_id) LEFT JOIN hc USING (order_id))"""

BY_SCORE = ("bs AS (SELECT score, count(*) AS n, sum(is_bad) AS pos FROM mscore GROUP BY score)",
            "bt AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n - pos) OVER () AS neg_all, sum(pos) OVER () AS pos_all FROM bs)")

GAIN_K = "greatest(1, CAST(round_even(n * p / 100.0::DOUBLE, 0) AS BIGINT))"


def verdict(b: str) -> str:
    return f"CASE WHEN {b} > 1.0 THEN 'no_go' WHEN {b} > 0.7 THEN 'needs_high_rescue' WHEN {b} > 0.45 THEN 'needs_half_rescue' WHEN {b} IS NOT NULL THEN 'go' END"


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    m = d("stat_month") + " AS stat_month"
    o["month_panel"] = q(f"SELECT {m}, order_cnt, {i('delivered_cnt')} AS delivered_cnt, buyers, {r('gmv')} AS gmv, {r('gmv_all')} AS gmv_all, "
                         f"{r('orders_per_buyer', 8)} AS orders_per_buyer, {r('aov', 8)} AS aov, {i('is_complete_month')} AS is_complete_month FROM panel2")
    o["complete_window"] = q(f"SELECT {d('s')} AS start_month, {d('e')} AS end_month FROM win")
    o["month_pairs"] = q(f"SELECT {m}, {d('prev_month')} AS prev_month FROM pairs")
    o["daily_customer_panel"] = q(f"SELECT {d('d')} AS d, {m}, customer_unique_id, {i('delivered_cnt')} AS delivered_cnt, {r('gmv', 4)} AS gmv FROM daily")
    o["month_states"] = q(f"SELECT {m}, buyers, {i('delivered_cnt')} AS delivered_cnt, {r('gmv', 4)} AS gmv, {r('orders_per_buyer', 8)} AS orders_per_buyer, {r('aov', 8)} AS aov FROM states")
    o["category_month_revenue"] = q(f"SELECT {m}, dim_value, {r('gmv', 4)} AS gmv FROM cat_month")
    o["state_month_revenue"] = q(f"SELECT {m}, dim_value, {r('gmv', 4)} AS gmv FROM state_month_rev")
    o["category_month_items"] = q(f"SELECT {m}, category_en, item_cnt, {r('item_amount', 2)} AS item_amount, {r('freight_amount', 4)} AS freight_amount FROM cat_items")
    o["month_totals"] = q(f"SELECT {m}, {i('delivered_orders')} AS delivered_orders, {i('item_cnt')} AS item_cnt, {r('item_amount', 2)} AS item_amount, "
                          f"{r('freight_amount', 4)} AS freight_amount, {i('delivered_no_item')} AS delivered_no_item FROM tot")
    pct = "CASE WHEN delta_gmv <> 0 THEN contribution_amount / delta_gmv END"
    o["revenue_factors"] = q(f"SELECT {m}, factor, {r('factor_prev', 8)} AS factor_prev, {r('factor_curr', 8)} AS factor_curr, {r('delta_gmv', 3)} AS delta_gmv, "
                             f"{r('contribution_amount', 3)} AS contribution_amount, {r(pct, 5)} AS contribution_pct FROM factors")
    o["revenue_factor_intervals"] = q(
        f"SELECT {m}, factor, {r('q[1]', 2)} AS ci_low, {r('q[2]', 2)} AS ci_high, {i('CASE WHEN q[1] > 0 OR q[2] < 0 THEN 1 ELSE 0 END')} AS is_significant "
        "FROM (SELECT stat_month, factor, quantile_cont(c, [0.025, 0.975]) AS q FROM lm3 GROUP BY ALL)",
        slots("daily"), month_weights("month", B_REVENUE),
        "ds AS (SELECT stat_month, slot, sum(delivered_cnt)::DOUBLE AS dl, CAST(sum(gmv) AS DOUBLE) AS g FROM daily JOIN slots USING (stat_month, d) GROUP BY ALL)",
        "fl AS (SELECT stat_month, rep, sum(w * dl) AS dl, sum(w * g) AS g, bit_or(1::BIGINT << (slot - 1)) AS drawn FROM weights JOIN ds USING (stat_month, slot) GROUP BY ALL)",
        "mk9 AS (SELECT stat_month, mask, count(*) AS n FROM (SELECT stat_month, customer_unique_id, bit_or(1::BIGINT << (slot - 1)) AS mask FROM daily JOIN slots USING (stat_month, d) GROUP BY ALL) GROUP BY ALL)",
        "nb AS (SELECT stat_month, rep, sum(n)::DOUBLE AS b FROM fl JOIN mk9 USING (stat_month) WHERE mask & drawn <> 0 GROUP BY ALL)",
        "bst AS (SELECT stat_month, rep, dl, g, b FROM fl JOIN nb USING (stat_month, rep))",
        "lm AS (SELECT p.stat_month, x.rep, x.g AS v1, y.g AS v0, x.b AS b1, y.b AS b0, x.dl / x.b AS f1, y.dl / y.b AS f0, x.g / x.dl AS a1, y.g / y.dl AS a0 "
        "FROM pairs p JOIN bst x ON x.stat_month = p.stat_month JOIN bst y ON y.stat_month = p.prev_month AND y.rep = x.rep "
        "WHERE least(x.g, y.g, x.b, y.b, x.dl, y.dl) > 0)",
        "lm2 AS (SELECT stat_month, CASE WHEN v1 = v0 THEN 0 ELSE (v1 - v0) / ln(v1 / v0) END AS l, ln(b1 / b0) AS lb, ln(f1 / f0) AS lf, ln(a1 / a0) AS la FROM lm)",
        "lm3 AS (SELECT stat_month, 'buyers' AS factor, l * lb AS c FROM lm2 UNION ALL SELECT stat_month, 'orders_per_buyer', l * lf FROM lm2 UNION ALL SELECT stat_month, 'aov', l * la FROM lm2)")
    o["revenue_factor_significance"] = q(f"SELECT factor, {r('t', 2)} AS total_amount, {i('k')} AS flagged_months, {r('t / sum(t) OVER () * 100', 2)} AS share_pct FROM "
                                         f"(SELECT f.factor, sum(f.contribution_amount) AS t, sum(v.is_significant) AS k FROM factors f JOIN ({o['revenue_factor_intervals']}) v ON v.factor = f.factor AND v.stat_month = {d('f.stat_month')} GROUP BY f.factor)")
    o["revenue_factor_totals"] = q(f"SELECT factor, {r('s', 2)} AS total_amount, {r('s / sum(s) OVER () * 100', 2)} AS share_pct FROM (SELECT factor, sum(contribution_amount) AS s FROM factors GROUP BY ALL)")
    o["revenue_main_driver"] = q(f"SELECT {m}, factor, {r('contribution_amount', 3)} AS contribution_amount FROM (SELECT *, row_number() OVER (PARTITION BY stat_month ORDER BY abs(contribution_amount) DESC, factor DESC) AS k FROM factors) WHERE k = 1")
    o["revenue_waterfall"] = q(
        f"SELECT {m}, factor, {i('seq')} AS seq, {r('contribution_amount', 2)} AS contribution_amount, {r('st', 2)} AS bar_start, {r('st + contribution_amount', 2)} AS bar_end "
        "FROM (SELECT *, coalesce(sum(contribution_amount) OVER (PARTITION BY stat_month ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM "
        "(SELECT *, CASE factor WHEN 'buyers' THEN 1 WHEN 'orders_per_buyer' THEN 2 ELSE 3 END AS seq FROM factors))")
    o["structure_by_category"], o["structure_by_state"] = structure("cat_month"), structure("state_month_rev")
    o["structure_intervals_category"], o["structure_intervals_state"] = structure_ci("cat_daily", "category"), structure_ci("state_daily", "state")
    o["structure_significance_category"] = f"SELECT dim_value, count(*) AS months, {i('sum(is_significant)')} AS flagged_months FROM ({o['structure_intervals_category']}) GROUP BY dim_value"
    o["structure_latest_ends"] = q(
        f"SELECT dim_value, {r('pp', 5)} AS contrib_pp, 'bottom' AS side, lo AS position FROM ranked WHERE lo <= 6 UNION ALL "
        f"SELECT dim_value, {r('pp', 5)}, 'top', hi FROM ranked WHERE hi <= 6", structure_cte("cat_month"),
        "ranked AS (SELECT dim_value, pp, row_number() OVER (ORDER BY pp, dim_value) AS lo, row_number() OVER (ORDER BY pp DESC, dim_value DESC) AS hi FROM "
        "(SELECT dim_value, (g1 - g0) / t0 * 100 AS pp FROM st WHERE t0 > 0 AND t1 > 0 AND (round(g0, 2) <> 0 OR round(g1, 2) <> 0) AND stat_month = (SELECT max(stat_month) FROM pairs)))")
    o["aov_effects"] = q(f"SELECT {m}, {r('aov_prev')} AS aov_prev, {r('aov_curr')} AS aov_curr, {r('delta_aov')} AS delta_aov, factor, "
                         f"{r('contribution_amount')} AS contribution_amount, {r('contribution_amount / delta_aov', 5)} AS contribution_pct FROM aov_long")
    o["aov_detail"] = q(f"SELECT {m}, category_en, {i('n0')} AS item_cnt_prev, {i('n1')} AS item_cnt_curr, {r('s0')} AS share_prev, {r('s1')} AS share_curr, "
                        f"{r('CASE WHEN n0 > 0 THEN m0 / n0 ELSE 0 END', 8)} AS price_prev, {r('CASE WHEN n1 > 0 THEN m1 / n1 ELSE 0 END', 8)} AS price_curr, "
                        f"{r('big_n0 * s0 * (p1 - p0)')} AS price_contrib, {r('big_n0 * p0 * (s1 - s0)')} AS mix_contrib FROM aov_in WHERE n0 <> 0 OR n1 <> 0")
    sign_p = ("least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(neg, pos) AS BIGINT) + 1), lambda k: exp(lgamma(neg + pos + 1) - lgamma(k + 1) "
              "- lgamma(neg + pos - k + 1) - (neg + pos) * ln(2)))))")
    o["aov_effect_window"] = q(
        f"SELECT factor, {r('s', 3)} AS total_amount, {r('a', 3)} AS mean_per_month, {i('neg')} AS negative_months, {i('pos')} AS positive_months, {i('n')} AS months, "
        f"{r(sign_p)} AS sign_test_p, {r('q[1]', 3)} AS ci_low, {r('q[2]', 3)} AS ci_high FROM (SELECT factor, sum(contribution_amount) AS s, avg(contribution_amount) AS a, "
        "sum(CASE WHEN contribution_amount < 0 THEN 1 ELSE 0 END)::DOUBLE AS neg, sum(CASE WHEN contribution_amount > 0 THEN 1 ELSE 0 END)::DOUBLE AS pos, count(*) AS n FROM aov_long GROUP BY ALL) "
        "JOIN (SELECT factor, quantile_cont(m, [0.025, 0.975]) AS q FROM reps GROUP BY ALL) USING (factor)",
        "num AS (SELECT stat_month, row_number() OVER (ORDER BY stat_month) AS blk FROM (SELECT DISTINCT stat_month FROM aov_long))",
        block_weights("month", B_STRUCTURE, "num"),
        "reps AS (SELECT factor, rep, sum(w * contribution_amount) / sum(w) AS m FROM bw JOIN num USING (blk) JOIN aov_long USING (stat_month) GROUP BY ALL)")
    o["aov_category_totals"] = q(
        f"SELECT category_en, {r('sum(big_n0 * s0 * (p1 - p0))', 3)} AS price_total, {r('sum(big_n0 * p0 * (s1 - s0))', 3)} AS mix_total, "
        f"{i('arg_min(n0, stat_month)')} AS first_items, {i('arg_max(n1, stat_month)')} AS last_items FROM aov_in WHERE n0 <> 0 OR n1 <> 0 GROUP BY category_en")
    # trend
    o["trend_by_state"] = q(f"SELECT dim_value, {MK_COLS} FROM mk", "series AS (SELECT dim_value, stat_month AS t, gmv AS y FROM state_month_rev)", *mann_kendall("series", "dim_value"))
    o["log_slope_by_category"] = q(f"SELECT dim_value, {r('CASE WHEN count(*) >= 3 THEN regr_slope(ly, x) END', 7)} AS slope_log FROM "
                                   "(SELECT dim_value, ln(CAST(gmv AS DOUBLE)) AS ly, row_number() OVER (PARTITION BY dim_value ORDER BY stat_month) AS x FROM cat_month WHERE gmv > 0) GROUP BY dim_value")
    o["change_points_by_category"] = q(f"SELECT key AS dim_value, {m}, {i('idx')} AS idx, {i('bp')} AS breakpoint_flag, "
                                       f"{i('sum(bp) OVER (PARTITION BY key ORDER BY idx)')} AS segment_id FROM n{MAX_BREAKS}",
                                       "series AS (SELECT dim_value AS key, stat_month, ln(CAST(gmv AS DOUBLE)) AS y FROM cat_month)", *breaks())
    o["trend_segments_by_category"] = segments("dim_value", "SELECT dim_value AS key, stat_month, gmv FROM cat_month")
    o["revenue_trend_segments"] = segments("series", "SELECT 'gmv' AS key, stat_month, gmv FROM panel, win WHERE stat_month BETWEEN s AND e")
    o["tail_diagnostic"] = q(
        f"SELECT {m}, {r('gmv', 2)} AS gmv, {r('gmv_all', 2)} AS gmv_all, {r('s', 5)} AS delivered_share, {r('med', 5)} AS median_share, {i('CASE WHEN s < med * 0.98 THEN 1 ELSE 0 END')} AS is_truncated FROM "
        "(SELECT *, median(s) OVER () AS med FROM (SELECT panel.*, CAST(gmv AS DOUBLE) / CAST(gmv_all AS DOUBLE) AS s FROM panel, win WHERE stat_month BETWEEN win.s AND win.e)) ORDER BY stat_month DESC LIMIT 3")
    # delivery
    o["fulfilment_monthly"] = q(f"SELECT {m}, order_cnt, {i('valid_cnt')} AS valid_cnt, {i('late_cnt')} AS late_cnt, {r('delivered_ratio')} AS delivered_ratio, {r('late_rate')} AS late_rate FROM fulfil")
    o["late_rate_trend"] = q(
        f"SELECT series, {r('f')} AS first_rate, {r('l')} AS last_rate, {r('a')} AS mean_rate, {MK_COLS} FROM mk JOIN (SELECT series, arg_min(y, t) AS f, arg_max(y, t) AS l, avg(y) AS a FROM sr GROUP BY ALL) USING (series)",
        f"sr AS (SELECT 'late_rate' AS series, stat_month AS t, late_rate AS y FROM fulfil, win WHERE stat_month BETWEEN s AND e AND delivered_ratio >= {MIN_RATIO})", *mann_kendall("sr", "series"))
    o["delay_profile"] = q(f"SELECT {bucket('delay_hours')} AS bucket_code, count(*) AS n_orders, count(review_score) AS n_reviewed, {r('avg(review_score)')} AS avg_score, "
                           f"{r('avg(CASE WHEN review_score <= 2 THEN 1 ELSE 0 END)')} AS bad_rate FROM valid_all GROUP BY 1")
    o["dose_response"] = q(
        f"SELECT bucket_code, n AS n_orders, {r('a')} AS avg_score, {r(f'a - {Z} * sqrt(v / n)')} AS score_low, {r(f'a + {Z} * sqrt(v / n)')} AS score_high, {r('a - ca')} AS diff_vs_ontime, "
        f"{r(f'a - ca - {Z} * sqrt(v / n + cv)')} AS diff_low, {r(f'a - ca + {Z} * sqrt(v / n + cv)')} AS diff_high, {i("CASE WHEN bucket_code LIKE 'late%' THEN 1 ELSE 0 END")} AS is_late, "
        f"{i(f'CASE WHEN a - ca - {Z} * sqrt(v / n + cv) > 0 OR a - ca + {Z} * sqrt(v / n + cv) < 0 THEN 1 ELSE 0 END')} AS is_significant FROM g, (SELECT a AS ca, v / n AS cv FROM g WHERE bucket_code = 'early_0_3')",
        "g AS (SELECT bucket_code, count(*) AS n, avg(review_score) AS a, var_samp(review_score) AS v FROM scored GROUP BY ALL)")
    o["mann_whitney_score"] = q(f"SELECT {i('n0')} AS n_0, {i('n1')} AS n_1, {r('u', 1)} AS u_statistic, {r('tie', 0)} AS tie_term, {r('z', 5)} AS z, {r(p2('z'))} AS p_value FROM mw", *MWU)
    o["spearman_delay_score"] = spearman("scored", "delay_hours", "review_score")
    o["spearman_distance_lastmile"] = spearman("(SELECT * FROM inside WHERE is_delivered = 1)", "round(avg_distance_km, 3)", "lastmile_hours")
    o["spearman_month_late_rate"] = spearman("(SELECT * FROM fulfil WHERE valid_cnt > 0)", "valid_cnt", "late_rate", student=True)
    o["score_difference"] = q(
        f"SELECT metric, {r('value', 5)} AS value FROM (SELECT 'n_on_time' AS metric, sum(1 - is_late)::DOUBLE AS value FROM scored UNION ALL SELECT 'n_late', sum(is_late) FROM scored "
        "UNION ALL SELECT 'mean_score_on_time', avg(CASE WHEN is_late = 0 THEN review_score END) FROM scored UNION ALL SELECT 'mean_score_late', avg(CASE WHEN is_late = 1 THEN review_score END) FROM scored "
        "UNION ALL SELECT 'mean_diff', avg(CASE WHEN is_late = 1 THEN review_score END) - avg(CASE WHEN is_late = 0 THEN review_score END) FROM scored "
        "UNION ALL SELECT 'mean_diff_ci_low', quantile_cont(x, 0.025) FROM reps UNION ALL SELECT 'mean_diff_ci_high', quantile_cont(x, 0.975) FROM reps "
        f"UNION ALL SELECT 'mw_u_statistic', u FROM mw UNION ALL SELECT 'mw_p_value', {p2('z')} FROM mw "
        f"UNION ALL SELECT 'spearman_delay_score', rho FROM sp UNION ALL SELECT 'spearman_p_value', {p2('rho * sqrt((n - 2) / (1 - rho * rho))')} FROM sp)",
        "per AS (SELECT d, row_number() OVER (ORDER BY d) AS blk, sum(1 - is_late) AS n0, sum(is_late) AS n1, sum((1 - is_late) * review_score) AS s0, sum(is_late * review_score) AS s1 FROM scored GROUP BY d)",
        block_weights("diff", B_DELIVERY, "per"),
        "reps AS (SELECT rep, CAST(sum(w * s1) AS DOUBLE) / sum(w * n1) - CAST(sum(w * s0) AS DOUBLE) / sum(w * n0) AS x FROM bw JOIN per USING (blk) GROUP BY rep)", *MWU,
        "sp AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT rank() OVER (ORDER BY delay_hours) + (count(*) OVER (PARTITION BY delay_hours) - 1) / 2.0 AS rx, "
        "rank() OVER (ORDER BY review_score) + (count(*) OVER (PARTITION BY review_score) - 1) / 2.0 AS ry FROM scored))")
    o["bottleneck_base"] = q(f"SELECT dim_type, dim_value, {m}, delivered_cnt, {i('late_cnt')} AS late_cnt, {r('gmv', 4)} AS gmv, {r('avg_lastmile_hours', 5)} AS avg_lastmile_hours, "
                             f"{r('avg_distance_km', 4)} AS avg_distance_km, {r('avg_review_score')} AS avg_review_score FROM bbase")
    wm = lambda c: f"sum({c} * CASE WHEN {c} IS NOT NULL THEN delivered_cnt END) / sum(CASE WHEN {c} IS NOT NULL THEN delivered_cnt END)"
    o["bottleneck_table"] = q(
        f"SELECT dim_type, dim_value, {i('delivered_cnt')} AS delivered_cnt, {i('late_cnt')} AS late_cnt, {r('gmv', 4)} AS gmv, {r('lm', 5)} AS avg_lastmile_hours, {r('km', 4)} AS avg_distance_km, "
        f"{r('rs')} AS avg_review_score, {r('rate')} AS late_rate, {TEST_COLS} FROM t4",
        f"g AS (SELECT *, CAST(sum(late_cnt) OVER (PARTITION BY dim_type) AS DOUBLE) / CAST(sum(delivered_cnt) OVER (PARTITION BY dim_type) AS DOUBLE) AS p0 FROM (SELECT dim_type, dim_value, sum(delivered_cnt) AS delivered_cnt, sum(late_cnt) AS late_cnt, "
        f"sum(gmv) AS gmv, {wm('avg_lastmile_hours')} AS lm, {wm('avg_distance_km')} AS km, {wm('avg_review_score')} AS rs FROM bbase GROUP BY ALL))", *tests("late_cnt", "delivered_cnt", "dim_type", "g", 100))
    o["stage_durations"] = q(
        f"SELECT stage_code, group_code, {i('sum(n)')} AS n_orders, {r('sum(s) / sum(n)', 4)} AS mean_hours, {r('any_value(q[1])', 4)} AS ci_low, {r('any_value(q[2])', 4)} AS ci_high FROM per "
        "JOIN (SELECT k, quantile_cont(m, [0.025, 0.975]) AS q FROM reps GROUP BY ALL) USING (k) GROUP BY ALL",
        "sl AS (SELECT d, CASE WHEN is_late = 1 THEN 'late' ELSE 'on_time' END AS group_code, unnest([{'c': 'approve', 'h': approve_hours}, {'c': 'carrier', 'h': carrier_hours}, {'c': 'lastmile', 'h': lastmile_hours}, {'c': 'total', 'h': total_delivery_hours}]) AS u FROM valid)",
        "per0 AS (SELECT u.c AS stage_code, group_code, u.c || '|' || group_code AS k, d, count(*) AS n, sum(u.h) AS s FROM sl WHERE u.h IS NOT NULL GROUP BY ALL)",
        "per AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS blk FROM per0)",
        block_weights("stage", B_DELIVERY, "per", "k", "'|' || k"),
        "reps AS (SELECT k, rep, sum(w * s) / sum(w * n) AS m FROM bw JOIN per USING (k, blk) GROUP BY ALL)")
    # subject tables
    o["daily_revenue"] = q(f"SELECT {d('d')} AS d, count(*) AS order_cnt, {i('sum(is_delivered)')} AS delivered_cnt, {r('sum(CASE WHEN is_delivered = 1 THEN order_amount ELSE 0 END)', 4)} AS gmv FROM ow GROUP BY ow.d")
    o["seller_table"] = q(f"SELECT seller_id, count(*) AS order_cnt, {i('sum(n)')} AS item_cnt, {r('sum(v)', 4)} AS gmv, {r('avg(is_late)')} AS late_rate, {r('avg(review_score)')} AS avg_review_score FROM "
                          "(SELECT order_id, seller_id, count(*) AS n, sum(price + freight_value) AS v FROM items GROUP BY ALL) x JOIN (SELECT order_id, is_late, review_score FROM ow WHERE is_delivered = 1) y USING (order_id) GROUP BY seller_id")
    o["state_month"] = q(f"SELECT {m}, customer_state, count(*) AS order_cnt, count(DISTINCT customer_unique_id) AS buyers, {r('sum(order_amount)', 4)} AS gmv FROM ow WHERE is_delivered = 1 AND customer_state IS NOT NULL GROUP BY ow.stat_month, customer_state")
    o["retention"] = q(
        f"SELECT {d('cm')} AS cohort_month, {i('k')} AS month_offset, n AS customers, max(CASE WHEN k = 0 THEN n END) OVER (PARTITION BY cm) AS cohort_size, {r('n::DOUBLE / max(CASE WHEN k = 0 THEN n END) OVER (PARTITION BY cm)')} AS retention FROM "
        "(SELECT cm, date_diff('month', cm, stat_month) AS k, count(DISTINCT customer_unique_id) AS n FROM (SELECT customer_unique_id, stat_month, min(stat_month) OVER (PARTITION BY customer_unique_id) AS cm FROM ow) GROUP BY ALL)")
    # customers
    o["survival_input"] = q(
        f"SELECT customer_unique_id, {d('first_day')} AS first_day, {i('event')} AS event, days_to_repeat, tenure_days, {d('first_cohort_month')} AS first_cohort_month, {i('first_is_late')} AS first_is_late, "
        f"{i('first_review_score')} AS first_review_score, {r('first_amount', 4)} AS first_amount, {i('first_item_cnt')} AS first_item_cnt, {i('first_seller_cnt')} AS first_seller_cnt, {r('first_dist_km', 4)} AS first_dist_km, "
        f"{i('first_installments')} AS first_installments, {i('first_pay_type_cnt')} AS first_pay_type_cnt, {r('first_freight_ratio')} AS first_freight_ratio, first_state FROM first")
    o["survival_curves"] = q(
        f"SELECT g AS group_code, {i('t')} AS t_days, {i('at_risk')} AS at_risk, {i('events')} AS events, surv, ci_low, ci_high, {i('n_total')} AS n_total, {i('n_event')} AS n_event, {i('median_days')} AS median_days, {r('lr.p_value')} AS logrank_p, {r('1 - surv')} AS cum_ret "
        "FROM curve JOIN (SELECT g, count(*) AS n_total, sum(ev) AS n_event FROM grp GROUP BY ALL) USING (g) JOIN (SELECT g, min(CASE WHEN surv <= 0.5 THEN t END) AS median_days FROM curve GROUP BY ALL) USING (g) "
        "LEFT JOIN lr ON lr.test = CASE WHEN g IN ('first_late', 'first_ontime') THEN 'delivery' WHEN g <> 'all' THEN 'review' END WHERE n_total >= 50",
        CURVE_GROUPS, *km("grp", "g"),
        "sides AS (SELECT CASE WHEN g IN ('first_late', 'first_ontime') THEN 'delivery' ELSE 'review' END AS test, CASE WHEN g IN ('first_ontime', 'first_good_review') THEN 1 ELSE 0 END AS side, t, ev FROM grp WHERE g <> 'all')",
        *logrank("sides", "test"))
    o["logrank_late"] = q(f"SELECT {r('observed')} AS observed, {r('expected', 5)} AS expected, {r('variance', 5)} AS variance, {r('chi2', 5)} AS chi2, {r('p_value')} AS p_value FROM lr",
                          "sides AS (SELECT 1 AS one, 1 - first_is_late AS side, t, ev FROM cens WHERE first_is_late IS NOT NULL)", *logrank("sides", "one"))
    curve_cols = f"{i('t')} AS t_days, {i('at_risk')} AS at_risk, {i('events')} AS events, surv, ci_low, ci_high FROM curve"
    o["survival_by_state"] = q(f"SELECT first_state, {curve_cols}", *km("cens", "first_state"))
    o["survival_first_purchase_event"] = q(
        f"SELECT {curve_cols}",
        "eu AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1, min(CASE WHEN event_type = 'purchase' THEN ts END) AS tp FROM events GROUP BY user_id)",
        "ec AS (SELECT greatest(1, least(72, CASE WHEN tp IS NOT NULL THEN date_sub('hour', t0, tp) ELSE date_sub('hour', t0, t1) END)) AS t, CASE WHEN tp IS NOT NULL AND date_sub('hour', t0, tp) <= 72 THEN 1 ELSE 0 END AS ev FROM eu)",
        *km("ec", ""))
    o["experience_base"] = q(f"SELECT dim_type, dim_value, customers, {i('repeat_customers')} AS repeat_customers FROM exp_base", EXPERIENCE)
    o["repeat_rate_table"] = q(f"SELECT dim_type, dim_value, customers, {i('repeat_customers')} AS repeat_customers, {r('rate')} AS repeat_rate, {TEST_COLS} FROM t4", EXPERIENCE,
                               "eb AS (SELECT *, (SELECT CAST(sum(repeat_customers) AS DOUBLE) / CAST(sum(customers) AS DOUBLE) FROM exp_base WHERE dim_type = 'first_is_late') AS p0 FROM exp_base)",
                               *tests("repeat_customers", "customers", "dim_type", "eb", 200))
    o["naive_effect_180"], o["naive_effect_365"] = naive(180), naive(365)
    o["covariate_balance"] = q(f"SELECT covariate, {r('CASE WHEN sd = 0 THEN 0 ELSE diff / sd END')} AS smd FROM smd", BALANCE)
    o["user_profile"] = q(f"SELECT customer_unique_id, recency_days, order_cnt, {r('monetary', 4)} AS monetary FROM profile")
    o["rfm_cells"] = q(f"SELECT code AS rfm_code, count(rfm_code) AS customers, {r('coalesce(sum(monetary), 0)', 4)} AS monetary, {r('avg(order_cnt)')} AS avg_order_cnt, {r('avg(recency_days)')} AS avg_recency_days, {i('180')} AS thr_recency_days, "
                       f"{r('(SELECT any_value(thr) FROM cells)', 4)} AS thr_monetary FROM (VALUES ('000'), ('001'), ('010'), ('011'), ('100'), ('101'), ('110'), ('111')) v(code) LEFT JOIN cells ON rfm_code = code GROUP BY code")
    o["rfm_segments"] = q(f"SELECT customer_unique_id, recency_days, order_cnt, {r('monetary', 4)} AS monetary, {i('r_score')} AS r_score, {i('f_score')} AS f_score, {i('m_score')} AS m_score, rfm_segment FROM segs")
    c2 = "n * (n - 1) / 2.0"
    o["rfm_agreement"] = q(
        f"SELECT {r('(ix - rr * cc / tt) / ((rr + cc) / 2 - rr * cc / tt)')} AS ari FROM (SELECT (SELECT sum({c2}) FROM (SELECT count(*) AS n FROM segs GROUP BY rfm_code, rfm_segment)) AS ix, (SELECT sum({c2}) FROM (SELECT count(*) AS n FROM segs GROUP BY rfm_code)) AS rr, "
        f"(SELECT sum({c2}) FROM (SELECT count(*) AS n FROM segs GROUP BY rfm_segment)) AS cc, (SELECT {c2} FROM (SELECT count(*) AS n FROM segs)) AS tt)")
    o["rfm_crosstab"] = q("SELECT rfm_code, rfm_segment, count(*) AS n FROM segs GROUP BY ALL")
    z3 = ", ".join(f"(ln(1 + CAST({c} AS DOUBLE)) - avg(ln(1 + CAST({c} AS DOUBLE))) OVER ()) / stddev_pop(ln(1 + CAST({c} AS DOUBLE))) OVER () AS z{k}" for k, c in enumerate(("recency_days", "order_cnt", "monetary")))
    o["cell_silhouette"] = q(
        f"SELECT {r('avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM (SELECT id, any_value(own_n) AS n, max(CASE WHEN own THEN t / (m - 1) END) AS a, min(CASE WHEN NOT own THEN t / m END) AS b FROM dd GROUP BY id)",
        f"zc AS (SELECT customer_unique_id AS id, rfm_code, {z3} FROM cells)",
        "st AS (SELECT rfm_code, count(*) AS m, sum(z0) AS s0, sum(z1) AS s1, sum(z2) AS s2, sum(z0 * z0 + z1 * z1 + z2 * z2) AS qq FROM zc GROUP BY 1)",
        "dd AS (SELECT zc.id, zc.rfm_code = st.rfm_code AS own, st.m, (SELECT m FROM st x WHERE x.rfm_code = zc.rfm_code) AS own_n, "
        "st.m * (z0 * z0 + z1 * z1 + z2 * z2) + qq - 2 * (z0 * s0 + z1 * s1 + z2 * s2) AS t FROM zc, st)")
    o["cell_silhouette_euclidean"] = q(
        f"SELECT {r('avg(CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END)')} AS silhouette FROM (SELECT id, any_value(own_n) AS n, max(CASE WHEN own THEN t / (own_n - 1) END) AS a, min(CASE WHEN NOT own THEN t / m END) AS b FROM ed GROUP BY id)",
        f"zc AS MATERIALIZED (SELECT customer_unique_id AS id, rfm_code, {z3} FROM cells)",
        "ns AS (SELECT rfm_code, count(*) AS m FROM zc GROUP BY 1)",
        "ed AS (SELECT a.id, a.rfm_code = b.rfm_code AS own, any_value(nb.m) AS m, any_value(na.m) AS own_n, "
        "sum(sqrt(pow(a.z0 - b.z0, 2) + pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2))) AS t FROM zc a JOIN ns na ON na.rfm_code = a.rfm_code, zc b JOIN ns nb ON nb.rfm_code = b.rfm_code GROUP BY a.id, a.rfm_code, b.rfm_code)")
    zs = ", ".join(f"{r(f'(ln(1 + greatest(0, CAST({c} AS DOUBLE))) - avg(ln(1 + greatest(0, CAST({c} AS DOUBLE)))) OVER ()) / stddev_pop(ln(1 + greatest(0, CAST({c} AS DOUBLE)))) OVER ()')} AS z_{c}" for c in ("recency_days", "order_cnt", "monetary"))
    o["rfm_standardised"] = q(f"SELECT customer_unique_id, {zs} FROM profile")
    o["price_quartiles_by_category"] = q(f"SELECT category_en, {r('quantile_cont(CAST(price AS DOUBLE), 0.25)', 4)} AS q1, {r('quantile_cont(CAST(price AS DOUBLE), 0.5)', 4)} AS med, {r('quantile_cont(CAST(price AS DOUBLE), 0.75)', 4)} AS q3 FROM items WHERE category_en IS NOT NULL GROUP BY category_en")
    # risk
    dig = {"avg_distance_km": 4, "order_amount": 4}
    o["order_features"] = q(f"SELECT order_id, {m}, {i('is_bad')} AS is_bad, " + ", ".join(f"{r(c, dig.get(c, 6))} AS {c}" for c in RISK_FEATURES) + " FROM feat", FEATURES)
    checks = ", ".join(f"('{c}')" for c in ("leaf_rows", "small_leaves", "leaf_values", "large_trees", "worse_loss"))
    o["leafwise_certificate"] = q(f'SELECT v.c AS "check", (SELECT count(*) FROM feat WHERE stat_month < DATE \'{TEST_MONTH}\') AS rows, CAST(0 AS BIGINT) AS violations FROM (VALUES {checks}) v(c)', FEATURES)
    o["seller_history_answered"] = q(
        "SELECT p.order_id, count(a.order_id) AS seller_hist_cnt, round(sum(a.is_bad)::DOUBLE / nullif(count(a.order_id), 0), 6) + 0.0 AS seller_hist_bad_rate FROM sa p LEFT JOIN sa a ON a.seller_id = p.seller_id AND a.answered_ts < p.purchase_ts GROUP BY p.order_id",
        "sa AS (SELECT DISTINCT order_id, items.seller_id, v.purchase_ts, v.customer_delivered_ts + to_days(CAST(order_id % 40 AS INT)) AS answered_ts, CASE WHEN review_score <= 2 THEN 1 ELSE 0 END AS is_bad "
        "FROM items JOIN valid_all v USING (order_id) WHERE review_score IS NOT NULL)")
    o["average_precision"] = q(f"SELECT {r('sum(pos * cp::DOUBLE / cn) / any_value(pos_all)')} AS average_precision FROM bt", *BY_SCORE)
    o["roc_auc"] = q(f"SELECT {r('sum((n - pos) * ((cp - pos) + 0.5 * pos)) / (any_value(pos_all)::DOUBLE * any_value(neg_all))')} AS roc_auc FROM bt", *BY_SCORE)
    o["brier_score"] = q(f"SELECT {r('avg(pow(score - is_bad, 2))')} AS brier FROM mscore")
    o["f1_threshold_outcome"] = q(
        f"SELECT {i('tp')} AS tp, {i('fp')} AS fp, {i('fn')} AS fn, {i('tn')} AS tn, {r('tp::DOUBLE / greatest(tp + fp, 1)')} AS precision, {r('tp::DOUBLE / greatest(tp + fn, 1)')} AS recall, {r('score')} AS threshold, {r('f1')} AS train_f1 FROM "
        "(SELECT any_value(b.score) AS score, any_value(b.f1) AS f1, sum(CASE WHEN m.score >= b.score AND is_bad = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN m.score >= b.score AND is_bad = 0 THEN 1 ELSE 0 END) AS fp, "
        "sum(CASE WHEN m.score < b.score AND is_bad = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN m.score < b.score AND is_bad = 0 THEN 1 ELSE 0 END) AS tn "
        f"FROM mscore m, (SELECT score, 2.0 * cp / (cn + pa) AS f1 FROM tt ORDER BY f1 DESC, score LIMIT 1) b WHERE m.stat_month >= DATE '{TEST_MONTH}')",
        f"tt AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(pos) OVER () AS pa FROM (SELECT score, count(*) AS n, sum(is_bad) AS pos FROM mscore WHERE stat_month < DATE '{TEST_MONTH}' GROUP BY score))")
    o["gain_table"] = q(
        f"SELECT {i('p')} AS top_pct, {i('nb')} AS n_bad_total, k AS n_orders, {i('c')} AS captured, {r('c::DOUBLE / nb')} AS recall, {r('c::DOUBLE / k')} AS precision, {r('(c::DOUBLE / k) / (nb::DOUBLE / n)')} AS lift, {r('k * 15.0')} AS cost, {r('k * 15.0 / c')} AS cost_per_bad FROM "
        f"(SELECT p, n, nb, {GAIN_K} AS k, (SELECT sum(is_bad) FROM ranked WHERE rk <= {GAIN_K}) AS c FROM (SELECT unnest([{', '.join(map(str, TOP_PCTS))}]) AS p, (SELECT count(*) FROM mscore) AS n, (SELECT sum(is_bad) FROM mscore) AS nb))",
        f"ranked AS (SELECT is_bad, row_number() OVER (ORDER BY score DESC, {h('CAST(order_id AS VARCHAR)')}, order_id) AS rk FROM mscore)")
    # strategies
    cov = f"covered_orders, covered_customers, {r('covered_gmv', 4)} AS covered_gmv, {i('bad_orders')} AS bad_orders"
    o["strategy_by_segment"] = q(f"SELECT strategy, coalesce(rfm_segment, 'none') AS rfm_segment, count(*) AS covered_orders, count(DISTINCT h.customer_unique_id) AS covered_customers, {r('sum(order_amount)', 4)} AS covered_gmv, "
                                 f"{r('avg(is_bad)')} AS bad_rate FROM hits h LEFT JOIN segs s ON s.customer_unique_id = h.customer_unique_id GROUP BY ALL")
    o["strategy_coverage"] = q(f"SELECT strategy, {cov} FROM coverage")
    o["strategy_month"] = q(f"SELECT strategy, {m}, count(*) AS covered_orders, count(DISTINCT customer_unique_id) AS covered_customers, {r('sum(order_amount)', 4)} AS covered_gmv, {i('sum(is_bad)')} AS bad_orders FROM hits GROUP BY strategy, hits.stat_month")
    o["strategy_params"] = q(f"SELECT param_key, {r('param_value', 4)} AS param_value, {i('is_measured')} AS is_measured FROM (SELECT param_key, param_value, 1 AS is_measured FROM measured UNPIVOT (param_value FOR param_key IN (aov_delayed, aov_ontime, baseline_bad_late, baseline_bad_ontime)) "
                             "UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{k}', {float(v)}::DOUBLE, 0)" for k, v in ASSUMED.items()) + "))")
    o["strategy_roi"] = q(
        f"SELECT strategy, {cov}, {r('rescue_rate')} AS rescue_rate, {r('bad_value')} AS bad_value, {r('cost_per_order')} AS cost_per_order, {r('bad_upper', 4)} AS bad_upper, {r('rescued_repeat', 5)} AS rescued_repeat, {r('total_cost', 3)} AS total_cost, "
        f"{r('revenue_review', 3)} AS revenue_review, {r('revenue_repeat', 2)} AS revenue_repeat, {r('revenue_total', 2)} AS revenue_total, {r('revenue_review - total_cost', 2)} AS net_benefit_a, {r('revenue_total - total_cost', 2)} AS net_benefit_b, "
        f"{r('revenue_review / total_cost', 5)} AS roi_a, {r('revenue_total / total_cost', 5)} AS roi_b, {r('total_cost / da', 5)} AS breakeven_p_a, {r('total_cost / db', 5)} AS breakeven_p_b, {verdict('total_cost / db')} AS verdict FROM roi", roi_sql([(RESCUE_RATE, BAD_VALUE)]))
    o["strategy_sensitivity"] = q(
        f"SELECT strategy, {r('rescue_rate')} AS rescue_rate, {r('bad_value')} AS bad_value, {r('total_cost', 3)} AS total_cost, {r('revenue_total', 2)} AS revenue, {r('revenue_total - total_cost', 2)} AS net_benefit, {r('revenue_total / total_cost', 5)} AS roi, "
        f"{i('CASE WHEN revenue_total - total_cost > 0 THEN 1 ELSE 0 END')} AS is_profitable FROM roi", roi_sql([(p, v) for p in RESCUE_RATES for v in BAD_VALUES]))
    o["strategy_budget"] = q(
        f"SELECT {r('budget')} AS budget_level, strategy, {r('alloc', 3)} AS allocated, {i('cov')} AS covered_orders, {r('net', 2)} AS expected_net, {r('er', 4)} AS expected_roi, {r('alloc / budget * 100', 4)} AS alloc_pct FROM ("
        "SELECT budget, strategy, alloc, round_even(covered_orders * alloc / cycle, 0) AS cov, net * alloc / cycle AS net, net / cycle + 1 AS er FROM al WHERE net > 0 AND alloc > 0 "
        "UNION ALL SELECT budget, strategy, 0, 0, 0, NULL FROM al WHERE net <= 0 "
        "UNION ALL SELECT budget, 'unallocated', budget - sum(alloc), 0, 0, NULL FROM al GROUP BY budget HAVING budget - sum(alloc) > 1)",
        roi_sql([(RESCUE_RATE, BAD_VALUE)]),
        "al AS (SELECT *, CASE WHEN net > 0 THEN greatest(0, least(cycle, budget - coalesce(sum(cycle) OVER (PARTITION BY budget, net > 0 ORDER BY net / cycle DESC, strategy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS alloc "
        f"FROM (SELECT strategy, covered_orders, total_cost AS cycle, revenue_total - total_cost AS net FROM roi), (SELECT unnest([{', '.join(str(float(x)) for x in BUDGET_LEVELS)}])::DOUBLE AS budget))")
    one = "(SELECT covered_orders FROM coverage WHERE strategy = '{}')"
    p1, p2_, p3 = (one.format(x) for x in ("p1_expedite", "p2_intercept", "p3_voucher"))
    # cost and revenue order by order, and repeat purchases customer by customer
    A = ASSUMED
    again = f"""again AS (
  SELECT strategy, sum(unit) AS cost, sum(gain) + any_value(repeat) AS revenue FROM (
    SELECT h.strategy, CASE h.strategy WHEN 'p1_expedite' THEN {A['p1_expedite_cost']} WHEN 'p2_intercept' THEN {A['p2_contact_cost']} + {A['p2_redeem_rate']} * {A['p2_voucher_face']}
             ELSE {A['p3_redeem_rate']} * {A['p3_voucher_face']} END::DOUBLE AS unit,
           (baseline_bad_late - baseline_bad_ontime) / 100 * {RESCUE_RATE} * {BAD_VALUE} AS gain,
           CASE h.strategy WHEN 'p1_expedite' THEN (SELECT count(DISTINCT customer_unique_id) FROM hits x WHERE x.strategy = 'p1_expedite')
             * {abs(A['repeat_effect_pp'])} / 100 * {RESCUE_RATE} * aov_delayed ELSE 0 END::DOUBLE AS repeat
    FROM hits h, measured) GROUP BY strategy)"""
    rules = {"coverage_grows": f"SELECT {p1} < {p2_} AND {p2_} < {p3}",
             "late_is_worse": "SELECT baseline_bad_late > baseline_bad_ontime FROM measured",
             "costs_positive": "SELECT bool_and(cost_per_order > 0) FROM costed",
             "roi_identity": "SELECT bool_and(abs(revenue_total / total_cost - revenue / cost) < 1e-9) FROM roi JOIN again USING (strategy)",
             "net_identity": "SELECT bool_and(abs(revenue_total - total_cost - (revenue - cost)) < 1e-6 * greatest(1, abs(revenue))) FROM roi JOIN again USING (strategy)",
             "breakeven_returns_zero": "SELECT coalesce(bool_and(abs(db * (total_cost / db) - total_cost) <= 1e-6 * total_cost), true) FROM roi WHERE total_cost / db <= 1"}
    o["strategy_invariants"] = q(" UNION ALL ".join(f"SELECT '{n}' AS rule, {i(f'({s})')} AS holds" for n, s in rules.items()),
                                 roi_sql([(RESCUE_RATE, BAD_VALUE)]), again)
    # quality and storage
    o["shape_report"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_cnt, count(*) - count({c}) AS null_cnt, {i(f'''sum(CASE WHEN NOT regexp_matches(CAST({c} AS VARCHAR), '{p}') THEN 1 ELSE 0 END)''')} AS misfit_cnt FROM orders"
        for c, p in (("o_orderkey", "^[0-9]+$"), ("o_orderstatus", "^[OFP]$"), ("o_orderpriority", "^[1-5]-[A-Z]"), ("o_custkey", "^[0-9]{1,3}$")))
    o["bad_rows"] = ("SELECT o_orderkey, concat_ws(',', CASE WHEN a THEN 'o_custkey' END, CASE WHEN b THEN 'o_orderpriority' END) AS bad_columns FROM (SELECT o_orderkey, "
                     "NOT regexp_matches(CAST(o_custkey AS VARCHAR), '^[0-9]{1,3}$') AS a, NOT regexp_matches(o_orderpriority, '^[1-4]-') AS b FROM orders) WHERE a OR b")
    o["typed_conversion"] = (f"SELECT event_type, count(*) AS rows, {i('sum(TRY_CAST(json_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ') AS INTEGER))')} AS k_value, "
                             "count(TRY_CAST(substr(event_type, 1, 3) AS INTEGER)) AS words_converted FROM events GROUP BY event_type")
    o["latest_line"] = (f"SELECT l_orderkey, {i('l_linenumber')} AS l_linenumber, l_partkey, {r('l_extendedprice', 2)} AS l_extendedprice, {d('l_shipdate')} AS l_shipdate FROM (SELECT *, row_number() OVER "
                        "(PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1")
    o["duplicate_keys"] = f"SELECT l_orderkey, {i('l_linenumber')} AS l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1"
    o["domain_violations"] = q(f"SELECT 'score_1_to_5' AS rule, {i('sum(CASE WHEN review_score IS NULL OR review_score BETWEEN 1 AND 5 THEN 0 ELSE 1 END)')} AS violations FROM ow UNION ALL "
                               f"SELECT 'late_is_flag', {i('sum(CASE WHEN is_late IN (0, 1) THEN 0 ELSE 1 END)')} FROM ow UNION ALL SELECT 'amount_positive', {i('sum(CASE WHEN order_amount > 0 THEN 0 ELSE 1 END)')} FROM ow")
    o["timestamp_audit"] = ("SELECT o_orderkey, raw_text FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 1000 = 7 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS raw_text FROM orders) "
                            "WHERE try_strptime(raw_text, '%Y-%m-%d %H:%M:%S') IS DISTINCT FROM o_orderdate")
    o["zero_dates"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i(f'coalesce(sum(CASE WHEN {c} < {chr(39)}1000-01-01{chr(39)}::TIMESTAMP THEN 1 ELSE 0 END), 0)')} AS zero_dates FROM {t}"
        for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")))
    o["cross_section_tie_out"] = q(f"SELECT {r('c', 4)} AS by_category, {r('s', 4)} AS by_state, {r('a', 4)} AS overall, {r('c - a', 4)} AS category_gap, {r('s - a', 4)} AS state_gap FROM (SELECT (SELECT sum(gmv) FROM cat_month) AS c, (SELECT sum(gmv) FROM state_month_rev) AS s, "
                                   "(SELECT sum(order_amount) FROM inside WHERE is_delivered = 1) AS a)")
    o["factor_gap"] = q(f"SELECT {r('max(greatest(abs(p.buyers - s.buyers), abs(p.delivered_cnt - s.delivered_cnt), abs(CAST(p.gmv AS DOUBLE) - CAST(s.gmv AS DOUBLE))))')} AS max_gap, count(*) AS months FROM panel p JOIN states s USING (stat_month)")
    gap = "max(abs(coalesce({}, 0) - coalesce({}, 0)))"
    o["grain_gap"] = q(f"SELECT {i(gap.format('t.n', 'c.n'))} AS item_gap, {r(gap.format('CAST(t.a AS DOUBLE)', 'CAST(c.a AS DOUBLE)'))} AS amount_gap, {i(gap.format('t.k', 'p.delivered_cnt'))} AS order_gap "
                       "FROM (SELECT stat_month, sum(item_cnt * is_delivered) AS n, sum(item_amount * is_delivered) AS a, sum(is_delivered) AS k FROM ow GROUP BY 1) t "
                       "FULL JOIN (SELECT ow.stat_month, count(*) AS n, sum(price) AS a FROM items JOIN ow USING (order_id) WHERE is_delivered = 1 AND category_en IS NOT NULL GROUP BY 1) c ON c.stat_month = t.stat_month "
                       "FULL JOIN panel p ON p.stat_month = coalesce(t.stat_month, c.stat_month)")
    o["orders_without_items"] = f"SELECT o_orderkey AS order_id, {d('o_orderdate')} AS purchase_ts FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
    side = lambda v, g: f"max(CASE WHEN group_code = '{g}' THEN {v} END) AS {v}_{g}"
    o["stage_durations_wide"] = (f"SELECT stage_code, {', '.join(side(v, g) for v in ('mean_hours', 'ci_low', 'ci_high') for g in ('late', 'on_time'))} "
                                 f"FROM ({o['stage_durations']}) GROUP BY stage_code")
    o["strategy_sensitivity_wide"] = ("SELECT strategy, " + ", ".join(f"max(CASE WHEN abs(rescue_rate - {p}) < 1e-9 THEN roi END) AS p{round(100 * p)}" for p in RESCUE_RATES)
                                      + f" FROM ({o['strategy_sensitivity']}) WHERE abs(bad_value - {BAD_VALUE}) < 1e-9 GROUP BY strategy")
    o["event_value_trend"] = f"WITH {', '.join(['es AS (SELECT event_type, event_id AS t, value AS y FROM events)', *mann_kendall('es', 'event_type')])} SELECT event_type, {MK_COLS} FROM mk"
    o["multi_line_file"] = (f"SELECT {i('event_id % 100 = 0')} AS is_bad, count(*) AS records, count(*) AS whole, count(*) AS numbered FROM events GROUP BY 1")
    o["keyed_update"] = q(f"SELECT {d('f.stat_month')} AS stat_month, f.order_cnt, {r('CASE WHEN p.stat_month IS NULL THEN -1.0 ELSE p.delivered_cnt::DOUBLE / p.order_cnt END')} AS mk_tau, CASE WHEN p.stat_month IS NULL THEN 'stale' ELSE 'fresh' END AS note "
                          "FROM fulfil f LEFT JOIN (SELECT panel.* FROM panel, win WHERE stat_month BETWEEN s AND e AND gmv > gmv_all * 0.66) p ON p.stat_month = f.stat_month")
    o["published_events"] = (
        "WITH v1 AS (SELECT event_id, CAST(value AS DECIMAL(18,4)) AS value, event_type FROM events), "
        "v2 AS (SELECT * FROM v1 WHERE event_type <> 'purchase' UNION ALL SELECT event_id, CAST(value * 2 AS DECIMAL(18,4)), event_type FROM v1 WHERE event_type = 'purchase' AND event_id % 5 > 0), "
        "v3 AS (SELECT * FROM v2 UNION ALL SELECT event_id, value, 'incident' FROM v1 WHERE event_type = 'error'), "
        "v4 AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(1 AS DECIMAL(18,4)) ELSE value END AS value, event_type FROM v3), "
        "a AS (SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3 UNION ALL SELECT 4, * FROM v4) "
        f"SELECT {i('version')} AS version, event_type, count(*) AS events, {r('sum(value)', 2)} AS value FROM a GROUP BY version, event_type")
    o["bound_query"] = q(f"SELECT {m}, {r('gmv', 2)} AS gmv, order_cnt FROM panel2 WHERE is_complete_month = 1 AND stat_month >= DATE '1997-01-01'")
    return o
