"""Analysis parameters that results have to agree on.

Every public operator takes these as keyword defaults, so a caller can override
any of them for one call.
"""

# --- windows and inference ---
MIN_ORDERS_COMPLETE_MONTH = 500
ALPHA = 0.05
SEED = 20260820

# --- bootstrap replicates ---
B_REVENUE = 1000
B_STRUCTURE = 500
B_DELIVERY = 500
B_MATCHED = 500

# --- trend ---
MIN_SEGMENT = 3
MAX_BREAKS = 4

# --- delivery ---
MIN_DELIVERED_RATIO = 0.90
MIN_ORDERS_DIM = 100
# (code, order, exclusive lower bound in hours, inclusive upper bound in hours)
DELAY_BUCKETS = (
    ("early_10p", 1, None, -240),
    ("early_3_10", 2, -240, -72),
    ("early_0_3", 3, -72, 0),
    ("late_0_3", 4, 0, 72),
    ("late_3_7", 5, 72, 168),
    ("late_7_14", 6, 168, 336),
    ("late_14p", 7, 336, None),
)
DELAY_CONTROL = "early_0_3"
STAGES = ("approve", "carrier", "lastmile", "total")

# --- review risk ---
TEST_START = "2018-05-01"
COUPON_COST = 15.0
TOP_PCTS = (1, 2, 5, 10, 20, 30, 50)
RISK_FEATURES = (
    "is_late", "delay_hours", "total_delivery_hours", "lastmile_hours",
    "carrier_hours", "approve_hours", "estimated_hours", "is_seller_late",
    "avg_distance_km",
    "order_amount", "freight_ratio", "item_cnt", "seller_cnt", "product_cnt",
    "pay_type_cnt", "has_credit_card", "max_installments",
    "photos_qty", "description_length", "weight_g", "volume_cm3",
    "seller_hist_cnt", "seller_hist_bad_rate", "cat_hist_cnt", "cat_hist_bad_rate",
    "dow",
)
BOOST_ROUNDS = 300
BOOST_RATE = 0.08
PERMUTATION_REPEATS = 5

# --- customers ---
RECENCY_ACTIVE_DAYS = 180
REPEAT_ORDERS = 2
SURVIVAL_CAP_DAYS = 365
REPEAT_HORIZONS = (180, 365)
MIN_CUSTOMERS_DIM = 200
MIN_CURVE_GROUP = 50
CLUSTER_KS = (2, 3, 4, 5, 6)
CLUSTER_RESTARTS = 10
CALIPER = 0.05
NEIGHBOURS = 64
MIN_ARM = 200
TOP_STATES = 10
BALANCE_LIMIT = 0.1

# --- strategies ---
RESCUE_RATE = 0.5
BAD_VALUE = 40.75
RESCUE_RATES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0)
BAD_VALUES = (20.0, 30.0, 40.75, 60.0, 80.0, 100.0)
BUDGET_LEVELS = (50_000, 100_000, 200_000, 500_000)
STRATEGIES = ("p1_expedite", "p2_intercept", "p3_voucher")
REPEAT_ELIGIBLE = ("p1_expedite",)
STRATEGY_PARAM_KEYS = (
    "p1_expedite_cost", "p2_voucher_face", "p2_redeem_rate", "p2_contact_cost",
    "p3_voucher_face", "p3_redeem_rate", "bad_review_cost", "repeat_effect_pp",
    "aov_delayed", "aov_ontime", "baseline_bad_ontime", "baseline_bad_late",
)
