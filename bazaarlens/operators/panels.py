"""Month, day and dimension panels, the complete window and month pairs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import day_of, month_start, ratio
from ..params import MIN_ORDERS_COMPLETE_MONTH

__all__ = ["month_panel", "suggest_min_orders", "complete_window", "within", "month_pairs",
           "daily_customer_panel", "month_states", "daily_dim_panel", "category_month",
           "month_totals", "dim_month", "wide"]


def _delivered(value: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("is_delivered") == 1, value)), F.lit(0))


def month_panel(orders: DataFrame, min_orders: int | Column = MIN_ORDERS_COMPLETE_MONTH) -> DataFrame:
    """One row per month. ``buyers`` counts customers with an order of any status; ``gmv``
    counts delivered orders, ``gmv_all`` every status."""
    g = (orders.where(F.col("purchase_ts").isNotNull())
         .groupBy(month_start("purchase_ts").alias("stat_month"))
         .agg(F.count(F.lit(1)).alias("order_cnt"),
              F.coalesce(F.sum("is_delivered"), F.lit(0)).alias("delivered_cnt"),
              F.countDistinct("customer_unique_id").alias("buyers"),
              F.round(_delivered(F.col("order_amount")), 2).alias("gmv"),
              F.round(F.coalesce(F.sum("order_amount"), F.lit(0)), 2).alias("gmv_all")))
    limit = min_orders if isinstance(min_orders, Column) else F.lit(min_orders)
    return g.withColumns({
        "orders_per_buyer": ratio(F.col("delivered_cnt"), F.col("buyers")),
        "aov": ratio(F.col("gmv"), F.col("delivered_cnt")),
        "is_complete_month": (F.col("order_cnt") >= limit).cast("int")})


def suggest_min_orders(panel: DataFrame) -> Column:
    """Half the median monthly order count, for data smaller than the default expects."""
    return panel.agg(F.floor(F.median("order_cnt") / 2).alias("m")).scalar()


def complete_window(panel: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last complete month; weak months in between stay in.

    One row comes back to the driver, so later scans filter on literals and the parquet
    reader can skip row groups.
    """
    row = panel.where("is_complete_month = 1").agg(F.min("stat_month"), F.max("stat_month")).first()
    if row[0] is None:
        raise ValueError("no month reaches the complete-month threshold")
    return row[0], row[1]


def within(df: DataFrame, window: tuple[dt.date, dt.date], ts: str | None = "purchase_ts",
           month: str = "stat_month") -> DataFrame:
    """Keep the closed month range, on the timestamp itself where there is one."""
    start, end = window
    if ts is None:
        return df.where(F.col(month).between(F.lit(start), F.lit(end)))
    stop = (end.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    lo, hi = (F.lit(f"{d:%Y-%m-%d} 00:00:00").cast(df.schema[ts].dataType) for d in (start, stop))
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))


def month_pairs(months: DataFrame) -> DataFrame:
    """(stat_month, prev_month) for adjacent months that are present, not calendar-adjacent.

    ``months`` has one row per calendar month, so the single ordered window is bounded.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("stat_month")
    return (months.select("stat_month").distinct()
            .withColumn("prev_month", F.lag("stat_month").over(w))
            .where(F.col("prev_month").isNotNull()))


def daily_customer_panel(orders: DataFrame) -> DataFrame:
    """Day x customer: delivered orders and delivered amount."""
    return (orders.where(F.col("purchase_ts").isNotNull())
            .groupBy(day_of("purchase_ts").alias("d"), month_start("purchase_ts").alias("stat_month"),
                     "customer_unique_id")
            .agg(F.coalesce(F.sum("is_delivered"), F.lit(0)).alias("delivered_cnt"),
                 _delivered(F.col("order_amount")).alias("gmv")))


def month_states(daily: DataFrame) -> DataFrame:
    """Monthly state rebuilt from the day x customer panel; buyers are counted anew, not added."""
    return (daily.groupBy("stat_month")
            .agg(F.countDistinct("customer_unique_id").alias("buyers"),
                 F.sum("delivered_cnt").alias("delivered_cnt"), F.sum("gmv").alias("gmv"))
            .withColumns({"orders_per_buyer": ratio(F.col("delivered_cnt"), F.col("buyers")),
                          "aov": ratio(F.col("gmv"), F.col("delivered_cnt"))}))


def _delivered_items(orders: DataFrame, items: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Items of delivered orders by (order, category): one huge order stays as few rows as it
    has categories, so neither the join nor the later grouping sees a hot key."""
    per_order = items.groupBy("order_id", "category_en").agg(*[c.alias(n) for n, c in aggs.items()])
    keep = (orders.where((F.col("is_delivered") == 1) & F.col("purchase_ts").isNotNull())
            .select("order_id", "purchase_ts"))
    return per_order.join(keep, "order_id")


def daily_dim_panel(orders: DataFrame, items: DataFrame, dim: str) -> DataFrame:
    """Day x dimension revenue: price + freight by category, order amount by state."""
    if dim == "category":
        src = (_delivered_items(orders, items, {"_v": F.sum(F.col("price") + F.col("freight_value"))})
               .withColumnRenamed("category_en", "dim_value"))
    elif dim == "state":
        src = (orders.where((F.col("is_delivered") == 1) & F.col("purchase_ts").isNotNull()
                            & F.col("customer_state").isNotNull())
               .select("purchase_ts", F.col("customer_state").alias("dim_value"),
                       F.col("order_amount").alias("_v")))
    else:
        raise ValueError(f"unknown dimension {dim}")
    return (src.groupBy(day_of("purchase_ts").alias("d"), month_start("purchase_ts").alias("stat_month"),
                        "dim_value")
            .agg(F.sum("_v").alias("gmv")))


def dim_month(daily_dim: DataFrame) -> DataFrame:
    """Month x dimension structure base (our definition: the day panel summed up)."""
    return (daily_dim.where(F.col("dim_value").isNotNull())
            .groupBy("stat_month", "dim_value").agg(F.sum("gmv").alias("gmv")))


def category_month(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Month x category of delivered items: count, amount, freight."""
    parts = _delivered_items(orders, items.where(F.col("category_en").isNotNull()), {
        "item_cnt": F.count(F.lit(1)), "item_amount": F.sum("price"),
        "freight_amount": F.sum("freight_value")})
    return (parts.groupBy(month_start("purchase_ts").alias("stat_month"), "category_en")
            .agg(*[F.sum(c).alias(c) for c in ("item_cnt", "item_amount", "freight_amount")]))


def month_totals(orders: DataFrame) -> DataFrame:
    """Month totals of delivered orders, with the delivered orders that have no items."""
    empty = (F.col("is_delivered") == 1) & (F.coalesce("item_cnt", F.lit(0)) == 0)
    return (orders.where(F.col("purchase_ts").isNotNull())
            .groupBy(month_start("purchase_ts").alias("stat_month"))
            .agg(F.coalesce(F.sum("is_delivered"), F.lit(0)).alias("delivered_orders"),
                 *[_delivered(F.col(c)).alias(c) for c in ("item_cnt", "item_amount", "freight_amount")],
                 F.count_if(empty).alias("delivered_no_item")))


WIDE_COLUMNS = 1000   # names that a wide table may have


def wide(df: DataFrame, index: list[str], column: str, values: list[str], names: list | None = None) -> DataFrame:
    """Long to wide: a row per ``index`` and, for each name in ``column`` and each value, a column ``<value>_<name>``, or
    ``<name>`` where there is one value. The first non-null value counts where several rows meet; missing ones are null.

    ``names`` fixes the columns and their order, so no pass is spent on finding them; else they are all distinct names,
    sorted, null left out, and more than WIDE_COLUMNS are an error, not a cut.
    """
    if names is None:
        names = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(WIDE_COLUMNS + 1).collect())
        if len(names) > WIDE_COLUMNS:
            raise ValueError(f"{column} has more than {WIDE_COLUMNS} names")
    label = lambda v, n: str(n) if len(values) == 1 else f"{v}_{n}"
    return df.groupBy(*index).agg(*[F.first(F.when(F.col(column) == n, F.col(v)), ignorenulls=True).alias(label(v, n)) for n in names for v in values])
