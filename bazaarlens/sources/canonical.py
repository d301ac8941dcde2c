"""Canonical order tables derived from the star-schema test tables.

``orders_wide`` is one row per order, ``order_items`` one row per item. Fields the star
schema does not have (reviews, stage hours, payments, product attributes) are derived by
fixed arithmetic on ids, so they are synthetic by construction.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import great_circle_km, hours_between
from .readers import read_table
from .recovery import store_by_key

__all__ = ["Canonical"]

ESTIMATE_DAYS = 24


class Canonical:
    """Lazy canonical tables over one folder of star-schema parquet tables.

    With ``one_pass`` all that is made of items comes from one stored table of lines, so the item table is read once.
    """

    def __init__(self, spark: SparkSession, base: str, one_pass: bool = False):
        self.spark, self.base, self.one_pass = spark, base, one_pass

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, name, self.base)

    @cached_property
    def lines(self) -> DataFrame:
        """Lines with exact money and the product's category and attributes, stored in buckets by order: one shuffle serves
        every later step that groups or joins them by order."""
        cents, parts = self._cents()
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        part = self.raw("part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("category_en"),
                                       F.col("p_size"), F.length("p_name").alias("_name"))
        rows = (self.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_partkey").alias("product_id"),
                                            cents.alias("_a"), parts.alias("_f"), F.col("l_shipdate").alias("ship_ts"))
                .join(part, "product_id", "left").repartition(n, "order_id"))
        stored = store_by_key(rows, "order_id", n)
        return stored.select("order_id", "seller_id", "product_id", F.lit(1).cast("long").alias("item_cnt"), "_a", "_f", "ship_ts", "category_en", *self._attributes())

    @staticmethod
    def _cents():
        """Price in cents, and price x tax in 1/10000, as integers."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        return cents, cents * F.round(F.col("l_tax") * 100).cast("long")

    @staticmethod
    def _money(total, scale: int):
        unit = F.lit(1).cast("decimal(5,4)") / 10 ** scale
        return (total.cast("decimal(18,0)") * unit.cast(f"decimal(5,{scale})")).cast(f"decimal(18,{scale})")

    @staticmethod
    def _attributes() -> list:
        size = F.col("p_size").cast("long")
        return [(F.lit(1) + size % 5).alias("photos_qty"), (F.col("_name") * 20).alias("description_length"),
                (size * 100).alias("weight_g"), (size * size * 50).alias("volume_cm3")]

    def order_items(self) -> DataFrame:
        """Item rows with category and money."""
        if self.one_pass:
            return self.lines.withColumns({"price": self._money(F.col("_a"), 2), "freight_value": self._money(F.col("_f"), 4)})
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("seller_id"),
            F.col("l_partkey").alias("product_id"), price.alias("price"),
            (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)").alias("freight_value"),
            F.col("l_shipdate").alias("ship_ts"))
        part = self.raw("part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("category_en"))
        return lines.join(part, "product_id", "left")

    def _item_totals(self) -> DataFrame:
        """Exact money per order, added up as integers (cents, and 1/10000 for price x tax), which
        stay in primitive arithmetic over the largest table; decimals appear once per order."""
        cents, parts = self._cents()
        if self.one_pass:
            sums = self.lines.groupBy("order_id").agg(F.sum("item_cnt").alias("item_cnt"), F.sum("_a").alias("_a"), F.sum("_f").alias("_f"), F.max("ship_ts").alias("_ship"))
        else:
            sums = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
                F.count(F.lit(1)).alias("item_cnt"), F.sum(cents).alias("_a"), F.sum(parts).alias("_f"), F.max("l_shipdate").alias("_ship"))
        return sums.select("order_id", "item_cnt", self._money(F.col("_a"), 2).alias("item_amount"), self._money(F.col("_f"), 4).alias("freight_amount"), "_ship")

    def orders_wide(self, state: bool = True) -> DataFrame:
        """One row per order. Without ``state`` the customer tables are not joined at all."""
        o = self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_unique_id"),
            F.col("o_orderdate").alias("purchase_ts"),
            (F.col("o_orderstatus") != "P").cast("int").alias("is_delivered"))
        buyers = (self.raw("customer").join(self.raw("nation"),
                                            F.col("c_nationkey") == F.col("n_nationkey"), "left")
                  .select(F.col("c_custkey").alias("customer_unique_id"),
                          F.col("n_name").alias("customer_state")))
        gap = F.pmod(F.datediff("_ship", "purchase_ts"), F.lit(45))
        delivered = F.when(F.col("is_delivered") == 1,
                           F.col("purchase_ts") + F.make_dt_interval(gap))
        oid = F.col("order_id")
        zero = F.lit(0)
        base_score = 1 + F.pmod(oid * 7 + 3, F.lit(5))
        if state:  # before the totals are joined: these rows are narrow, and what follows stays dealt by order
            o = o.join(buyers, "customer_unique_id", "left")
        wide = o.join(self._item_totals(), "order_id", "left")
        return (wide
                .withColumns({
                    "estimated_ts": F.col("purchase_ts") + F.make_dt_interval(F.lit(ESTIMATE_DAYS)),
                    "customer_delivered_ts": delivered,
                    "item_cnt": F.coalesce("item_cnt", zero),
                    "item_amount": F.coalesce("item_amount", zero.cast("decimal(18,2)")),
                    "freight_amount": F.coalesce("freight_amount", zero.cast("decimal(18,4)")),
                    "approve_hours": F.pmod(oid * 13, F.lit(48)).cast("double"),
                    "carrier_hours": (F.pmod(oid * 29, F.lit(72)) + 6).cast("double"),
                })
                .withColumns({
                    "order_amount": (F.col("item_amount") + F.col("freight_amount")).cast("decimal(18,4)"),
                    "is_late": (F.col("customer_delivered_ts") > F.col("estimated_ts")).cast("int"),
                    "total_delivery_hours": hours_between("purchase_ts", "customer_delivered_ts").cast("double"),
                })
                .withColumns({
                    "review_score": F.when(F.col("is_late").isNotNull(), F.greatest(
                        base_score - 2 * F.col("is_late"), F.lit(1))).cast("int"),
                    "_rest": F.col("total_delivery_hours") - F.col("approve_hours") - F.col("carrier_hours"),
                })
                .withColumn("lastmile_hours", F.when(F.col("_rest") >= 0, F.col("_rest")))
                .drop("_rest", "_ship"))

    def sellers(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("seller_id"),
                                           F.col("s_nationkey").alias("_seller_nation"))

    @staticmethod
    def _centroid(nation):
        return (F.pmod(nation * 37, F.lit(120)) - 60).cast("double"), \
               (F.pmod(nation * 83, F.lit(360)) - 180).cast("double")

    def order_sellers(self) -> DataFrame:
        """Distinct (order, seller); the shuffle carries two ids per row only."""
        if self.one_pass:
            return self.lines.select("order_id", "seller_id").distinct()
        return (self.raw("lineitem").select(F.col("l_orderkey").alias("order_id"),
                                            F.col("l_suppkey").alias("seller_id")).distinct())

    def orders_detail(self, orders: DataFrame | None = None, goods: bool = False) -> DataFrame:
        """``orders_wide`` plus distance, seller count and payments, and on demand product counts and attributes.

        Distance is the mean great-circle distance over the distinct sellers of an order.
        """
        orders = self.orders_wide() if orders is None else orders
        home = (self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
                .select(F.col("o_orderkey").alias("order_id"), F.col("c_nationkey").alias("_buyer_nation")))
        lat1, lng1 = self._centroid(F.col("_buyer_nation"))
        lat2, lng2 = self._centroid(F.col("_seller_nation"))
        legs = (self.order_sellers().join(self.sellers(), "seller_id", "left")
                .groupBy("order_id", "_seller_nation").agg(F.count(F.lit(1)).alias("_n"))
                .join(home, "order_id")
                .withColumn("_km", great_circle_km(lat1, lng1, lat2, lng2))
                .groupBy("order_id").agg(
                    (F.sum(F.col("_km") * F.col("_n")) / F.sum("_n")).alias("avg_distance_km"),
                    F.sum("_n").alias("seller_cnt")))
        oid = F.col("order_id")
        out = (orders.join(legs, "order_id", "left")
               .withColumns({
                   "seller_cnt": F.coalesce("seller_cnt", F.lit(0)),
                   "pay_type_cnt": 1 + (oid % 10 == 0).cast("int"),
                   "has_credit_card": (oid % 4 != 0).cast("int"),
                   "max_installments": (1 + oid % 8).cast("int"),
                   "is_seller_late": (F.col("carrier_hours") > 48).cast("int"),
               }))
        if not goods:
            return out
        parts = (self.lines.groupBy("order_id").agg(
                     F.countDistinct("product_id").alias("product_cnt"), F.max("photos_qty").alias("photos_qty"),
                     F.max("description_length").alias("description_length"),
                     F.sum(F.col("weight_g") * F.col("item_cnt")).alias("weight_g"), F.sum(F.col("volume_cm3") * F.col("item_cnt")).alias("volume_cm3")))
        return out.join(parts, "order_id", "left").withColumn("product_cnt", F.coalesce("product_cnt", F.lit(0)))
