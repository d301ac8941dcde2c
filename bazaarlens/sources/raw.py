"""Canonical order tables from the raw files: orders joined to items, payments, reviews, customers, sellers, products and places."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import great_circle_km, hours_between
from .recovery import cut_lineage

__all__ = ["RawTables"]

TIME = "yyyy-MM-dd HH:mm:ss"


def _time(c: str) -> Column:
    """Timestamps are text in the raw files; what does not parse is NULL."""
    return F.try_to_timestamp(F.col(c), F.lit(TIME)).cast("timestamp_ntz")


class RawTables:
    """``orders_wide``, ``order_items``, ``order_sellers`` and ``orders_detail`` with the columns of ``Canonical``.

    ``raw`` has the nine frames of ``read_raw``. Our definitions: an order is delivered when its status says so and it has
    a delivery time; of several reviews the one answered last counts; a place is the mean position of its postal code; the
    distance of an order is the mean over its distinct sellers; a seller is late when the carrier got the parcel after the
    earliest shipping limit. Only rows that fit their schema are used.
    """

    def __init__(self, raw: dict[str, DataFrame]):
        self.raw = {n: df.where("_bad IS NULL") if "_bad" in df.columns else df for n, df in raw.items()}

    @cached_property
    def places(self) -> DataFrame:
        return cut_lineage(self.raw["geolocation"].groupBy(F.col("geolocation_zip_code_prefix").alias("zip")).agg(
            F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lng")))

    def order_items(self) -> DataFrame:
        """One row per item with its category in English (the own name where none is given) and product attributes."""
        product = self.raw["products"].join(self.raw["category_translation"], "product_category_name", "left").select(
            "product_id", F.coalesce("product_category_name_english", "product_category_name").alias("category_en"),
            F.col("product_photos_qty").alias("photos_qty"), F.col("product_description_lenght").alias("description_length"),
            F.col("product_weight_g").alias("weight_g"),
            (F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")).alias("volume_cm3"))
        lines = self.raw["order_items"].select(
            "order_id", "seller_id", "product_id", F.col("price").cast("decimal(18,2)").alias("price"),
            F.col("freight_value").cast("decimal(18,4)").alias("freight_value"), _time("shipping_limit_date").alias("ship_ts"))
        return lines.join(product, "product_id", "left")

    def order_sellers(self) -> DataFrame:
        return self.raw["order_items"].select("order_id", "seller_id").distinct()

    def orders_wide(self, state: bool = True) -> DataFrame:
        """One row per order; ``state`` adds customer_state."""
        o = self.raw["orders"].select(
            "order_id", "customer_id", _time("order_purchase_timestamp").alias("purchase_ts"), _time("order_approved_at").alias("_approved"),
            _time("order_delivered_carrier_date").alias("_carrier"), _time("order_delivered_customer_date").alias("customer_delivered_ts"),
            _time("order_estimated_delivery_date").alias("estimated_ts"),
            ((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()).cast("int").alias("is_delivered"))
        buyer = self.raw["customers"].select("customer_id", "customer_unique_id", *(["customer_state"] if state else []))
        items = self.raw["order_items"].groupBy("order_id").agg(
            F.count(F.lit(1)).alias("item_cnt"), F.sum(F.col("price").cast("decimal(18,2)")).alias("item_amount"),
            F.sum(F.col("freight_value").cast("decimal(18,4)")).alias("freight_amount"), F.min(_time("shipping_limit_date")).alias("_limit"))
        last = F.max(F.struct(_time("review_answer_timestamp").alias("t"), "review_id", "review_score"))
        review = self.raw["order_reviews"].groupBy("order_id").agg(last["review_score"].alias("review_score"))
        zero = F.lit(0)
        wide = o.join(buyer, "customer_id", "left").join(items, "order_id", "left").join(review, "order_id", "left")
        done = F.col("is_delivered") == 1
        return wide.withColumns({
            "item_cnt": F.coalesce("item_cnt", zero), "item_amount": F.coalesce("item_amount", zero).cast("decimal(18,2)"),
            "freight_amount": F.coalesce("freight_amount", zero).cast("decimal(18,4)"),
            "customer_delivered_ts": F.when(done, F.col("customer_delivered_ts")),
            "approve_hours": hours_between("purchase_ts", "_approved").cast("double"),
            "carrier_hours": hours_between("_approved", "_carrier").cast("double"),
            "lastmile_hours": F.when(done, hours_between("_carrier", "customer_delivered_ts").cast("double")),
            "is_seller_late": (F.col("_carrier") > F.col("_limit")).cast("int"),
        }).withColumns({
            "order_amount": (F.col("item_amount") + F.col("freight_amount")).cast("decimal(18,4)"),
            "is_late": (F.col("customer_delivered_ts") > F.col("estimated_ts")).cast("int"),
            "total_delivery_hours": hours_between("purchase_ts", "customer_delivered_ts").cast("double"),
        }).drop("_approved", "_carrier", "_limit")

    def orders_detail(self, orders: DataFrame | None = None, goods: bool = False) -> DataFrame:
        """``orders_wide`` plus distance, seller count and payments, and on demand product counts and attributes."""
        orders = self.orders_wide() if orders is None else orders
        place = lambda p: self.places.select(*[F.col(c).alias(f"{p}_{c}") for c in ("zip", "lat", "lng")])
        home = self.raw["customers"].join(place("b"), F.col("customer_zip_code_prefix") == F.col("b_zip"), "left")
        home = self.raw["orders"].select("order_id", "customer_id").join(home, "customer_id", "left").select("order_id", "b_lat", "b_lng")
        seller = self.raw["sellers"].join(place("s"), F.col("seller_zip_code_prefix") == F.col("s_zip"), "left").select("seller_id", "s_lat", "s_lng")
        km = great_circle_km(F.col("b_lat"), F.col("b_lng"), F.col("s_lat"), F.col("s_lng"))
        legs = self.order_sellers().join(seller, "seller_id", "left").join(home, "order_id", "left").groupBy("order_id").agg(
            F.avg(km).alias("avg_distance_km"), F.count(F.lit(1)).alias("seller_cnt"))
        pay = self.raw["order_payments"].groupBy("order_id").agg(
            F.countDistinct("payment_type").alias("pay_type_cnt"), F.max((F.col("payment_type") == "credit_card").cast("int")).alias("has_credit_card"),
            F.max("payment_installments").alias("max_installments"))
        out = orders.join(legs, "order_id", "left").join(pay, "order_id", "left").withColumn("seller_cnt", F.coalesce("seller_cnt", F.lit(0)))
        if not goods:
            return out
        parts = self.order_items().groupBy("order_id").agg(
            F.countDistinct("product_id").alias("product_cnt"), F.max("photos_qty").alias("photos_qty"), F.max("description_length").alias("description_length"),
            F.sum("weight_g").alias("weight_g"), F.sum("volume_cm3").alias("volume_cm3"))
        return out.join(parts, "order_id", "left").withColumn("product_cnt", F.coalesce("product_cnt", F.lit(0)))
