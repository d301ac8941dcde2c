"""Tables, parameterised queries and raw CSV."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .multiline import read_multi_line

__all__ = ["read_table", "query", "table_exists", "read_csv", "read_raw", "RAW_SCHEMAS", "MULTI_LINE"]

# Raw layer, one file each. Timestamps stay text here and are parsed with a check later.
RAW_SCHEMAS = {
    "orders": (
        "order_id STRING, customer_id STRING, order_status STRING, order_purchase_timestamp STRING, "
        "order_approved_at STRING, order_delivered_carrier_date STRING, order_delivered_customer_date STRING, "
        "order_estimated_delivery_date STRING"),
    "order_items": (
        "order_id STRING, order_item_id INT, product_id STRING, seller_id STRING, shipping_limit_date STRING, "
        "price DOUBLE, freight_value DOUBLE"),
    "order_payments": (
        "order_id STRING, payment_sequential INT, payment_type STRING, payment_installments INT, "
        "payment_value DOUBLE"),
    "order_reviews": (
        "review_id STRING, order_id STRING, review_score INT, review_comment_title STRING, "
        "review_comment_message STRING, review_creation_date STRING, review_answer_timestamp STRING"),
    "customers": (
        "customer_id STRING, customer_unique_id STRING, customer_zip_code_prefix STRING, customer_city STRING, "
        "customer_state STRING"),
    "sellers": (
        "seller_id STRING, seller_zip_code_prefix STRING, seller_city STRING, seller_state STRING"),
    "products": (
        "product_id STRING, product_category_name STRING, product_name_lenght INT, "
        "product_description_lenght INT, product_photos_qty INT, product_weight_g INT, product_length_cm INT, "
        "product_height_cm INT, product_width_cm INT"),
    "geolocation": (
        "geolocation_zip_code_prefix STRING, geolocation_lat DOUBLE, geolocation_lng DOUBLE, "
        "geolocation_city STRING, geolocation_state STRING"),
    "category_translation": (
        "product_category_name STRING, product_category_name_english STRING"),
}
# The one file with line breaks inside its fields.
MULTI_LINE = {"order_reviews"}


def read_table(spark: SparkSession, name: str, base: str | None = None) -> DataFrame:
    """A parquet table under ``base``, or a catalog table when no base is given."""
    if base is None:
        return spark.table(name)
    single = os.path.join(base, f"{name}.parquet")
    return spark.read.parquet(single if _path_exists(spark, single) else os.path.join(base, name))


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """SQL with ``:name`` parameters, bound and never pasted into the text."""
    return spark.sql(sql, args=args)


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table_exists(spark: SparkSession, name: str, base: str | None = None) -> bool:
    if base is None:
        return spark.catalog.tableExists(name)
    return (_path_exists(spark, os.path.join(base, name))
            or _path_exists(spark, os.path.join(base, f"{name}.parquet")))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, strict_header: bool = True, multi_line: bool = False) -> DataFrame:
    """Quoted CSV. ``multi_line`` for records that span lines and for the number of each record in its file (``_record``, 1 is
    the first after the header); files are split over tasks either way.

    With ``strict_header`` a header that does not match the schema is an error instead
    of a silent column shift. Rows that do not fit the schema keep their text in ``_bad``
    and their file in ``_file``; a trailing carriage return is trimmed from text columns.
    """
    if multi_line:
        raw = read_multi_line(spark, path, schema, strict_header)
        return raw.withColumns({f.name: F.rtrim(F.col(f.name), F.lit("\r")) for f in schema.fields if isinstance(f.dataType, T.StringType)})
    with_bad = T.StructType(list(schema.fields) + [T.StructField("_bad", T.StringType())])
    raw = (spark.read.schema(with_bad)
           .option("header", True).option("quote", '"').option("escape", '"')
           .option("enforceSchema", not strict_header)
           .option("encoding", "UTF-8").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_bad")
           .csv(path))
    cols = [F.rtrim(F.col(f.name), F.lit("\r")).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields]
    return raw.select(*cols, "_bad", F.col("_metadata.file_path").alias("_file"))


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The nine raw files ``<name>.csv`` of a folder, with their bad rows marked."""
    return {n: read_csv(spark, os.path.join(folder, f"{n}.csv"), T.StructType.fromDDL(s), multi_line=n in MULTI_LINE) for n, s in RAW_SCHEMAS.items()}
