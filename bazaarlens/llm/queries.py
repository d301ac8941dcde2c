"""Registered queries of the text operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .centroids import cluster_vectors
from .common import read
from .exact import exact_dedup
from .html import extract_pages
from .licenses import scan_licenses
from .lines import dedup_lines
from .near import near_duplicates
from .packing import pack_documents
from .passages import removed_passages
from .pieces import token_digests
from .quality import quality_report
from .sharding import kd_shards
from .topk import top_products
from .variants import spelling_variants

__all__ = ["QUERIES"]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir), words=4, percent=80)


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_passages(read(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(read(spark, sf_dir))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir), read(spark, sf_dir, "labels"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read(spark, sf_dir, "embeddings"), k=10, every=100)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_passage_dedup, op3_line_dedup, op4_kd_shards, op5_html_text, op6_best_fit_packing,
    op7_exact_dedup, op8_sentencepiece, op9_license_scan, op10_quality_rules,
    op11_centroid_clusters, op12_exact_top_k, op13_spelling_variants)}
