"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import WORD, read, release, stage
from bazaarlens.llm.lines import dedup_lines
from bazaarlens.llm.near import keep_one
from bazaarlens.llm.packing import pack_documents
from bazaarlens.llm.passages import dedup_passages
from bazaarlens.llm.quality import keep_good

__all__ = ["STAGES", "ORACLE_SQL", "run"]


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of texts that may have been cut."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut; documents made up of nothing else go."""
    names = [f"__{i}" for i in range(len(docs.columns))]   # columns of the documents named like the operator's own stay as they are
    text = names[docs.columns.index("text")]
    cut = dedup_lines(docs.toDF(*names), id_col=names[docs.columns.index("doc_id")], text_col=text)
    return _sized(cut.where((F.col("n_removed") == 0) | F.col(text).rlike(WORD)).select(names).toDF(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, words=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages are cut; documents made up of nothing else go."""
    return _sized(dedup_passages(docs).select(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 4096, placed in sequences."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", packing)]

#: A fitted model, tokens and a packing plan are not SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all that the stages keep. A stage's table goes as soon as the next one is stored; the last is
    read by the result, and remove_stored() or the end of Python takes it."""
    docs, before = read(spark, sf_dir), []
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs)
            release(*before)
            before = [docs]
    return docs
