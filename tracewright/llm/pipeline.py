"""A training corpus from ``documents``: quality, exact copies, near copies, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's ``docs``. All but the last return the columns of documents. A stage that removes by doc_id removes
every row that has it; rows with a null doc_id can't be named and pass, but for exact copies among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, exact, mixing, neardup, quality
from tracewright.llm.common import if_small, removed, scratch, table, work_dir, written


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't among the rows found."""
    return docs.join(if_small(written(found.select("doc_id").distinct(), "ids")), "doc_id", "left_anti")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return without(docs, quality.judge(docs, table(spark, sf_dir, "labels")).where("not kept"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without(docs, neardup.near_dedup(docs, percent=80).where("not kept"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of the mixture."""
    return mixing.mix(docs)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", apart), ("decontaminate", clean), ("mix", mixed)]

#: Kneser-Ney training, CGK buckets and hashed permutations have no SQL form: tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What its operators write, and each stage's table once the next one is written, is deleted."""
    docs, root, before = table(spark, sf_dir, "documents"), work_dir(spark), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}.parquet"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
