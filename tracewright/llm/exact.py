"""Exact deduplication with a split of heavy hitters.

Texts are equal when identical after lower-casing A-Z. A Misra-Gries summary (Spark's ``approx_top_k``,
a mergeable frequent-items sketch of fixed size) names digests that may be frequent; their exact counts and
winners are computed over all rows and verified, and these few winners, at most ``top``, are broadcast, so
copies of a heavy text are settled where they are read. All other digests are shuffled as usual; none of
them can have more than rows / ``tracked`` copies beyond ``least``.

Cases. Null counts as the empty text, and empty texts are copies of each other. The largest doc_id stays;
of rows with the same doc_id and text just one stays. A null doc_id is smaller than any other. Other
columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import if_small, lower_ascii, written


def digest() -> Column:
    return F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256)


def exact_dedup(docs: DataFrame, tracked: int = 10_000, top: int = 1_000, least: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(docs.select("doc_id", digest().alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
    best = F.struct(F.col("doc_id"), F.col("row"))

    summary = digests.agg(F.expr(f"approx_top_k(text_sha256, {top}, {tracked})").alias("found"))
    frequent = summary.select(F.explode("found").alias("x")).where(F.col("x.count") >= least).select(F.col("x.item").alias("text_sha256"))
    counted = digests.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(best).alias("best"))
    winners = written(counted.where(F.col("group_size") >= least), "winners")

    heavy = digests.join(F.broadcast(winners), "text_sha256")
    # Groups are summed up where their rows are read, then joined again: a join can split what a window can't.
    light = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    light = light.join(light.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(best).alias("best")), "text_sha256")
    out = [F.col("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.col("text_sha256")]
    return heavy.select(*out).unionByName(light.select(*out))


def drop_copies(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    judged = exact_dedup(docs, **options).groupBy("doc_id", "text_sha256").agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("n"))
    judged = written(judged.where("stay = 0 or n > 1").withColumnsRenamed({"doc_id": "__doc_id", "text_sha256": "__copy"}), "judged")
    here = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__digest") == F.col("__copy"))
    rows = docs.withColumn("__digest", digest())
    once = rows.join(if_small(judged), here, "left_anti")
    repeated = judged.where("stay > 0")
    if repeated.head(1):  # equal rows of one doc_id: one of them stays
        once = once.unionByName(rows.join(if_small(repeated), here, "left_semi").dropDuplicates(["doc_id", "__digest"]))
    return once.drop("__digest")
