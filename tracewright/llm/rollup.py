"""Token counts as rollups that signed deltas maintain.

Documents are counted once, when they change. A batch of changes becomes signed rows (an insert adds a
document and its tokens, a delete takes them away, a revision does both), which add up to one row for each
(source, lang, tokenizer). A commit first writes these rows under the name of the attempt, then one row that
says which attempt the batch is. Only attempts so named count, one for each batch id: a batch that is sent
again, by a retry or by two writers at once, changes nothing, and what an attempt that died has left behind
is never read. Totals are kept: ``compact`` writes the sums of all batches committed so far, and later reads
add only newer batches to the snapshot that covers most.

Cases. Null and empty texts count 0 tokens and one document. Null source or lang are groups of their own.
Groups whose documents are all deleted vanish from the totals. Repeated rows in one batch each count. A
rollup without batches is empty.
"""

from __future__ import annotations

import base64
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import n_words, shipped, small_batches

# The public pattern by which byte-level BPE vocabularies of this kind split text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEY = ["source", "lang", "tokenizer"]
DELTAS = "attempt string, source string, lang string, tokenizer string, d_docs long, d_tokens long"


def encoding(file: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_counts(docs: DataFrame, ranks: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens under the byte-level BPE vocabulary in the driver's file ``ranks``.

    The vocabulary, a megabyte or two, is sent to the executors."""
    with open(ranks, "rb") as file:
        coder = shipped(docs.sparkSession, file.read(), encoding)

    def count(batches):
        encode = coder().encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), "source", "lang", "text")
    return rows.mapInArrow(count, "doc_id long, source string, lang string, n_tokens long").withColumn("tokenizer", F.lit(version))


def word_counts(docs: DataFrame, version: str = "words") -> DataFrame:
    """The same by white-space words."""
    return docs.select(F.col("doc_id").cast("long"), "source", "lang", n_words(F.col("text")).alias("n_tokens"), F.lit(version).alias("tokenizer"))


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows between two snapshots of counts by doc_id; unchanged documents send nothing."""
    columns = ["doc_id", *KEY, "n_tokens"]
    both = before.select(*columns, F.lit(-1).alias("sign")).unionByName(after.select(*columns, F.lit(1).alias("sign")))
    net = both.groupBy(*columns).agg(F.sum("sign").alias("d_docs")).where("d_docs <> 0")
    return net.select(*KEY, "d_docs", (F.col("d_docs") * F.col("n_tokens")).alias("d_tokens"))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; empty if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(batch, attempt) of every committed batch, one attempt each."""
    return stored(spark, f"{root}/commits/*", "batch string, attempt string").groupBy("batch").agg(F.min("attempt").alias("attempt"))


def commit(root: str, batch_id: str, deltas: DataFrame) -> bool:
    """Add a batch of signed rows to the rollup at ``root``, once; false if it was there already."""
    spark, attempt = deltas.sparkSession, uuid.uuid4().hex
    if committed(spark, root).where(F.col("batch") == batch_id).head(1):
        return False
    summed = deltas.groupBy(*KEY).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
    summed.select(F.lit(attempt).alias("attempt"), "*").write.parquet(f"{root}/deltas/{attempt}")
    spark.range(1).select(F.lit(batch_id).alias("batch"), F.lit(attempt).alias("attempt")).write.parquet(f"{root}/commits/{attempt}")
    return True


def latest(spark: SparkSession, root: str) -> str | None:
    """The name of the snapshot that covers most batches."""
    best = stored(spark, f"{root}/marks/*", "snapshot string, n long").agg(F.max(F.struct("n", "snapshot")).alias("best")).first()["best"]
    return best["snapshot"] if best else None


def since(spark: SparkSession, root: str, snapshot: str | None, batches: DataFrame) -> DataFrame:
    """The rows whose sums are the totals of ``batches``: those of the snapshot, if any, and of batches that it doesn't cover."""
    base = None
    if snapshot:
        batches = batches.join(spark.read.parquet(f"{root}/snapshots/{snapshot}/covered"), "batch", "left_anti")
        base = spark.read.parquet(f"{root}/snapshots/{snapshot}/totals").select(*KEY, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
    rows = stored(spark, f"{root}/deltas/*", DELTAS).join(batches, "attempt", "left_semi").select(*KEY, "d_docs", "d_tokens")
    return rows if base is None else base.unionByName(rows)


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def totals(spark: SparkSession, root: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
    snapshot = latest(spark, root)  # before the batches, which so include all that it covers
    return summed(since(spark, root, snapshot, committed(spark, root)))


def compact(spark: SparkSession, root: str) -> None:
    """Write the totals of all batches committed so far as a snapshot. It counts once it is marked, at the end."""
    name, old = uuid.uuid4().hex, latest(spark, root)
    # The batches are fixed now, so one that is committed meanwhile is in both tables or in none.
    committed(spark, root).write.parquet(f"{root}/snapshots/{name}/covered")
    covered = spark.read.parquet(f"{root}/snapshots/{name}/covered")
    summed(since(spark, root, old, covered)).write.parquet(f"{root}/snapshots/{name}/totals")
    covered.agg(F.lit(name).alias("snapshot"), F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/marks/{name}")
