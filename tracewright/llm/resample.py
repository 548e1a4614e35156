"""Importance resampling of documents towards the text of a target table.

A document is a bag of features: all runs of 1 to ``ngrams`` consecutive words, hashed into a fixed number of
buckets. A bucket's gain is the logarithm of its smoothed share in the target over its share in all documents;
a document's weight is the mean gain of its features. Gumbel noise from the hash of the doc_id is added, so the
highest scores are a draw without replacement in proportion to the weights' exponentials.

Long texts are split into chunks at word boundaries. A chunk owns the features that start in its own words and
carries the next ``ngrams - 1`` words of its text, so a feature across a boundary is counted once. Chunks of
texts over ``chunk`` bytes are dealt over the cluster; counts and sums of gains are then added up by document.
Shorter texts are a chunk of their own and are never shuffled. What the driver sees is ``buckets`` counts.

The draw is ranked by a range-partitioned sort: a row's rank is its place in its partition after the rows of
the partitions before it, so no task holds more than its range.

Cases. Null, empty and wordless texts have no features, weight 0, and are never drawn. Ties of score go to the
smaller doc_id. Rows with the same doc_id are each scored and may each be drawn. A null doc_id is hashed as the
empty string and comes after all others among equal scores. An empty target gives every bucket its smoothing
only; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import shipped, small_batches, texts, written

# A-Z to a-z; every other ASCII byte that is no digit or letter to a space. Other bytes belong to words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
CHUNK = 1 << 16


def chunks(text: bytes, most: int, carry: int) -> Iterator[tuple[bytes, bytes]]:
    """(own, carried) bytes of each chunk of a text whose words are parted by spaces.

    Own parts are about ``most`` bytes, end where a word ends, and add up to the text."""
    following = re.compile(rb"(?: *[^ ]+){0,%d}" % carry)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + most)
        end = len(text) if end < 0 else end
        yield text[at:end], following.match(text, end).group()
        at = end


def buckets(own: bytes, carried: bytes, ngrams: int, n_buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a chunk, and the bucket of every feature that it owns."""
    words = own.split()
    n = len(words)
    words += carried.split()
    runs = np.fromiter(map(crc32, words[:n]), np.int64, n).tolist()
    found = [*runs]
    for size in range(1, ngrams):
        runs = list(map(crc32, map(b" ".__add__, words[size : n + size]), runs))  # a run's hash goes on from the shorter one's
        found += runs
    return n, np.array(found, np.int64) % n_buckets


def parts(docs: DataFrame, ngrams: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """row, doc_id, own, carried: the short texts as they are (row is null), and the long ones in chunks."""
    rows = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.octet_length("text") > chunk

    def split(batches):
        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                for i, (own, carried) in enumerate(chunks(text.translate(WORDS), chunk, ngrams - 1)):
                    yield pa.RecordBatch.from_pydict({"row": [row], "part": [i], "doc_id": [doc_id], "own": [own], "carried": [carried]}, schema)

    schema = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("own", pa.binary()), ("carried", pa.binary())])
    cut = rows.where(long).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(split, "row long, part int, doc_id long, own binary, carried binary")
    cut = written(cut.repartition("row", "part"), "chunks")
    short = rows.where(~long).select(F.lit(None).cast("long").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("own"), F.lit(b"").alias("carried"))
    return short, cut.drop("part")


def bucket_counts(split: tuple[DataFrame, DataFrame], ngrams: int, n_buckets: int) -> np.ndarray:
    """Features of all chunks by bucket; each task sends one row for each bucket it has seen."""

    def count(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for own, carried in zip(batch.column("own").to_pylist(), batch.column("carried").to_pylist()):
                total += np.bincount(buckets(own.translate(WORDS), carried, ngrams, n_buckets)[1], minlength=n_buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    both = split[0].unionByName(split[1])
    for r in both.select("own", "carried").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # n_buckets rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths, rounded down."""
    n, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from the hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... in the given order, without a task that sees all of them."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row for each partition
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, ngrams: int = 2, n_buckets: int = 10_000, least: int = 20, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null unless drawn), n_words.

    Drawn are ``percent`` of the documents with ``least`` words or more. ``target`` has a column ``text``."""
    split = parts(docs, ngrams, chunk)
    goal = parts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), ngrams, chunk)
    gain = shipped(docs.sparkSession, gains(bucket_counts(split, ngrams, n_buckets), bucket_counts(goal, ngrams, n_buckets)))

    def weigh(batches):
        value = gain()
        for batch in batches:
            found = []
            for own, carried in zip(batch.column("own").to_pylist(), batch.column("carried").to_pylist()):
                n, at = buckets(own.translate(WORDS), carried, ngrams, n_buckets)
                found.append((n, len(at), int(value[at].sum())))
            sums = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(sums[:, i]) for i in range(3))], ["row", "doc_id", "n_words", "n_features", "total"])

    short, cut = (rows.mapInArrow(weigh, "row long, doc_id long, n_words long, n_features long, total long") for rows in split)
    whole = short.drop("row")
    added = cut.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(x).alias(x) for x in ("n_words", "n_features", "total"))).drop("row")
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))  # rounded down
    scored = whole.unionByName(added).select("doc_id", "n_words", "n_features", mean.alias("weight"))
    scored = written(scored.withColumn("score", F.col("weight") + noise(seed)), "scored")

    able = scored.where(F.col("n_words") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    drawn = ranked(able, order)
    most = able.count() * percent // 100
    out = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def drawn(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """The rows of ``docs`` that were drawn, with all their columns."""
    return docs.join(picked.where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi")
