"""Substring deduplication by relative Lempel-Ziv factors, found from anchors.

The factors of a text are its longest runs of at least ``size`` words that the reference, all documents of a
smaller doc_id, has too. Parsing each text against each indexed block of the reference would read all texts
once for every block, and the number of blocks grows with the texts: the square of the input. So texts are
cut where their own words say, and a text meets only those reference blocks with which it shares an anchor:
of each window of ``size`` words, the least hash of its ``seed``-word runs. A maximal run of windows with the
same anchor is a block, so two documents that share a window share its anchor, wherever it stands. The index
maps (anchor, whole words of the block) to the least doc_id that has it:

1. A text equal to one with a smaller doc_id is one factor, the whole text.
2. A block whose words a smaller doc_id has in full belongs to a factor.
3. At factor boundaries, where an anchor is shared but the words around it differ, the windows themselves
   are looked up; only one document for each different surrounding of an anchor sends them.

From left to right these blocks and windows join to the factors, the spans that are removed. Windows are
compared by 128-bit hashes, blocks by 64-bit hashes under equal 64-bit anchors.

Cases. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null text has none. Texts under ``size`` words lose
nothing. Only a strictly smaller doc_id counts as a source: rows that share a doc_id don't remove each
other, and a null doc_id neither gives nor loses words. Very long texts are parsed whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Runs, if_small, small_batches, texts, word_hashes, written


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def candidates(tokens: np.ndarray, size: int, seed: int):
    """First and last window of each run with one anchor, the anchor, and the hash of all words of the run."""
    if len(tokens) < size:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    runs = Runs(tokens)
    anchor = sliding_min(runs.windows(seed), size - seed + 1)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:] - 1, len(anchor) - 1]
    return first, last, anchor[first].view(np.int64), runs.hash(first, last + size).view(np.int64)


def covered(n: int, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Which of n words the windows first..last cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + size, -1)
    return np.cumsum(edge)[:n] > 0


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def parse(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, n_words, digest of the words, and the anchors and word hashes of the factor candidates."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in texts(batch.column("text")):
                words = text.split()
                _, _, anchor, whole = candidates(word_hashes(words), size, seed)
                for to, x in zip(out, (len(words), sha(words), anchor, whole), strict=True):
                    to.append(x)
            longs = pa.list_(pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], longs), pa.array(out[3], longs)], names=["doc_id", "n_words", "digest", "anchor", "whole"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, digest string, anchor array<long>, whole array<long>")


def windows(found: DataFrame, size: int, seed: int) -> DataFrame:
    """(w, x, doc_id): the 128-bit hash of each window of the open candidates."""

    def run(batches):
        for batch in batches:
            for doc_id, text, unsure in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), batch.column("unsure").to_pylist(), strict=True):
                if not unsure:
                    continue
                tokens = word_hashes(text.split())
                first, last, _, whole = candidates(tokens, size, seed)
                mine = np.isin(whole, np.array(unsure, np.int64))
                starts = np.flatnonzero(covered(len(tokens), first[mine], last[mine], 1))
                one, two = (Runs(tokens, salt).hash(starts, starts + size).view(np.int64) for salt in (1, 2))
                one, where = np.unique(one, return_index=True)
                yield pa.record_batch([pa.array(one), pa.array(two[where]), pa.array(np.full(len(one), doc_id))], names=["w", "x", "doc_id"])

    return small_batches(found).select("doc_id", "text", "unsure").mapInArrow(run, "w long, x long, doc_id long")


def cut(found: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, n_removed, kept_sha256, kept_text, factors of documents with sure blocks or repeated windows."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            rows = zip(texts(batch.column("text")), batch.column("sure").to_pylist(), batch.column("repeated").to_pylist(), strict=True)
            for text, sure, repeated in rows:
                words = text.split()
                tokens = word_hashes(words)
                first, last, _, whole = candidates(tokens, size, seed)
                mine = np.isin(whole, np.array(sure or [], np.int64))
                gone = covered(len(words), first[mine], last[mine], size)
                if repeated:
                    starts = np.flatnonzero(np.isin(Runs(tokens, 1).windows(size).view(np.int64), np.array(repeated, np.int64)))
                    gone |= covered(len(words), starts, starts, size)
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)
                left = [words[i] for i in np.flatnonzero(~gone)]
                for to, x in zip(out, (int(gone.sum()), sha(left), b" ".join(left), edges.tolist()), strict=True):
                    to.append(x)
            yield pa.record_batch([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()).cast(pa.string()), pa.array(out[3], pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_removed", "kept_sha256", "kept_text", "factors"])

    return small_batches(found).mapInArrow(run, "doc_id long, n_removed long, kept_sha256 string, kept_text string, factors array<array<long>>")


def substring_dedup(docs: DataFrame, size: int = 50, seed: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text (null if nothing was removed), factors (null likewise: first word and last word + 1 of each span removed)."""
    parsed = written(parse(docs, size, seed), "parsed")
    long = parsed.where(F.col("n_words") >= size).where("doc_id is not null")
    first = long.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = if_small(written(first.select("digest", "first"), "first"))
    copies = long.select("doc_id", "digest").join(first, "digest").where("doc_id > first").select("doc_id").distinct()
    blocks = long.join(first, "digest", "left").where("first is null or doc_id = first").select("doc_id", F.explode(F.arrays_zip("anchor", "whole")).alias("c"))
    blocks = written(blocks.select("doc_id", "c.anchor", "c.whole").distinct(), "blocks")

    index = blocks.groupBy("anchor", "whole").agg(F.min("doc_id").alias("source"))
    mixed = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("mixed"))
    index = index.join(mixed, "anchor", "left")
    factors = blocks.join(index, ["anchor", "whole"]).where("doc_id > source or mixed")
    known = F.col("doc_id") > F.col("source")
    by_doc = factors.groupBy("doc_id").agg(F.collect_set(F.when(known, F.col("whole"))).alias("sure"), F.collect_set(F.when(~known, F.col("whole"))).alias("unsure"))
    found = written(docs.select(F.col("doc_id").cast("long"), "text").join(by_doc, "doc_id"), "found")

    window = written(windows(found, size, seed), "windows")
    sources = window.groupBy("w", "x").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("w", "x", "source")
    repeated = window.join(sources, ["w", "x"]).where("doc_id > source").groupBy("doc_id").agg(F.collect_set("w").alias("repeated"))
    partly = found.join(repeated, "doc_id", "left").where(F.col("repeated").isNotNull() | (F.size("sure") > 0)).select("doc_id", "text", "sure", "repeated")
    partly = cut(partly, size, seed).select("doc_id", F.struct("n_removed", "kept_sha256", "kept_text", "factors").alias("cut")).unionByName(
        copies.select("doc_id", F.struct(F.lit(-1).cast("long").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").alias("kept_text"), F.lit(None).cast("array<array<long>>").alias("factors")).alias("cut")))
    out = parsed.select("doc_id", "n_words", "digest").join(partly, "doc_id", "left")
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("cut.n_removed") < 0, F.col("n_words")).otherwise(F.coalesce("cut.n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("cut.kept_sha256", "digest").alias("kept_sha256"),
        F.col("cut.kept_text").alias("kept_text"),
        F.when(F.col("cut.n_removed") < 0, F.array(F.array(F.lit(0).cast("long"), "n_words"))).otherwise(F.col("cut.factors")).alias("factors"),
    )
