"""Benchmark decontamination by edit distance: CGK embedding, bit sampling, exact verification.

The Chakraborty-Goldenberg-Koucky (CGK) random walk copies a token sequence into a longer one, repeating a
token or moving on as a random function of (step, token) says; sequences at small edit distance come out
at small Hamming distance. Bit sampling over the embedded sequence (keys of ``bits`` sampled steps, drawn
``keys`` times for each of ``walks`` walks) is then a locality-sensitive hash for edit distance. Windows of a
document are as long as the items, in words; whichever meets an item in a bucket is verified by exact edit
distance (Sellers' alignment in the region around the window).

Only windows that can match are embedded: by the q-gram lemma a text within ``d`` word edits of an
m-word item holds at least m - 2 - 3 d of its three-word runs. This filter loses nothing.

The items are the query set: they are read in blocks of at most ``block`` items and ``block_words`` words,
each block is broadcast (its size is bounded by these two), and all documents are scanned against it.

Words are runs between white space, A-Z lower-cased, stripped of ASCII punctuation at both ends. An item
of m words matches within floor(0.2 * m) word edits, exactly if m < ``EXACT``: so few words with one of them
changed occur in clean text by chance. Exact items are found by the hash of their whole sequence of words.

Cases. Null and empty texts, and items without words, match nothing. Items longer than ``block_words`` words
make a block alone. Ties: of equally distant places the first is reported. Repeated items and documents are
each reported, and a null item_id or doc_id as null.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Runs, mix, n_words, shipped, small_batches, texts, word_hashes
from tracewright.llm.ngram import KeyIndex

STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RATE = 0.2
EXACT = 10
GRAM = 3


def tokens_of(text: bytes) -> np.ndarray:
    return word_hashes([w for w in (x.strip(STRIP) for x in text.lower().split()) if w])


def edits(m: int) -> int:
    """Word edits within which an item of m words matches."""
    return int(RATE * m) if m >= EXACT else 0


def step_bits(walk: int, steps: int) -> np.ndarray:
    return mix(np.arange(1, steps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(walk * 7919 + 1))


def embed(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, walk: int, sampled: np.ndarray) -> np.ndarray:
    """The CGK walk over tokens[start : start + length] of each start, at the sampled steps."""
    at, out = np.zeros(len(starts), np.int64), np.zeros((len(sampled), len(starts)), np.uint64)
    step, slot = step_bits(walk, int(sampled[-1]) + 1), {int(s): i for i, s in enumerate(sampled)}
    for j in range(int(sampled[-1]) + 1):
        token = np.where(at < lengths, tokens[starts + np.minimum(at, lengths - 1)], np.uint64(0))
        if j in slot:
            out[slot[j]] = token
        at += (mix(token ^ step[j]) >> np.uint64(63)).astype(np.int64)
    return out


class Items:
    """A block of items with what is needed to find them."""

    def __init__(self, ids: list, token_lists: list[np.ndarray], walks: int, keys: int, bits: int):
        self.ids, self.tokens = ids, token_lists
        self.walks, self.n_keys, self.bits = walks, keys, bits
        self.exact = {}
        for m in sorted({len(t) for t in token_lists if 0 < len(t) < EXACT}):
            of: dict[int, list[int]] = {}
            for i, t in enumerate(token_lists):
                if len(t) == m:
                    of.setdefault(int(Runs(t).windows(m)[0]), []).append(i)
            self.exact[m] = KeyIndex(np.array(list(of), np.uint64)), list(of.values())
        long = [t for t in token_lists if len(t) >= EXACT]
        self.runs = [np.unique(Runs(t).windows(GRAM)) if len(t) >= EXACT else None for t in token_lists]
        self.lengths = sorted({len(t) for t in long})
        # For each three-word run the lengths of the items that hold it, one list after another.
        pairs = [(g, self.lengths.index(len(t))) for t, run in zip(token_lists, self.runs, strict=True) if run is not None for g in run.tolist()]
        pairs = sorted(set(pairs))
        grams, self.first = np.unique(np.array([g for g, _ in pairs], np.uint64), return_index=True)
        self.grams, self.first, self.of_length = KeyIndex(grams), np.r_[self.first, len(pairs)], np.array([x for _, x in pairs], np.int64)
        self.buckets = {}
        for m in self.lengths:
            mine = np.array([i for i, t in enumerate(token_lists) if len(t) == m])
            flat = np.concatenate([token_lists[i] for i in mine])
            for walk, key in self.bucket_keys(flat, np.arange(len(mine)) * m, np.full(len(mine), m), m):
                order = np.argsort(key, kind="stable")
                self.buckets[m, walk] = (key[order], mine[np.tile(np.arange(len(mine)), self.n_keys)[order]])

    def bucket_keys(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, m: int):
        """For each walk the keys of every start, all samples one after another."""
        for walk in range(self.walks):
            draw = np.random.default_rng(walk * 100_003 + m).integers(0, max(1, int(1.5 * m)), (self.n_keys, self.bits))
            sampled, slot = np.unique(draw, return_inverse=True)
            seen = embed(tokens, starts, lengths, walk, sampled)[slot.reshape(draw.shape)]
            key = np.broadcast_to(np.arange(1, self.n_keys + 1, dtype=np.uint64)[:, None], seen.shape[::2])
            for s in range(self.bits):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[:, s])
            yield walk, key.ravel()

    def places(self, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sorted (item number, start) of windows that share a bucket with an item of their length.

        ``tokens`` are of many texts, one after another; ``ends``: of each token, where its text ends."""
        grams = Runs(tokens).windows(GRAM)
        row = self.grams.find(grams)
        at = np.flatnonzero((row >= 0) & (np.arange(len(grams)) + GRAM <= ends[: len(grams)]))
        n = (self.first[1:] - self.first[:-1])[row[at]]
        of_length = self.of_length[np.repeat(self.first[row[at]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(at) else at
        at = np.repeat(at, n)
        first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        begin = np.repeat(first, np.diff(np.r_[first, len(tokens)]))
        found = [np.zeros((0, 2), np.int64)]
        for number in np.unique(of_length):
            m, hits = self.lengths[number], at[of_length == number]
            d = edits(m)
            need, width = max(1, m - 2 - 3 * d), m + d - GRAM
            if len(hits) < need:
                continue
            lo, hi = hits[: len(hits) - need + 1], hits[need - 1 :]
            near = (ends[lo] == ends[hi]) & (hi - lo <= width)
            lo, hi = lo[near], hi[near]
            left = np.maximum(hi - width, begin[lo])
            n = lo - left + 1
            starts = np.unique(np.repeat(left - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())) if len(lo) else lo
            starts = starts[(starts <= ends[starts] - m + d) | (starts == begin[starts])]
            for a in range(0, len(starts), 1 << 14):
                part = starts[a : a + (1 << 14)]
                for walk, key in self.bucket_keys(tokens, part, np.minimum(m, ends[part] - part), m):
                    known, item = self.buckets[m, walk]
                    lo, hi = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                    i = np.flatnonzero(hi > lo)
                    n = (hi - lo)[i]
                    j = np.repeat(lo[i] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    found.append(np.unique(np.stack([item[j], part[np.repeat(i, n) % len(part)]], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def equal(self, tokens: np.ndarray, ends: np.ndarray, of: np.ndarray, begins: np.ndarray):
        """The first place of each exact item in each text, as ``matches`` gives it."""
        for m, (index, items) in self.exact.items():
            row = index.find(Runs(tokens).windows(m))
            at = np.flatnonzero((row >= 0) & (np.arange(len(row)) + m <= ends[: len(row)]))
            _, first = np.unique(of[at] * len(items) + row[at], return_index=True)
            for p in at[first].tolist():
                text = int(of[p])
                for number in items[row[p]]:
                    if (self.tokens[number] == tokens[p : p + m]).all():
                        yield text, number, p - int(begins[text]), p - int(begins[text]) + m, 0

    def matches(self, texts: list[np.ndarray]):
        """(text number, item number, first word, last word + 1, distance) of the best place of each item in each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return
        tokens, ends = np.concatenate(texts), np.repeat(np.cumsum(sizes), sizes)
        begins = np.cumsum(sizes) - sizes
        yield from self.equal(tokens, ends, np.repeat(np.arange(len(texts)), sizes), begins)
        if not self.lengths:
            return
        places = self.places(tokens, ends)
        of = np.repeat(np.arange(len(texts)), sizes)[places[:, 1]]
        order = np.lexsort((places[:, 1], places[:, 0], of))
        places, of = places[order], of[order]
        if not len(of):
            return
        cuts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (places[1:, 0] != places[:-1, 0]), True])
        for a, b in pairwise(cuts.tolist()):
            number, text = int(places[a, 0]), int(of[a])
            item, begin, best = self.tokens[number], int(begins[text]), None
            m, d = len(item), edits(len(item))
            for lo, hi in regions((places[a:b, 1] - begin).tolist(), m + 2 * d, d, int(sizes[text])):
                part = texts[text][lo:hi]
                if np.isin(Runs(part).windows(GRAM), self.runs[number]).sum() < m - 2 - 3 * d:
                    continue  # the q-gram lemma again, for this item alone
                got = nearest(item, part)
                if got[0] <= d and (best is None or got[0] < best[2]):
                    best = (lo + got[1], lo + got[2], got[0])
            if best is not None:
                yield text, number, *best


def regions(starts: list[int], width: int, before: int, n: int):
    """Parts of the text around the starts, put together where they overlap."""
    lo = hi = None
    for s in starts:
        a, b = max(0, s - before), min(n, s + width)
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to any part of the text, and that part (Sellers, row by row)."""
    n = len(text)
    row, start, along = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for i, token in enumerate(item, 1):
        change = row[:-1] + (text != token)
        drop = row[1:] + 1
        new = np.r_[i, np.minimum(change, drop)]
        origin = np.r_[0, np.where(change <= drop, start[:-1], start[1:])]
        gap = new - along  # insertions: the running least of new[k] + (j - k)
        least = np.minimum.accumulate(gap)
        source = np.maximum.accumulate(np.where(gap == least, along, 0))
        row, start = least + along, origin[source]
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


def blocks(items: DataFrame, most: int, most_words: int):
    """Lists of (item_id, text), each within the bounds, one at a time."""
    items = items.select("item_id", "text").where(F.col("text").isNotNull()).withColumn("n", n_words(F.col("text"))).where("n > 0")
    rows, words = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(1, -(-2 * rows // most) if rows > most else 1, -(-2 * words // most_words) if words > most_words else 1)
    for part in range(parts):
        block, size = [], 0
        for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toLocalIterator():
            if block and (len(block) >= most or size + r["n"] > most_words):
                yield block
                block, size = [], 0
            block.append((r["item_id"], r["text"]))
            size += r["n"]
        if block:
            yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, walks: int = 4, keys: int = 32, bits: int = 3, block: int = 5_000, block_words: int = 500_000) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, first_word, end_word, distance."""
    spark = docs.sparkSession
    out = None
    schema = "doc_id long, item_id long, first_word long, end_word long, distance long"
    for rows in blocks(benchmark, block, block_words):
        pairs = [(i, t) for i, t in ((i, tokens_of(text.encode())) for i, text in rows) if len(t)]
        held = shipped(spark, cloudpickle.dumps(Items([i for i, _ in pairs], [t for _, t in pairs], walks, keys, bits)), cloudpickle.loads)

        def scan(batches, held=held):
            items = held()
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[i], items.ids[number], lo, hi, d) for i, number, lo, hi, d in items.matches([tokens_of(t) for t in texts(batch.column("text"))])]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 5, names=["doc_id", "item_id", "first_word", "end_word", "distance"])

        part = small_batches(docs).select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull()).mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
