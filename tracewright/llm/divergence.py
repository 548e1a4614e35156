"""How the sources of a language differ from each other and from the language as a whole, by their terms.

Documents are read twice. First, each task keeps a count-min sketch of the document frequencies of its (lang,
term); the sketches are added up slice by slice, and counters stop at the frequency that is asked for, so a
counter is a byte or two. A sketch never underestimates: a term that it puts below ``least`` documents can't
have them. In the second pass such terms are dropped where they are read, and the survivors are counted
exactly by (lang, source, term). How many false survivors there are depends on the width, the result doesn't.

Smoothed shares p are compared term by term. Nothing is made dense: of the sum over all V terms of |p - q| for
two sources, terms that neither has are a constant, terms that one has depend only on their count (so a
histogram of counts stands for them), and only terms that both have are joined.

Cases. Null text, lang and source are ''. Groups without kept terms are compared too: all their shares are the
smoothed zero. A language without kept terms has pairs of value 0 and no term rows; a language with one source
has no pairs. Repeated rows are documents of their own. An empty table gives an empty result. Clashing column
names don't matter: only text, lang and source are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import Runs, chunks, if_small, mix, shipped, small_batches, texts, word_hashes, written

# A-Z to a-z; every other ASCII byte that is no letter to a space. Other bytes belong to terms.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INSIDE, BETWEEN = bytes(c != 32 for c in TERMS), bytes(c for c in range(256) if TERMS[c] == 32)
SCALE, PRIOR = 1_000_000_000, 5
SLICE = 1 << 16


def term_counts(text: bytes, most: int = 1 << 20) -> Counter:
    """Terms of a whole text with their counts, ``most`` bytes at a time."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + most
        while end < len(text) and TERMS[text[end]] != 32:  # a term isn't cut
            end += 1
        found.update(text[at:end].translate(TERMS).split())
        at = end
    return found


def cut(batch: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, and the number of each one's text."""
    text = b" ".join([b"", *batch, b""])
    inside = np.frombuffer(text.translate(INSIDE), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # first bytes of terms, and the first behind them, in turn
    offsets = np.zeros(len(edges) // 2 + 1, np.int32)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    terms = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text.translate(TERMS, BETWEEN))])
    ends = np.cumsum([len(t) + 1 for t in batch])
    return terms, np.repeat(np.arange(len(batch)), np.diff(np.searchsorted(edges[::2], ends, side="right"), prepend=0))


def occurrences(batch: list[bytes], most: int = 1 << 22) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, doc, term, n): the distinct terms of each text with their counts, as numbers of texts and terms, for about
    ``most`` bytes of text at a time. A text longer than that comes alone."""
    at = 0
    while at < len(batch):
        end, size = at + 1, len(batch[at])
        if size > most:
            seen = term_counts(batch[at])
            yield pa.array(list(seen), pa.binary()), np.full(len(seen), at), np.arange(len(seen)), np.fromiter(seen.values(), np.int64, len(seen))
            at = end
            continue
        while end < len(batch) and size + len(batch[end]) <= most:
            size += len(batch[end])
            end += 1
        words, doc = cut(batch[at:end])
        coded = words.dictionary_encode()
        many = max(1, len(coded.dictionary))
        key, n = np.unique((at + doc) * many + coded.indices.to_numpy(), return_counts=True)
        yield coded.dictionary, key // many, key % many, n
        at = end


def term_hashes(terms: pa.Array, most: int = 1 << 16) -> np.ndarray:
    """Terms are hashed together for ``most`` bytes at a time; a longer one alone, without arrays as long as itself."""
    out = np.zeros(len(terms), np.uint64)
    _, offsets, data = terms.buffers()
    if len(terms):
        ends, data = np.frombuffer(offsets, np.int32)[terms.offset : terms.offset + len(terms) + 1], np.frombuffer(data, np.uint8)
        for i, j in chunks(ends, most):
            some = data[ends[i] : ends[j]]
            if len(some) > most:
                out[i] = word_hashes([some.tobytes()])[0]
            else:
                out[i:j] = Runs(some.astype(np.uint64)).hash(ends[i:j] - ends[i], ends[i + 1 : j + 1] - ends[i])
    return out


def hashes(terms: list[bytes], lang: bytes) -> np.ndarray:
    return mix(term_hashes(pa.array(terms, pa.binary())) ^ word_hashes([lang])[0])


def places(h: np.ndarray, width: int, depth: int) -> np.ndarray:
    """The counter of each hash in each of the sketch's rows."""
    step = mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(width) + np.uint64(i * width) for i in range(depth)]).astype(np.int64)


def numbered(keys: list) -> tuple[list, np.ndarray]:
    """Distinct keys in order of appearance, and the number of each row's."""
    numbers: dict = {}
    rows = np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)
    return list(numbers), rows


def sketch(docs: DataFrame, least: int, width: int, depth: int) -> np.ndarray:
    """Document frequencies of (lang, term), at most ``least``: counters of ``depth`` rows of ``width``."""
    kind = np.dtype(np.uint8 if least <= 255 else np.uint32)

    def local(batches):
        total = np.zeros(depth * width, kind)
        for batch in batches:
            langs, lang = numbered(texts(batch.column("lang")))
            salts = word_hashes(langs)
            for terms, doc, term, _ in occurrences(texts(batch.column("text"))):
                many = max(1, len(terms))
                key, df = np.unique(lang[doc] * many + term, return_counts=True)
                for row in places(mix(term_hashes(terms)[key % many] ^ salts[key // many]), width, depth):  # terms may share a counter
                    cells, back = np.unique(row, return_inverse=True)
                    total[cells] = np.minimum(total[cells] + np.bincount(back, df).astype(np.int64), least).astype(kind)
        for i in range(0, len(total), SLICE):
            if total[i : i + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([zlib.compress(total[i : i + SLICE].tobytes(), 1)], pa.binary())], ["slice", "counters"])

    def merged(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counters in zip(batch.column("slice").to_pylist(), batch.column("counters").to_pylist()):
                more = np.frombuffer(zlib.decompress(counters), kind).astype(np.int64)
                sums[i] = np.minimum(sums[i] + more, least) if i in sums else more
        for i, counters in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(counters.astype(kind).tobytes(), 1)], pa.binary())], ["slice", "counters"])

    schema = "slice int, counters binary"
    out = np.zeros(depth * width, kind)
    # Sketches meet slice by slice, first within some tasks and then across them, so no task adds up those of all.
    local_sums = docs.mapInArrow(local, schema).withColumn("heap", F.pmod(F.spark_partition_id(), F.lit(64)))
    halfway = local_sums.repartition("slice", "heap").drop("heap").mapInArrow(merged, schema)
    for r in halfway.repartition("slice").mapInArrow(merged, schema).collect():  # depth * width counters in all
        found = np.frombuffer(zlib.decompress(r["counters"]), kind)
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(found)] = found
    return out


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, each once, with the sum of n and the number of rows."""
    key, back, rows = np.unique(key, return_inverse=True, return_counts=True)
    return key, np.bincount(back, n).astype(np.int64), rows


class Tally:
    """Counts by (lang, source, term) in a task, handed out when there are ``most`` of them or terms of 32 times as many bytes."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.groups: dict[tuple[bytes, bytes], int] = {}
        self.parts, self.size = [], 0

    def add(self, groups: list[tuple[bytes, bytes]], group: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> None:
        """Rows of a number in ``groups``, a term and its counts, each number and term once."""
        if not len(terms):
            return
        number = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        self.parts.append((number[group], terms, n, docs))
        self.size += self.weight(terms)
        if self.size > 2 * self.most:  # more than ``most`` of them are new since the last time
            self.parts = [self.total()]
            self.size = self.weight(self.parts[0][1])

    def weight(self, terms: pa.Array) -> int:
        return max(len(terms), terms.nbytes // 32)

    def total(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """The parts summed up to one; they are gone."""
        if len(self.parts) == 1:
            return self.parts.pop()
        group, terms, n, docs = zip(*self.parts)
        self.parts = []
        coded = pa.chunked_array(terms).dictionary_encode().unify_dictionaries().chunks
        key = np.concatenate(group) << 32 | np.concatenate([c.indices.to_numpy() for c in coded])
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        n, docs = (np.add.reduceat(np.concatenate(x)[order], first) for x in (n, docs))
        key = key[order[first]]
        return key >> 32, coded[0].dictionary.take(pa.array(key & 0xFFFFFFFF)), n, docs

    def rows(self, batch: int = 1 << 17) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        langs, sources = (pa.array([g[i] for g in self.groups], pa.binary()).cast(pa.string()) for i in (0, 1))
        group, terms, n, docs = self.total()
        self.clear()
        for i in range(0, len(n), batch):
            one = slice(i, i + batch)
            of = pa.array(group[one])
            yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), terms[one].cast(pa.string()), pa.array(n[one]), pa.array(docs[one])], ["lang", "source", "term", "n", "docs"])


def counted(docs: DataFrame, least: int, width: int, depth: int) -> DataFrame:
    """lang, source, term, n, docs of the terms that the sketch lets pass, dealt by lang and term."""
    shared = shipped(docs.sparkSession, sketch(docs.select("lang", "text"), least, width, depth))

    def count(batches):
        counters, tally = shared(), Tally()
        for batch in batches:
            groups, group = numbered(list(zip(texts(batch.column("lang")), texts(batch.column("source")))))
            salts = word_hashes([lang for lang, _ in groups])
            for terms, doc, term, n in occurrences(texts(batch.column("text"))):
                many = max(1, len(terms))
                key, n, df = summed(group[doc] * many + term, n)
                own, term = key // many, key % many
                keep = counters[places(mix(term_hashes(terms)[term] ^ salts[own]), width, depth)].min(axis=0) >= least
                tally.add(groups, own[keep], terms.take(pa.array(term[keep])), n[keep], df[keep])
                if tally.size > tally.most and len(tally.parts) == 1:
                    yield from tally.rows()
        yield from tally.rows()

    # Tasks have summed up what they saw, so rows are shuffled as they are, once, to where both sums below are made.
    found = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exactly."""
    whole = lambda x: x.cast("decimal(20,0)")
    above, below = (whole(n) + F.lit(PRIOR)) * F.lit(SCALE).cast("decimal(12,0)"), whole(total) + whole(terms) * F.lit(PRIOR).cast("decimal(2,0)")
    return (F.lit(1) + F.call_function("div", above, below)).cast("long")


def audit(docs: DataFrame, least: int = 30, ranks: int = 50, width: int = 1 << 22, depth: int = 3) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: item is another source of the language, value the sum over all kept terms of the difference of
    shares. Part ``term``: the ``ranks`` kept terms by which the source's share most exceeds the language's. Kept
    are terms in at least ``least`` documents of the language."""
    blank = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x)
    rows = small_batches(docs).select(blank("lang"), blank("source"), blank("text"))
    word = Window.partitionBy("lang", "term")
    kept = counted(rows, least, width, depth).withColumns({"all_docs": F.sum("docs").over(word), "all_n": F.sum("n").over(word)}).where(F.col("all_docs") >= least)
    kept = written(kept.select("lang", "source", "term", "n", "all_n"), "kept")

    # One row for each group, with the smoothed share of a term that it lacks.
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("total", "terms", "lang_total")))
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(0))
    groups = written(groups.withColumn("zero", zero), "groups")
    shares = written(
        kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "zero", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("all_n"), F.col("lang_total"), F.col("terms")).alias("q")),
        "shares",
    )

    term = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = placed(term).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    pair = placed(pairs(shares, groups)).withColumn("part", F.lit("pair"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")


def pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (every other source of the language), value: the sum over all kept terms of |p - q|."""
    value = F.sum("part").alias("part")
    of = lambda df, i, *names, by=("lang",): df.select(*by, *(F.col(x).alias(f"{x}{i}") for x in ("source", *names)))
    # Terms of the first as if the second had none of them, by the first's distinct shares.
    histogram = shares.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("n"))
    other = if_small(of(groups, 2, "zero"))
    one = of(histogram, 1, "zero", "p", "n").join(other, "lang").where("source1 <> source2")
    one = one.select("lang", "source1", "source2", F.expr("n1 * (abs(p1 - zero2) - abs(zero1 - zero2))").alias("part")).groupBy("lang", "source1", "source2").agg(value)
    # Terms of both: what the two sums above said of them is taken back.
    both = of(shares, 1, "zero", "p", by=("lang", "term")).join(of(shares, 2, "zero", "p", by=("lang", "term")), ["lang", "term"]).where("source1 < source2")
    both = both.select("lang", "source1", "source2", F.expr("abs(p1 - p2) - abs(p1 - zero2) - abs(zero1 - p2) + abs(zero1 - zero2)").alias("part")).groupBy("lang", "source1", "source2").agg(value)
    swapped = lambda df: df.select("lang", F.col("source2").alias("source1"), F.col("source1").alias("source2"), "part")
    none = of(groups, 1, "zero", "terms").join(other, "lang").where("source1 <> source2").select("lang", "source1", "source2", F.expr("terms1 * abs(zero1 - zero2)").alias("part"))
    total = none.unionByName(one).unionByName(swapped(one)).unionByName(both).unionByName(swapped(both)).groupBy("lang", "source1", "source2").agg(F.sum("part").alias("value"))
    return total.select("lang", F.col("source1").alias("source"), F.col("source2").alias("item"), "value")


def placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
