"""Near-duplicate groups from bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles. Its sketch is the k smallest hashes of the set.
Documents with equal sets are one class from the start, so copies never form pairs. Inverted lists of
retained values generate candidate pairs; an estimate from the sketch of the union filters them; the exact
Jaccard similarity of the full sets confirms each link.

Which values are listed. Documents as similar as the threshold t share about t * k retained values and,
but for a chance of about 1e-8, at least ``floor(0.4 * k)`` of them. So each document lists only its
rarest ``k - floor(0.4 * k) + 1`` values in an order that is the same for all (how many sketches hold the
value, then the value): two such documents must then meet in a list. A passage that many documents share
is listed by none that also has enough text of its own.

Long lists. Lists of up to ``short`` documents give all their pairs. In a longer list each member is first
compared with the list's most central member, the one whose retained values most others retain too: of near
copies that is one close to the common original. Those linked to one such hub are one group already, so only
pairs that don't share a hub are still open. They are found by a prefix filter on full sets, which loses no
link. A large group of near copies so costs pairs in proportion to its size, and there is no cap on
candidates or partners.

``exact`` skips the sketches and finds all candidates by that prefix filter, so no link can be missed.

Cases. Null text or text without words: an empty set, linked with nothing. Fewer than five words: the whole
sequence is the only shingle. Rows that share a doc_id are linked each by its own text, under the one name.
A null doc_id is linked with nothing and kept. Very long texts count whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import Runs, if_small, shipped, small_batches, texts, word_hashes, written
from tracewright.llm.graph import components

SHARE = 0.4  # of a sketch's values, at least, that two linked documents have in common
BITS = 1024  # of the bitmaps that tell sets apart
BUCKETS = 1 << 20  # of the table of counts that orders shingles
HEAP = 1_000  # members of a long list that lie side by side


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of the text, with A-Z lower-cased."""
    words = text.lower().split()  # bytes: lower() knows A-Z alone, split() just \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.int64)
    found = Runs(word_hashes(words)).windows(min(size, len(words)))
    if len(words) < size:
        found = found ^ np.uint64(len(words))
    return np.unique(found >> np.uint64(1)).view(np.int64)


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, n (size of the set), digest of the whole set, the k smallest hashes."""

    def sketch(batches):
        for batch in batches:
            n, digest, least = [], [], []
            for text in texts(batch.column("text")):
                found = shingle_set(text, size)
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                least.append(found[:k])
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "sketch"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, "doc_id long, n long, digest binary, sketch array<long>")


def listed(classes: DataFrame) -> DataFrame:
    """(v, id, n, many, score): each class's rarest retained values that other sketches hold too.

    many: how many hold v; score: how many hold the class's values, in all.
    """
    posts = classes.select("id", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    many = posts.groupBy("v").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared, own = posts.join(many, "v"), Window.partitionBy("id", "n")
    # Values that nobody else holds come first in the order: they are all of k but the shared ones.
    alone = F.col("k") - F.count(F.lit(1)).over(own)
    ranked = shared.select("v", "id", "n", "k", "many", F.sum("many").over(own).alias("score"), (alone + F.row_number().over(own.orderBy("many", "v"))).alias("rank"))
    need = F.greatest(F.lit(1), F.floor(F.col("k") * SHARE))
    return ranked.where(F.col("rank") <= F.col("k") - need + 1).select("v", "id", "n", "many", "score")


def whole_sets(docs: DataFrame, some: DataFrame, size: int) -> DataFrame:
    """id, n, the whole set and its bitmap for the documents in ``some``.

    The bitmap holds the parity of the shingles that fall on each of its bits, so two bitmaps differ in at
    most as many bits as their sets in shingles.
    """

    def build(batches):
        longs = pa.list_(pa.int64())
        for batch in batches:
            sets = [shingle_set(text, size) for text in texts(batch.column("text"))]
            bits = [np.packbits((np.bincount(x % BITS, minlength=BITS) & 1).astype(np.uint8)).view(np.int64) for x in sets]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, longs), pa.array(bits, longs)], names=["id", "n", "whole", "bits"])

    own = docs.select(F.col("doc_id").cast("long"), "text").join(if_small(some), "doc_id", "left_semi")
    return small_batches(own).mapInArrow(build, "id long, n long, whole array<long>, bits array<long>")


def across(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups that can be linked: the exact prefix filter on full sets.

    ``sets``: id, grp, n, whole, bits, and near one another what is likely alike. Sets of sizes n with a
    similarity of ``percent`` share their first n - ceil(percent * n) + 1 shingles, in any order that is the
    same for all, with at least one of the other's. The order has shingles last that are frequent among the
    sets of some task, so a document with enough shingles of its own lists none that are frequent.
    The places of that shingle bound what two sets can share (the positional filter), and their bitmaps in how
    many shingles they differ at least (the bitmap filter). None of these drops a link.
    """
    sets = written(sets, "full")

    def count(batches):
        many = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            many += np.bincount(batch.column("whole").flatten().to_numpy() % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(many > 1)
        yield pa.record_batch([pa.array(at), pa.array(many[at])], names=["bucket", "many"])

    found = sets.select("whole").mapInArrow(count, "bucket long, many long").groupBy("bucket").agg(F.sum("many").alias("many")).toArrow()
    counts = np.ones(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("many").to_numpy()
    counts = shipped(sets.sparkSession, counts)

    def rarest(batches):
        many = counts()
        for batch in batches:
            rows = zip(batch.column("id").to_pylist(), batch.column("grp").to_pylist(), batch.column("whole"), strict=True)
            for one, grp, whole in rows:
                v = whole.values.to_numpy()
                n = len(v)
                first = np.lexsort((v, many[v % BUCKETS]))[: n + percent * -n // 100 + 1]
                same = lambda x: pa.array(np.full(len(first), x, np.int64))  # noqa: B023, E731
                yield pa.record_batch([pa.array(v[first]), same(one), same(grp), same(n), pa.array(n - 1 - np.arange(len(first)))], names=["v", "id", "grp", "n", "left"])

    lists = written(sets.select("id", "grp", "whole").mapInArrow(rarest, "v long, id long, grp long, n long, left long"), "prefixes")
    sizes = lists.groupBy("v", "grp").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("v").agg(F.max(F.struct("size", "grp")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    lists = lists.join(most.select("v", F.col("most.grp").alias("main")), "v")
    lists = written(lists.join(sets.select("id", "n", "bits").distinct(), ["id", "n"]), "members")
    both = F.col("x.n") + F.col("y.n")
    meet = (F.col("x.v") == F.col("y.v")) & (F.col("x.grp") != F.col("y.grp"))
    meet &= (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    meet &= (F.col("y.grp") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    # Where two documents first meet, they can share that shingle and what both have left; later ones may fail this.
    meet &= (1 + F.least("x.left", "y.left")) * (100 + percent) >= percent * both
    differ = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(BITS // 64)), F.lit(0))
    meet &= differ * (100 + percent) <= (100 - percent) * both
    rest = lists.where("grp <> main")
    return rest.alias("x").join(lists.alias("y"), meet).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def likely(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of which the sketch of the union says that they may be linked."""
    of = lambda x: classes.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    return both.where(F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))) >= F.floor(F.size("u") * SHARE)).select("a", "b").distinct()


def with_sets(pairs: DataFrame, key: str, other: str, sets: DataFrame) -> DataFrame:
    """``pairs`` with the whole set of ``key`` as w<key>. A document with very many partners has them dealt into heaps of
    about HEAP, each of which gets a copy of its set, so no task meets all partners of one document."""
    whole = sets.select(F.col("id").alias(key), F.col("whole").alias(f"w{key}"))
    hot = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("heaps")).where(F.col("heaps") > HEAP).withColumn("heaps", F.ceil(F.col("heaps") / HEAP))
    hot = if_small(written(hot, "hot"))
    heap = F.coalesce(F.pmod(F.xxhash64(other), "heaps"), F.lit(0).cast("long"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("heaps") - 1, F.lit(0).cast("long"))))
    dealt = pairs.join(hot, key, "left").withColumn("heap", heap).drop("heaps")
    return dealt.join(whole.join(hot, key, "left").withColumn("heap", copies).drop("heaps"), [key, "heap"]).drop("heap")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def verify(batches):
        for batch in batches:
            keep = []
            for mine, other in zip(batch.column("wa"), batch.column("wb"), strict=True):
                mine, other = mine.values.to_numpy(), other.values.to_numpy()
                same = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * same >= percent * (len(mine) + len(other) - same) and same > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs, "pairs")
    full = with_sets(with_sets(pairs, "b", "a", sets), "a", "b", sets).select("a", "b", "wa", "wb")
    return written(small_batches(full).mapInArrow(verify, "a long, b long"), "links").distinct()


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 32, short: int = 64, exact: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id of the group), kept."""
    sets = written(sketches(docs, size, k), "sets")
    copies = sets.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    copies = if_small(written(copies.select("digest", "first"), "copies"))
    sets = sets.join(copies, "digest", "left").withColumn("id", F.when(F.col("n") > 0, F.coalesce("first", "doc_id")))
    once = sets.where("first is null and id is not null").unionByName(sets.where("first = doc_id").dropDuplicates(["id", "digest"]))
    classes = written(once.select("id", "n", "sketch"), "classes")
    near = F.col("x.n") * 100 >= F.col("y.n") * percent
    near &= F.col("y.n") * 100 >= F.col("x.n") * percent

    if exact:
        full = written(whole_sets(docs, written(classes.select(F.col("id").alias("doc_id")), "ids"), size), "whole")
        links = confirmed(across(full.withColumn("grp", F.col("id")), percent), full, percent)
    else:
        lists = written(listed(classes), "lists")
        few = lists.where(F.col("many") <= short)
        pairs = few.alias("x").join(few.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.id") < F.col("y.id")) & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        long = lists.where(F.col("many") > short)
        hubs = written(long.groupBy("v").agg(F.max(F.struct("score", (-F.col("id")).alias("less"), "n")).alias("hub")).select("v", (-F.col("hub.less")).alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
        star = long.alias("x").join(hubs.select("v", F.col("hub").alias("id"), F.col("hub_n").alias("n")).alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.id") != F.col("y.id")) & near)
        pairs = pairs.unionByName(star.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))).distinct()
        pairs = written(likely(pairs, classes, k), "likely")
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(long.select(F.col("id").alias("doc_id")))
        full = written(whole_sets(docs, written(ids.distinct(), "ids"), size), "whole")
        links = confirmed(pairs, full, percent)

        # A member's group is the least hub that it is linked to or is itself.
        at = hubs.select("hub").distinct()
        led = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(if_small(written(at, "hub")), F.col("a") == F.col("hub")).select(F.col("b").alias("id"), F.col("a").alias("grp"))
        led = led.unionByName(at.select(F.col("hub").alias("id"), F.col("hub").alias("grp"))).groupBy("id").agg(F.min("grp").alias("grp"))
        members = long.join(led, "id", "left").select("v", "many", "id", F.coalesce("grp", "id").alias("grp"))
        open_lists = members.groupBy("v").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("v")
        unsettled = members.join(open_lists, "v", "left_semi").groupBy("id").agg(F.min("grp").alias("grp"), F.min(F.struct("v", "many")).alias("at"))
        unsettled = written(unsettled.select("id", "grp", "at.v", "at.many"), "unsettled")
        # Members of a list lie side by side, in heaps of about HEAP.
        heap = F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / HEAP))
        links = links.unionByName(confirmed(across(full.join(if_small(unsettled), "id").repartition("v", heap).drop("v", "many"), percent), full, percent))

    group = components(links)
    group = group.withColumnRenamed("id", "of")
    out = sets.join(group, F.col("id") == F.col("of"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
