"""Quality by perplexity under an interpolated modified Kneser-Ney model of bytes.

Each language gets a model of order ``order`` trained on all of its trusted texts. Counts, continuation
counts, discounts and interpolation weights are made by joins of count tables that Spark shards by
(language, context) and (language, suffix). No gram is left out. The frozen probabilities are scored
against whole texts, about ``most`` grams at a time: a larger model is split by its contexts, and a text's
bits under the parts are added up. A text is rejected if its smoothed bits a byte exceed its language's
threshold: the ``quantile`` of trusted texts that were held out of the training, plus ``slack``.

Cases. Null and empty texts carry nothing to keep: kept is false, perplexity null. A text whose language
is null, or has no trusted text that was trained on or none that was held out, can't be judged and is kept,
with a null threshold. Short texts are drawn
towards their language's mean by ``prior`` bytes, so one odd word rejects nothing. Repeated rows count
each time; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import if_small, shipped, small_batches, utf8, written
from tracewright.llm.langid import gram_counts, inside, spans
from tracewright.llm.ngram import Level, Table

HELD_OUT = 8  # one trusted text of so many sets the thresholds and isn't trained on


def suffix(size: int):
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1))


def context():
    return F.shiftrightunsigned("gram", 8)


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(lang, size, gram, p) of every gram of every order, and (lang, size, context, gamma) as rows with ``gamma`` set."""
    levels = {order: counts.select(F.col("grp").alias("lang"), "gram", "n")}
    for size in range(order - 1, 0, -1):  # continuation counts: before how many different bytes
        levels[size] = levels[size + 1].groupBy("lang", suffix(size).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    every = None
    for size, rows in levels.items():
        rows = rows.select("lang", F.lit(size).alias("size"), "gram", "n")
        every = rows if every is None else every.unionByName(rows)
    every = written(every, "counts")

    # Modified Kneser-Ney discounts of each language and order, from the counts of counts 1 to 4.
    many = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cut = [F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(0.5)).alias(f"d{i}") for i in (1, 2, 3)]
    discounts = if_small(written(every.groupBy("lang", "size").agg(*many).select("lang", "size", *cut), "discounts"))
    own = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    counted = every.join(discounts, ["lang", "size"]).select("lang", "size", "gram", "n", own.alias("cut"), context().alias("context"))
    after = Window.partitionBy("lang", "size", "context")  # a context has 256 grams at most
    total, gamma = F.sum("n").over(after), F.sum("cut").over(after) / F.sum("n").over(after)
    own = written(counted.select("lang", "size", "gram", "context", ((F.col("n") - F.col("cut")) / total).alias("own"), gamma.alias("gamma")), "own")

    below = None
    for size in range(1, order + 1):
        here = own.where(F.col("size") == size)
        if below is None:
            p = here.select("lang", "size", "gram", "context", "gamma", (F.col("own") + F.col("gamma") / 256).alias("p"))
        else:
            shorter = below.select("lang", F.col("gram").alias("short"), F.col("p").alias("lower"))
            p = here.withColumn("short", suffix(size - 1)).join(shorter, ["lang", "short"]).select("lang", "size", "gram", "context", "gamma", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p"))
        p = written(p, f"p{size}")
        every = p if size == 1 else every.unionByName(p)
        below = p
    return every


def passes(p: DataFrame, order: int, most: int) -> list[list[tuple[str, tuple[int, int]]]]:
    """All of the models as (lang, span) in lists of about ``most`` grams: what is held at once. None is left out."""
    out, room = [], 0
    for lang, n in p.groupBy("lang").count().orderBy("lang").collect():
        parts = [(lang, x) for x in spans(p.where(F.col("lang") == lang), n, order, most)]
        if len(parts) == 1 and n <= room:
            out[-1] += parts
            room -= n
        else:
            out += [[x] for x in parts]
            room = most - n if len(parts) == 1 else 0
    return out


def tables(p: DataFrame, order: int, part: list[tuple[str, tuple[int, int]]] | None = None) -> dict[str, Table]:
    """The frozen models, one for each language; with ``part``, only of its languages and spans."""
    if part is None:
        part = [(lang, (0, (1 << (8 * (order - 1))) - 1)) for (lang,) in p.select("lang").distinct().collect()]
    out = {}
    cost = [(-F.log2(x)).cast("float").alias(x) for x in ("p", "gamma")]
    # A part is several whole languages or one span of one language, and is read at once.
    names = [lang for lang, _ in part]
    every = p.where(F.col("lang").isin(names) & inside(part[0][1], order)).select(F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int").alias("lang"), F.col("size").cast("byte"), "gram", *cost).toArrow() if part else None
    for i, (lang, span) in enumerate(part, 1):
        rows = every.filter(pc.equal(every.column("lang"), i))
        sizes = rows.column("size").to_numpy()
        levels = []
        for size in range(1, order + 1):
            x = rows.filter(pa.array(sizes == size))
            gram = x.column("gram").to_numpy().view(np.uint64)
            contexts, first = np.unique(gram >> np.uint64(8), return_index=True)
            levels.append(Level(size, gram, x.column("p").to_numpy()[:, None], contexts, x.column("gamma").to_numpy()[first][:, None]))
        out[lang] = Table(levels, span)
    return out


def perplexity(docs: DataFrame, models: dict[str, Table], keep: list[str]) -> DataFrame:
    """``keep`` columns, n_bytes and bits (null without a model for the language) of every whole text."""
    held = shipped(docs.sparkSession, {lang: x.plain() for lang, x in models.items()}, lambda plain: {lang: Table.of(x) for lang, x in plain.items()})
    rows = docs.select(*keep, F.col("lang").cast("string").alias("__lang"), F.col("text").alias("__text"))
    schema = ", ".join(f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in keep)

    def score(batches):
        models = held()
        for batch in batches:
            langs = np.array(batch.column("__lang").to_pylist(), dtype=object)
            text = batch.column("__text")
            bits, size = np.full(len(langs), np.nan), np.diff(utf8(text)[1])
            for lang in {x for x in langs if x in models}:
                mine = langs == lang
                bits[mine] = models[lang].bits(*utf8(text.filter(pa.array(mine))))[:, 0]
            yield pa.record_batch([*(batch.column(x) for x in keep), pa.array(size, pa.int64()), pa.array(bits, mask=np.isnan(bits))], names=[*keep, "n_bytes", "bits"])

    return small_batches(rows).mapInArrow(score, f"{schema}, n_bytes long, bits double")


def score(docs: DataFrame, p: DataFrame, order: int, most: int) -> DataFrame:
    """doc_id, lang, n_bytes and bits of every row, under all grams: models of over ``most`` are scored a part after another."""
    parts = passes(p, order, most)
    if len(parts) <= 1:
        return written(perplexity(docs, tables(p, order, parts[0] if parts else []), ["doc_id", "lang"]), "scored")
    keyed = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    every = None
    for i, part in enumerate(parts):
        mine = keyed.where(F.col("lang").isin([lang for lang, _ in part]))
        bits = written(perplexity(mine, tables(p, order, part), ["lang", "key"]).select("lang", "key", F.lit(i).alias("part"), "bits"), f"bits{i}")
        every = bits if every is None else every.unionByName(bits)
    once = every.groupBy("lang", "key", "part").agg(F.first("bits").alias("bits"))  # equal texts have equal bits
    bits = once.groupBy("lang", "key").agg(F.sum("bits").alias("bits"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return written(keyed.join(bits, ["lang", "key"], "left").select("doc_id", "lang", size, "bits"), "scored")


def judge(docs: DataFrame, labels: DataFrame, order: int = 5, most: int = 1_000_000, quantile: float = 0.99, slack: float = 0.15, prior: int = 200) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, bits_per_byte, perplexity (of a byte), threshold, kept.

    Trusted are documents labelled quality 1 and toxic 0.
    """
    docs = docs.select("doc_id", "lang", "text")
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    trusted = if_small(written(trusted, "trusted"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    train = docs.where(~held_out).join(trusted, "doc_id", "left_semi")
    counts = written(gram_counts(train, order, lower=False), "grams")
    scored = score(docs, kneser_ney(counts, order), order, most)
    base = scored.where(held_out & F.col("bits").isNotNull() & (F.col("n_bytes") > 0)).join(trusted, "doc_id", "left_semi")
    # A row for each language: joined where the documents are, however many of them one language has.
    mean = if_small(written(base.groupBy("lang").agg((F.sum("bits") / F.sum("n_bytes")).alias("mean")), "means"))
    smooth = (F.col("bits") + prior * F.col("mean")) / (F.col("n_bytes") + prior)
    limits = base.join(mean, "lang").groupBy("lang").agg(F.first("mean").alias("mean"), (F.percentile_approx(smooth, quantile, 10_000) + slack).alias("threshold"))
    limits = if_small(written(limits, "limits"))
    empty = F.col("n_bytes") == 0
    return scored.join(limits, "lang", "left").select(
        "doc_id", "lang", "n_bytes",
        F.when(~empty, F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
        F.when(~empty, F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes"))).alias("perplexity"),
        "threshold",
        (~empty & F.coalesce(smooth <= F.col("threshold"), F.lit(True))).alias("kept"),
    )
