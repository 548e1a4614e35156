"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree with escape probabilities (method C: a context that
was seen T times with D different next bytes gives a byte seen c times c / (T + D), and escapes to the
next shorter context with D / (T + D)) is counted over all training texts and then frozen. No gram is left
out: trees too large to be held at once are split by contexts, and a text's bits under the parts are added up. A text's score
is its exact code length in bits under each tree; the shortest code names the language.

Cases. Null text, or text with no letter: ``und`` with score 0. Empty training table: ``und``. Ties go to
the language first in order. Rows with a null language teach nothing but are predicted. Repeated rows and
very long texts count whole; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, shipped, small_batches, utf8, written
from tracewright.llm.ngram import Level, Summed, Table, UNKNOWN_BITS, count_grams

UNDETERMINED = "und"
BLOCK = 8  # languages whose code lengths are held side by side


def gram_counts(docs: DataFrame, order: int, group: str = "lang", text: str = "text", lower: bool = True) -> DataFrame:
    """(grp, gram, n): how often each byte n-gram occurs in each group's texts, over all rows."""

    def count(batches):
        sums: dict[str, Summed] = {}
        schema = pa.schema([("grp", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

        def rows(name, got):
            return pa.record_batch([pa.array([name] * len(got[0])), pa.array(got[0].view(np.int64)), pa.array(got[1].astype(np.int64))], schema=schema)

        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), dtype=object)
            for name in sorted(set(groups)):
                one = sums.setdefault(name, Summed())
                data, offsets = utf8(batch.column("text").filter(pa.array(groups == name)))
                for keys, n in count_grams(data, offsets, order, LOWER if lower else None):
                    one.add(keys, n)
                    if (got := one.take()) is not None:
                        yield rows(name, got)
        for name, one in sums.items():
            if (got := one.take(force=True)) is not None:
                yield rows(name, got)

    own = docs.select(F.col(group).cast("string").alias("grp"), F.col(text).alias("text")).where("grp is not null and text is not null")
    return small_batches(own).mapInArrow(count, "grp string, gram long, n long").groupBy("grp", "gram").agg(F.sum("n").alias("n"))


def reach(order: int) -> tuple[Column, Column]:
    """The first and last context of ``order - 1`` bytes, read backwards, that end in the context of a row's gram of ``size`` bytes."""
    lo = F.lit(0).cast("long")
    for i in range(order - 1):
        lo = lo + F.shiftleft(F.shiftrightunsigned("gram", 8 * (i + 1)).bitwiseAND(F.lit(255)), 8 * (order - 2 - i))
    return lo, lo + F.expr(f"shiftleft(1L, 8 * ({order} - size)) - 1")


def spans(rows: DataFrame, n: int, order: int, most: int) -> list[tuple[int, int]]:
    """Spans of contexts that cover all, each reached by about ``most`` of the ``n`` rows (size, gram). A row is in all it reaches."""
    parts, cuts = -(-n // most), []
    if parts > 1:
        cuts = rows.select(F.percentile_approx(reach(order)[0], [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
    edges = [*sorted({0, *cuts}), 1 << (8 * (order - 1))]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def inside(span: tuple[int, int], order: int) -> Column:
    lo, hi = reach(order)
    return (lo <= span[1]) & (hi >= span[0])


class PPM:
    """Frozen context trees of several languages as tables of code lengths, one for each block of languages and span of contexts.

    ``rows`` are the written counts (grp, size, gram, n) of all orders. ``parts`` are (block number, span).
    """

    def __init__(self, languages: list[str], rows: DataFrame | None = None, order: int = 0, parts: list[tuple[int, tuple[int, int]]] = ()):
        self.languages, self.rows, self.order, self.parts = languages, rows, order, list(parts)

    def block(self, i: int) -> list[str]:
        return self.languages[i * BLOCK : (i + 1) * BLOCK]

    def table(self, part: tuple[int, tuple[int, int]]) -> Table:
        number, span = part
        rows = self.rows.where(F.col("grp").isin(self.block(number)) & inside(span, self.order)).select("grp", F.col("size").cast("byte"), "gram", "n").toArrow()
        grp, size = np.array(rows.column("grp").to_pylist(), dtype=object), rows.column("size").to_numpy()
        return frozen(self.block(number), grp, size, rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy(), self.order, span)

    @staticmethod
    def fit(docs: DataFrame, order: int = 4, most: int = 1_000_000, text: str = "text", lang: str = "lang") -> PPM:
        """Count all of ``docs``. About ``most`` counts are frozen and sent to the executors at a time; none is left out."""
        level = written(gram_counts(docs, order, lang, text), "grams").select("grp", F.lit(order).alias("size"), "gram", "n")
        every = level
        for size in range(order - 1, 0, -1):
            short = F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1)).alias("gram")
            level = level.groupBy("grp", short).agg(F.sum("n").alias("n")).select("grp", F.lit(size).alias("size"), "gram", "n")
            every = every.unionByName(level)
        every = written(every, "trees")
        counted = {r.grp: r["count"] for r in every.groupBy("grp").count().collect()}
        model = PPM(sorted(counted), every, order)
        for i in range(-(-len(counted) // BLOCK)):
            names = model.block(i)
            model.parts += [(i, x) for x in spans(every.where(F.col("grp").isin(names)), sum(counted[x] for x in names), order, most)]
        return model


def frozen(languages: list[str], grp: np.ndarray, size: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, span: tuple[int, int]) -> Table:
    """The code lengths of one part: ``size``, ``gram`` and ``n`` hold every gram whose context reaches the span."""
    column = np.searchsorted(np.array(languages, dtype=object), grp)
    levels: list[Level] = []
    for k in range(1, order + 1):
        at = size == k
        keys, row = np.unique(gram[at], return_inverse=True)
        count = np.zeros((len(keys), len(languages)))
        count[row, column[at]] = n[at]
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, of, count)
        np.add.at(kinds, of, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(count / (total + kinds)[of])
        if k == 1:
            shorter = np.full(count.shape, UNKNOWN_BITS)
        else:
            last = levels[-1]
            shorter = last.cost[np.searchsorted(last.keys, keys & np.uint64((1 << (8 * (k - 1))) - 1))]
        cost = np.where(count > 0, own, leave[of] + shorter)
        levels.append(Level(k, keys, cost.astype(np.float32), contexts, leave.astype(np.float32)))
    return Table(levels, span)


def part_bits(keyed: DataFrame, table: Table, part: int, block: int) -> DataFrame:
    """(key, block, part, b0, b1, ...) of every row: the bits that one part gives it under each language of its block."""
    held = shipped(keyed.sparkSession, table.plain(), Table.of)
    names = ["key", *(f"b{i}" for i in range(BLOCK))]

    def score(batches):
        table = held()
        for batch in batches:
            bits = np.zeros((batch.num_rows, BLOCK))
            bits[:, : table.width] = table.bits(*utf8(batch.column("__text")), LOWER)
            yield pa.record_batch([batch.column("key"), *(pa.array(bits[:, i].copy()) for i in range(BLOCK))], names=names)

    schema = "key string, " + ", ".join(f"{x} double" for x in names[1:])
    return small_batches(keyed.select(F.col("__key").alias("key"), "__text")).mapInArrow(score, schema).select("key", F.lit(block).alias("block"), F.lit(part).alias("part"), *names[1:])


def predict_parts(kept: DataFrame, model: PPM, names: list[str]) -> DataFrame:
    """The rows of ``predict`` when the trees are held a part after another: bits are added up by text."""
    keyed = kept.withColumn("__key", F.sha2(F.coalesce("__text", F.lit("")), 256))
    every = None
    for i, part in enumerate(model.parts):
        bits = written(part_bits(keyed, model.table(part), i, part[0]), f"bits{i}")
        every = bits if every is None else every.unionByName(bits)
    columns = [f"b{i}" for i in range(BLOCK)]
    once = every.groupBy("key", "block", "part").agg(*(F.first(x).alias(x) for x in columns))  # equal texts have equal bits
    sums = once.groupBy("key", "block").agg(*(F.sum(x).alias(x) for x in columns))
    lists = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", F.array(*columns).alias("bits")))).alias("__blocks"))
    lists = lists.select(F.col("key").alias("__key"), F.slice(F.flatten("__blocks.bits"), 1, len(model.languages)).alias("__bits"))
    best = F.array_min("__bits")
    odds = F.aggregate("__bits", F.lit(0.0), lambda sum, x: sum + F.pow(F.lit(2.0), F.greatest(best - x, F.lit(-1000.0))))
    lang = F.element_at(F.array(*(F.lit(x) for x in model.languages)), F.array_position("__bits", best).cast("int"))
    letters = F.col("__letters")
    return keyed.join(lists, "__key", "left").select(
        *names,
        F.when(letters, lang).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(letters, 1 / odds).otherwise(F.lit(0.0)).alias("score"),
        F.when(letters, best).otherwise(F.lit(0.0)).alias("bits"),
    )


def predict(docs: DataFrame, model: PPM, text: str = "text", keep: list[str | Column] = ()) -> DataFrame:
    """``keep`` columns, then lang_pred, score (the share of the best code's probability) and bits of every row."""
    spark = docs.sparkSession
    kept = docs.select(*keep, F.col(text).alias("__text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    names = [x for x in kept.columns if x not in ("__text", "__letters")]
    if len(model.parts) > 1:
        return predict_parts(kept, model, names)
    languages = model.languages
    held = shipped(spark, model.table(model.parts[0]).plain() if model.parts else None, lambda plain: plain and Table.of(plain))
    schema = ", ".join([*(f"`{x}` {kept.schema[x].dataType.simpleString()}" for x in names), "lang_pred string, score double, bits double"])

    def score(batches):
        table = held()
        for batch in batches:
            letters = np.array(batch.column("__letters").to_pylist(), dtype=bool)
            lang = np.full(len(letters), UNDETERMINED, dtype=object)
            share, best = np.zeros(len(letters)), np.zeros(len(letters))
            if table is not None and len(letters):
                bits = table.bits(*utf8(batch.column("__text")), LOWER)
                first = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), first]
                odds = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                lang = np.where(letters, np.array(languages, dtype=object)[first], UNDETERMINED)
                share, best = np.where(letters, 1 / odds, 0.0), np.where(letters, least, 0.0)
            columns = [batch.column(x) for x in names]
            yield pa.record_batch([*columns, pa.array(lang, pa.string()), pa.array(share), pa.array(best)], names=[*names, "lang_pred", "score", "bits"])

    return small_batches(kept).mapInArrow(score, schema)
