"""Mixing sources to target weights by temperature.

A source with token share p gets weight p**a / sum(p**a). The exponent a in [0, 1] is found by bisection to
meet a target entropy of the weights, or to keep the ratio of the most to the least repeated source within
``repetition`` (the default). Weights times the token budget are the sources' quotas. Each source's
documents are dealt into blocks by hash; every epoch permutes the blocks anew, whole blocks are taken while
they fit the quota, and of the block at the boundary the documents that fit, in hashed order.

The bisection halves the interval four times with each aggregation over the table of sources, which never
leaves Spark. Blocks keep a hot source from being one group: cumulative sums run over blocks, and over
documents only within the boundary blocks.

The default budget is the least at which every source is used whole once.

Cases. Documents without tokens are drawn once for each whole epoch, and never beyond. Null source is a
source of its own. Repeated rows are drawn as separate documents. A quota smaller than the first document
of the boundary takes none of it. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import n_words, written

HALVINGS = 4
STRETCHES = 12  # bits of a block's turn that name its stretch


def bisect(shares: DataFrame, entropy: float | None, repetition: float, rounds: int = 8) -> float:
    """The largest exponent whose weights meet the target; both measures fall or rise evenly with it."""
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / 2**HALVINGS for i in range(1, 2**HALVINGS + 1)]
        measures = []
        for i, a in enumerate(grid):
            if entropy is not None:
                z, s = F.sum(F.exp(a * F.col("lp"))), F.sum(F.exp(a * F.col("lp")) * a * F.col("lp"))
                measures.append((F.log(z) - s / z >= entropy - 1e-12).alias(f"m{i}"))
            else:  # repeats of a source are p**(a - 1), up to a factor
                measures.append(((1 - a) * (F.max("lp") - F.min("lp")) <= math.log(repetition) + 1e-12).alias(f"m{i}"))
        met = [bool(x) for x in shares.agg(*measures).first()]
        if entropy is not None:  # entropy falls as the exponent grows: the largest that still meets it
            n = max((i for i, x in enumerate(met) if x), default=-1)
            lo, hi = (lo if n < 0 else grid[n]), (grid[n + 1] if n + 1 < len(grid) else hi)
        else:  # repetition falls as the exponent grows: the least that meets it
            n = min((i for i, x in enumerate(met) if x), default=len(grid) - 1)
            hi, lo = grid[n], (grid[n - 1] if n else lo)
    return lo if entropy is not None else hi


def weights(sources: DataFrame, entropy: float | None = None, repetition: float = 2.0, budget: float | None = None) -> DataFrame:
    """source, tokens, weight, quota of each source with tokens. ``sources``: source, tokens."""
    total = sources.where("tokens > 0").agg(F.sum("tokens").alias("total")).first()["total"]
    shares = written(sources.where("tokens > 0").withColumn("lp", F.log(F.col("tokens") / F.lit(total or 1))), "shares")
    if not total:
        return shares.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("quota"))
    a = bisect(shares, entropy, repetition)
    z = shares.agg(F.sum(F.exp(a * F.col("lp")))).first()[0]
    weight = F.exp(a * F.col("lp")) / z
    if budget is None:
        budget = shares.agg(F.max(F.col("tokens") / weight)).first()[0]
    return shares.select("source", "tokens", weight.alias("weight"), F.round(weight * budget, 3).alias("quota"))


def mix(docs: DataFrame, seed: int = 7, block_docs: int = 2_000, entropy: float | None = None, repetition: float = 2.0, budget: float | None = None) -> DataFrame:
    """One row for each draw: doc_id, source, n_tokens, epoch, block, draw_key (the order within the epoch)."""
    own = docs.select("doc_id", "source", n_words(F.col("text")).alias("n_tokens"), F.monotonically_increasing_id().alias("row"))
    own = written(own, "tokens")
    sources = written(own.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "sources")
    quota = weights(sources.select("source", "tokens"), entropy, repetition, budget)
    whole = F.floor(F.round(F.col("quota") / F.col("tokens"), 9))
    plan = sources.select("source", "n").join(quota.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = plan.select(
        F.col("source").alias("s"), F.ceil(F.col("n") / block_docs).alias("blocks"), F.coalesce(whole, F.lit(0)).alias("epochs"),
        F.coalesce(F.col("quota") - whole * F.col("tokens"), F.lit(0.0)).alias("rest"),
    )
    plan = written(plan, "plan")
    # The plan has a row for each source: Spark broadcasts it only if it is small, and splits hot sources of a larger one.
    key = F.xxhash64(F.lit(seed), "doc_id", "row")
    dealt = own.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("key", key).withColumn("block", F.pmod("key", "blocks"))
    sums = written(dealt.groupBy("source", "block", "epochs", "rest").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    turn = F.xxhash64(F.lit(seed), F.col("epochs"), "source", "block")
    # Cumulative sums in two levels: over the blocks of each stretch of turns, and over the stretches of a source.
    sums = sums.withColumns({"turn": turn, "stretch": F.shiftright(turn, 64 - STRETCHES)})
    so_far = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    stretches = sums.groupBy("source", "stretch").agg(F.sum("tokens").alias("tokens"))
    stretches = stretches.select(F.col("source").alias("s1"), F.col("stretch").alias("t1"), F.coalesce(F.sum("tokens").over(so_far("source").orderBy("stretch")), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("tokens").over(so_far("source", "stretch").orderBy("turn", "block")), F.lit(0))
    placed = sums.withColumn("inside", inside).join(stretches, F.col("source").eqNullSafe(F.col("s1")) & (F.col("stretch") == F.col("t1")))
    ends = written(placed.withColumn("before", F.col("earlier") + F.col("inside")).where(F.col("before") < F.col("rest")).select(
        F.col("source").alias("s2"), F.col("block").alias("b2"), (F.col("rest") - F.col("before")).alias("room"), (F.col("tokens") <= F.col("rest") - F.col("before") + 1e-6).alias("fits")), "ends")
    here = F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2"))
    edge = dealt.join(ends.where("not fits"), here).withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("key", "row"))).where(F.col("upto") <= F.col("room") + 1e-6)
    full = dealt.join(ends.where("fits"), here)
    again = full.select("doc_id", "source", "n_tokens", "block", "key", "epochs").unionByName(edge.select("doc_id", "source", "n_tokens", "block", "key", "epochs")).where("n_tokens > 0").withColumn("epoch", F.col("epochs"))
    first = dealt.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    order = F.xxhash64(F.lit(seed), "epoch", "source", "block")
    drawn = first.select("doc_id", "source", "n_tokens", "block", "key", "epoch").unionByName(again.select("doc_id", "source", "n_tokens", "block", "key", "epoch"))
    return drawn.select("doc_id", "source", "n_tokens", "epoch", "block", order.alias("block_key"), F.xxhash64("key", "epoch").alias("draw_key"))
