"""Change metrics, adaptive thresholds, boundaries and segment spans of frame series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.ordered import bound, in_order


def frame_deltas(frames: DataFrame) -> DataFrame:
    """Differences to the job's previous frame; 0 for its first."""
    w = in_order()
    delta = lambda c: F.round(F.abs(F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))), 6)
    return frames.select("job_id", "ord", delta("boundary_score").alias("score_delta"), delta("visual_score").alias("visual_delta"), delta("time_sec").alias("gap"))


def thresholds(frames: DataFrame) -> DataFrame:
    """One row per job: median, mad, percentile, threshold over all frames but the first."""
    x = F.when(F.col("ord") > 0, F.col("boundary_score"))
    one = frames.groupBy("job_id").agg(F.median(x).alias("median"), F.percentile(x, 0.88).alias("p88"), F.percentile(x, 0.94).alias("p94"), (F.max(x) - F.min(x)).alias("range"), F.collect_list(x).alias("all"))
    # A recording has few frames, so its deviations fit one row; this saves two more passes over the frames.
    one = one.withColumn("all", F.array_sort(F.transform("all", lambda v: F.abs(v - F.col("median")))))
    middle = lambda i: F.get("all", F.floor(i).cast("int"))
    mad = (middle((F.size("all") - 1) / 2) + middle(F.size("all") / 2)) / 2
    out = one.withColumn("mad", mad).withColumn("mad", F.when(F.col("mad") == 0, 1e-6).otherwise(F.col("mad")))
    limit = F.when(F.col("range") < 0.03, F.col("p94")).otherwise(F.greatest(F.col("median") + 2.5 * F.col("mad"), F.col("p88")))
    found = out.select("job_id", "median", "mad", F.col("p88").alias("percentile"), limit.alias("threshold"))
    return found.select("job_id", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("median", 0.0), ("mad", 0.0), ("percentile", 1.0), ("threshold", 1.0))])


def score_sketches(frames: DataFrame, by: list[str], k: int = 400) -> DataFrame:
    """A quantile sketch of the scores of each group, of bounded size: ``by``, sketch. All frames but each job's first count.

    Sketches of parts of a job, such as its days, can be kept and merged; ``k`` sets how exact they are."""
    scores = frames.where("ord > 0").groupBy(*by)
    return scores.agg(F.kll_sketch_agg_double("boundary_score", F.lit(k)).alias("sketch"), F.min("boundary_score").alias("low"), F.max("boundary_score").alias("high"))


def sketched_thresholds(frames: DataFrame, part: str, k: int = 400) -> DataFrame:
    """``thresholds`` from sketches of the parts of each job, merged; a job's frames are never together in one row.

    Two passes: of the scores, and of their deviations from the median that the first one gives. Quantiles are scores whose
    rank is off by about 1.3 / k ** 0.9 of the frames at most, 0.6 % by default, but for a chance of one in a hundred."""
    merged = lambda rows: rows.groupBy("job_id").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.min("low").alias("low"), F.max("high").alias("high"))
    share = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    one = merged(score_sketches(frames, ["job_id", part], k)).select("job_id", share(0.5).alias("median"), share(0.88).alias("p88"), share(0.94).alias("p94"), (F.col("high") - F.col("low")).alias("range"))
    apart = frames.join(one.select("job_id", "median"), "job_id").withColumn("boundary_score", F.abs(F.col("boundary_score") - F.col("median")))
    two = merged(score_sketches(apart, ["job_id", part], k)).select("job_id", share(0.5).alias("mad"))
    out = frames.select("job_id").distinct().join(one, "job_id", "left").join(two, "job_id", "left").withColumn("mad", F.when(F.col("mad") == 0, 1e-6).otherwise(F.col("mad")))
    limit = F.when(F.col("range") < 0.03, F.col("p94")).otherwise(F.greatest(F.col("median") + 2.5 * F.col("mad"), F.col("p88")))
    found = {"median": ("median", 0.0), "mad": ("mad", 0.0), "percentile": ("p88", 1.0)}
    return out.select("job_id", *[F.coalesce(c, F.lit(d)).alias(name) for name, (c, d) in found.items()], F.coalesce(limit, F.lit(1.0)).alias("threshold"))


def boundary_starts(frames: DataFrame, max_segments: int = 20, min_stable: float | None = None) -> DataFrame:
    """job_id, starts (array of ord, time_sec, score, reason): the frames that begin a segment, by job, which may be none.

    A frame qualifies by the threshold or among the job's highest scores. Within ``min_stable`` (if none is
    given 3, for recordings under 20 long 1) of the last accepted one it may only replace it, if its score is higher. A job ends at ``max_segments`` - 1."""
    entry = F.struct("ord", "time_sec", "boundary_score")
    job = F.struct(F.array_sort(F.collect_list(F.when(F.col("ord") > 0, entry))).alias("rest"), (F.max("time_sec") - F.min("time_sec")).alias("lasts"))
    back = lambda x: F.struct((-x["boundary_score"]).alias("less"), x["ord"].alias("ord"))
    kind = "array<struct<ord:int,time_sec:double,score:double,reason:string>>"
    found = lambda x, reason: F.struct(x["ord"].alias("ord"), x["time_sec"].alias("time_sec"), x["boundary_score"].alias("score"), reason.alias("reason"))

    def kept_of(rest: Column, p: Column) -> Column:
        high = lambda x: (back(x) <= p["last"]) & (x["boundary_score"] >= p["floor"])

        def step(kept, x):
            n, last = F.size(kept), F.try_element_at(kept, F.lit(-1))
            close = (n > 0) & (x["time_sec"] - last["time_sec"] < p["calm"])
            replaced = F.array_append(F.slice(kept, F.lit(1), F.greatest(n - 1, F.lit(0))), found(x, F.lit("hysteresis-replace")))
            added = F.array_append(kept, found(x, F.when(x["boundary_score"] >= p["limit"], "adaptive-threshold").otherwise("top-percentile")))
            go = (n == 0) | (n < max_segments - 1)
            return F.when(~go, kept).when(close & (x["boundary_score"] > last["score"]), replaced).when(close, kept).otherwise(added)

        return F.aggregate(F.filter(rest, lambda x: (x["boundary_score"] >= p["limit"]) | high(x)), F.array().cast(kind), step)

    def starts_of(rest: Column, lasts: Column) -> Column:
        n_top = F.least(F.greatest(F.lit(2), F.lit(max_segments // 3)), F.greatest(F.lit(2), F.floor(F.size(rest) / 4).cast("int")))
        last = F.get(F.array_sort(F.transform(rest, back)), F.least(n_top, F.size(rest)) - 1)  # the lowest of the highest scores
        calm = F.lit(min_stable) if min_stable is not None else F.when(lasts < 20, 1.0).otherwise(3.0)

        def limits(q: Column) -> Column:
            limit = F.when(q["range"] < 0.03, q["p94"]).otherwise(F.greatest(q["median"] + 2.5 * F.coalesce(F.nullif(q["mad"], F.lit(0.0)), F.lit(1e-6)), q["p88"]))
            return F.struct(limit.alias("limit"), F.greatest(F.lit(0.01), q["p88"] * 0.75).alias("floor"), calm.cast("double").alias("calm"), last.alias("last"))

        def measures(scores: Column) -> Column:
            mad = lambda m: quantile(F.array_sort(F.transform(scores, lambda v: F.abs(v - m))), 0.5)
            spread = F.element_at(scores, -1) - F.element_at(scores, 1)
            return F.struct(quantile(scores, 0.5).alias("median"), bound(quantile(scores, 0.5), mad).alias("mad"), quantile(scores, 0.88).alias("p88"), quantile(scores, 0.94).alias("p94"), spread.alias("range"))

        scores = F.array_sort(F.transform(rest, lambda x: x["boundary_score"]))
        return bound(bound(scores, measures), lambda q: bound(limits(q), lambda p: kept_of(rest, p)))

    # No filter on what was found: it would be pushed before the fold, and all of it computed twice.
    return frames.groupBy("job_id").agg(bound(job, lambda x: F.when(F.size(x["rest"]) > 0, starts_of(x["rest"], x["lasts"])).otherwise(F.array().cast(kind))).alias("starts"))


def quantile(values: Column | str, share: float) -> Column:
    """Of a sorted array, between its values by their distance; null if it is empty."""
    values = F.col(values) if isinstance(values, str) else values
    at = (F.size(values) - 1) * F.lit(share)
    low, high = F.floor(at), F.ceil(at)
    value = lambda i: F.get(values, i.cast("int"))
    return F.when(value(low) == value(high), value(low)).otherwise((high - at) * value(low) + (at - low) * value(high))


def boundary_candidates(frames: DataFrame, max_segments: int = 20, min_stable: float | None = None) -> DataFrame:
    """job_id, ord, time_sec, boundary_score, reason of the frames that ``boundary_starts`` finds."""
    found = boundary_starts(frames, max_segments, min_stable).select("job_id", F.explode("starts").alias("x"))
    return found.select("job_id", "x.ord", "x.time_sec", F.col("x.score").alias("boundary_score"), "x.reason")


def spans(frames: DataFrame, starts: DataFrame) -> DataFrame:
    """job_id, segment, start_ord, end_ord, start_time, end_time, frame_count, boundary_score (of the boundary that closes it; 0 for the last)."""
    marked = frames.join(starts.select("job_id", "ord", F.lit(1).alias("mark")), ["job_id", "ord"], "left")
    number = F.sum(F.coalesce("mark", F.lit(0))).over(in_order().rowsBetween(Window.unboundedPreceding, 0)) + 1
    got = marked.withColumn("segment", number).groupBy("job_id", "segment").agg(
        F.min("ord").alias("start_ord"), (F.max("ord") + 1).alias("end_ord"), F.min("time_sec").alias("start_time"), F.max("time_sec").alias("end_time"),
        F.count(F.lit(1)).alias("frame_count"), F.min_by("boundary_score", "ord").alias("own"),
    )
    return got.withColumn("boundary_score", F.coalesce(F.lead("own").over(in_order("segment")), F.lit(0.0))).drop("own")


def located(frames: DataFrame, spans: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Frames with the columns of the span that they lie in, start_ord and end_ord among them; frames in none are left out.

    Spans don't overlap, so frames and spans are laid side by side in order and each frame takes the last span
    begun: one sort of both, however many frames and spans a job has."""
    names = list(dict.fromkeys(("start_ord", "end_ord", *columns)))
    begun = spans.select("job_id", F.col("start_ord").cast(frames.schema["ord"].dataType).alias("ord"), F.lit(0).alias("__kind"), F.struct(*names).alias("__span"))
    rows = frames.withColumn("__kind", F.lit(1)).unionByName(begun, allowMissingColumns=True)
    rows = rows.withColumn("__span", F.last("__span", ignorenulls=True).over(in_order("ord", "__kind").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("__kind = 1 and ord < __span.end_ord")
    return rows.select(*[c for c in frames.columns if c not in names], *[F.col(f"__span.{c}").alias(c) for c in names])


def cuts(rows: DataFrame, longest: float) -> DataFrame:
    """job_id, segment, cut, end_ord: where spans begin, and where those are cut that last longer than ``longest``.

    ``rows``: frames with segment, start_ord, end_ord, start_time and end_time of their span. Each of the k - 1 targets
    at i / k takes the nearest inner frame with a score of 0.01 or more (of equals the higher score, then the earlier);
    where a span has none, the frame at that share of it. A target lies between two neighbouring frames and only
    meets these, so the work is in proportion to frames and targets."""
    lasts = F.col("end_time") - F.col("start_time")
    k = F.when(lasts > longest, F.greatest(F.lit(2), F.ceil(lasts / longest).cast("int"))).otherwise(1)
    span = ["start_ord", "end_ord", "start_time", "end_time", "k"]
    inner = (F.col("k") > 1) & (F.col("boundary_score") >= 0.01) & (F.col("ord") > F.col("start_ord")) & (F.col("ord") < F.col("end_ord") - 1)
    rows = rows.select("job_id", "segment", "ord", "time_sec", "boundary_score", *span[:-1], k.alias("k")).withColumn("inner", inner)
    # Of inner frames at one time the best stands for all; it knows the next one.
    w = Window.partitionBy("job_id", "segment")
    first = F.row_number().over(Window.partitionBy("job_id", "segment", "time_sec", "inner").orderBy(F.desc("boundary_score"), "ord")) == 1
    rows = rows.withColumn("here", F.when(F.col("inner") & first, F.struct("time_sec", "boundary_score", "ord")))
    # Backwards, as a frame to the end is summed up anew for each row.
    behind = w.orderBy(F.desc("time_sec"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"after": F.last("here", ignorenulls=True).over(behind), "lowest": F.min("here.time_sec").over(w)})

    target = lambda i: F.col("start_time") + (F.col("end_time") - F.col("start_time")) * i / F.col("k")
    place = lambda t: (t - F.col("start_time")) * F.col("k") / (F.col("end_time") - F.col("start_time"))
    # Targets from this frame's time up to the next one's; the first and the last also have all before and behind them.
    earliest = F.col("here.time_sec") == F.col("lowest")
    low = F.when(earliest, 1).otherwise(F.greatest(F.lit(1), F.floor(place(F.col("here.time_sec"))).cast("int") - 1))
    high = F.coalesce(F.least(F.col("k") - 1, F.ceil(place(F.col("after.time_sec"))).cast("int") + 1), F.col("k") - 1)
    own = F.filter(F.sequence(low, high), lambda i: (earliest | (target(i) >= F.col("here.time_sec"))) & (F.col("after").isNull() | (target(i) < F.col("after.time_sec"))))
    far = lambda x, i: F.struct(F.abs(x["time_sec"] - target(i)).alias("far"), (-x["boundary_score"]).alias("less"), x["ord"].alias("ord"))
    nearest = lambda i: F.least(far(F.col("here"), i), F.when(F.col("after").isNotNull(), far(F.col("after"), i)))["ord"]
    taken = F.when(F.col("here").isNotNull() & (low <= high), F.transform(own, lambda i: nearest(i).cast("long")))
    share = lambda i: F.least(F.col("end_ord") - 1, F.greatest(F.col("start_ord") + 1, F.rint(F.col("start_ord") + (F.col("end_ord") - F.col("start_ord")) * i / F.col("k")).cast("long"))).cast("long")
    plain = F.when((F.col("ord") == F.col("start_ord")) & (F.col("k") > 1) & F.col("lowest").isNull(), F.transform(F.sequence(F.lit(1), F.col("k") - 1), share))
    inside = F.filter(F.coalesce(taken, plain), lambda x: (x > F.col("start_ord")) & (x < F.col("end_ord")))
    begin = F.when(F.col("ord") == F.col("start_ord"), F.array(F.col("start_ord").cast("long")))
    none = F.array().cast("array<long>")
    every = rows.select("job_id", "segment", "end_ord", F.explode(F.concat(F.coalesce(inside, none), F.coalesce(begin, none))).alias("cut"))
    return every.groupBy("job_id", "segment", "cut").agg(F.first("end_ord").alias("end_ord"))


def parts_of(edges: DataFrame) -> DataFrame:
    """job_id, segment, part, start_ord, end_ord, forced from the cuts of spans."""
    w = Window.partitionBy("job_id", "segment").orderBy("cut")
    return edges.select(
        "job_id", "segment", F.row_number().over(w).alias("part"), F.col("cut").alias("start_ord"), F.coalesce(F.lead("cut").over(w), F.col("end_ord")).alias("end_ord"),
        (F.count(F.lit(1)).over(Window.partitionBy("job_id", "segment")) > 1).alias("forced"),
    )


def split_long(spans: DataFrame, frames: DataFrame, longest: float = 30.0) -> DataFrame:
    """job_id, segment, part, start_ord, end_ord, forced: spans cut where they last longer than ``longest``, see ``cuts``."""
    return parts_of(cuts(located(frames.select("job_id", "ord", "time_sec", "boundary_score"), spans, ("segment", "start_time", "end_time")), longest))


def top_spans(parts: DataFrame, frames: DataFrame, most: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first span and the ``most`` - 1 with the highest score at their start, numbered in order; holes stay."""
    scored = parts.join(frames.select("job_id", F.col("ord").alias("start_ord"), F.col("boundary_score").alias("start_score")), ["job_id", "start_ord"])
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy((F.col("start_ord") != 0).cast("int"), F.desc("start_score"), "start_ord"))
    kept = scored.withColumn("rank", rank).where(F.col("rank") <= most)
    return kept.select("job_id", F.row_number().over(in_order("start_ord")).alias("event_id"), "start_ord", "end_ord", "start_score", "forced", *keep)


def stable_frames(parts: DataFrame, frames: DataFrame) -> DataFrame:
    """job_id, start_ord, stable_ord: of each span the frame that changes least: the lowest visual score, then the highest
    diff_score where there is one (the change seen when it was taken), then the earliest."""
    change = F.coalesce(F.col("diff_score"), F.lit(0.0)) if "diff_score" in frames.columns else F.lit(0.0)
    inside = located(frames.select("job_id", "ord", "visual_score", change.alias("change")), parts, ())
    return inside.groupBy("job_id", "start_ord").agg(F.min_by("ord", steadiness()).alias("stable_ord"))


def steadiness() -> Column:
    """The steadiest frame of a span is the least by this."""
    return F.struct("visual_score", -F.col("change"), "ord")
