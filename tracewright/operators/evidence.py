"""Choosing what to keep as evidence: frames, events, roles, and boundaries to look at again.

Choices that depend on earlier choices are folds over one job's rows; the rest are windows and joins.
Null text counts as empty; null hashes are 64 bits from any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.functions.text import bits_apart, contains_any, event_signature, hash_bits, hash_distance, hint_of, jaccard, text_of, text_strength, tokens
from tracewright.operators.ordered import fold, in_order, run_id


def strided(rows: DataFrame, most: int) -> DataFrame:
    """Every so many-th row of each job, ``most`` in all; the job's last row always takes the last place."""
    n, i = F.count(F.lit(1)).over(Window.partitionBy("job_id")), F.row_number().over(in_order()) - 1
    rows = rows.withColumns({"__n": n, "__i": i})
    stride = F.floor(F.col("__n") / most).cast("int")
    taken = (F.col("__i") % F.greatest(F.lit(1), stride) == 0) & (F.col("__i") < stride * (most - 1))
    return rows.where((F.col("__n") <= most) | taken | (F.col("__i") == F.col("__n") - 1)).drop("__n", "__i")


def ambiguous(candidates: DataFrame, most: int, around: float = 0.16) -> DataFrame:
    """job_id, ord, distance: the ``most`` boundaries of each job whose scores are nearest to ``around``."""
    rows = candidates.withColumn("distance", F.round(F.abs(F.col("boundary_score") - around), 6))
    rank = F.row_number().over(in_order("distance", "ord"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("job_id", "ord", "distance")


def apply_merges(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Segments (job_id, segment, start_ord, end_ord, start_time, end_time, frame_count) with those put into the one
    before that ``decisions`` (job_id, segment, decision) merges. A first segment has none before."""
    merge = decisions.where("decision = 'merge'").select("job_id", "segment").distinct().withColumn("__merge", F.lit(True))
    rows = segments.join(merge, ["job_id", "segment"], "left")
    starts = F.col("__merge").isNull() | (F.row_number().over(in_order("segment")) == 1)
    rows = rows.withColumn("starts", starts).withColumn("event_id", run_id(F.col("starts"), "segment"))
    return rows.groupBy("job_id", "event_id").agg(
        F.min("start_ord").alias("start_ord"), F.max("end_ord").alias("end_ord"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("frame_count").alias("frame_count"), (F.count(F.lit(1)) - 1).alias("merged"),
    )


def texts_by_role(segments: DataFrame, read: DataFrame) -> DataFrame:
    """Segments with the texts read for them as a map by role; of two for one role the first (by pos); empty where none was read."""
    first = read.groupBy("job_id", "segment", "role").agg(F.min_by("text", "pos").alias("text"))
    by = first.groupBy("job_id", "segment").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", text_of(F.col("text")).alias("text"))))).alias("texts"))
    return segments.join(by, ["job_id", "segment"], "left").withColumn("texts", F.coalesce("texts", F.create_map().cast("map<string,string>")))


#: Why a role was chosen, where it had text, where it showed a dialog, and else.
REASONS = ("had the strongest OCR and structure evidence", "best exposed the visible dialog or configuration area", "showed the richest visible screen structure")


def best_role(read: Column) -> Column:
    """(role, score, strength, structure, reason) of the best of an array of (pos, role, text, structure); of equals the first by pos.

    Of an empty or null array the stable frame, without score."""

    def scored(x: Column) -> Column:
        text, strength, seen = text_of(x["text"]), text_strength(x["text"]), F.coalesce(x["structure"], F.lit(0.0))
        dialog = contains_any(F.lower(text), rules.DIALOG_TERMS)
        bonus = F.when(x["role"].isin("entry_frame", "after_frame"), 0.08).otherwise(0.03) + F.when(dialog, 0.12).otherwise(0.0)
        score = F.round(F.when(strength == 0, 0.7 * seen).otherwise(0.6 * strength + 0.3 * seen) + bonus, 9)
        why = F.when(strength > 0, REASONS[0]).when(dialog, REASONS[1]).otherwise(REASONS[2])
        return F.struct(score.alias("score"), (-x["pos"]).alias("back"), x["role"].alias("role"), F.round(strength, 3).alias("strength"), F.round(seen, 3).alias("structure"), F.concat_ws(" ", x["role"], why).alias("reason"))

    best = F.array_max(F.transform(read, scored))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit("stable_frame").alias("role"), F.lit(0.0).alias("strength"), F.lit(0.0).alias("structure"), F.lit("default stable frame").alias("reason"))
    best = F.coalesce(best, none)
    return F.struct(best["role"].alias("role"), F.round(best["score"], 6).alias("score"), best["strength"].alias("strength"), best["structure"].alias("structure"), best["reason"].alias("reason"))


def role_scores(read: DataFrame) -> DataFrame:
    """job_id, segment, role, score, strength, structure, reason: ``best_role`` of the texts read for each segment.

    ``read``: job_id, segment, pos, role, text, structure (0 to 1, of the image)."""
    by = read.groupBy("job_id", "segment").agg(F.collect_list(F.struct("pos", "role", "text", "structure")).alias("read"))
    return by.select("job_id", "segment", best_role(F.col("read")).alias("x")).select("job_id", "segment", "x.*")


def pick_evidence(segments: DataFrame, most: int) -> DataFrame:
    """job_id, event_id, segment, role, path: frames to read, stable ones of all segments first, then entry and after.

    A path is taken once. A segment whose hash is within 2 bits of one already taken gives none if its boundary is
    under 0.02 and it wasn't a forced split. Rows: job_id, segment, stable_frame, entry_frame, after_frame,
    image_hash, boundary_score, forced; a null path is a file that isn't there."""
    got = picks(segments, most)
    return got.select("job_id", F.posexplode("state").alias("at", "x")).select("job_id", (F.col("at") + 1).alias("event_id"), "x.segment", "x.role", "x.path")


def picks(segments: DataFrame, most: int) -> DataFrame:
    """job_id, state: what ``pick_evidence`` takes, an array (segment, role, path, bits of the hash) for each job."""
    frames = F.array(*[F.struct(F.lit(go).alias("go"), "segment", F.lit(i).alias("i"), F.lit(role).alias("role"), F.col(role).alias("path")) for i, (go, role) in enumerate([(1, "stable_frame"), (2, "entry_frame"), (2, "after_frame")])])
    rows = segments.select("job_id", hash_bits(F.col("image_hash")).alias("bits"), F.coalesce("boundary_score", F.lit(0.0)).alias("score"), F.coalesce("forced", F.lit(False)).alias("forced"), F.explode(frames).alias("x")).select("job_id", "bits", "score", "forced", "x.*").where("path is not null")

    def step(kept, x):
        known = F.exists(kept, lambda k: k["path"] == x["path"])
        weak = (x["score"] < 0.02) & ~x["forced"] & F.exists(kept, lambda k: bits_apart(k["bits"], x["bits"]) <= 2)
        entry = F.struct(x["segment"].cast("int").alias("segment"), x["role"].alias("role"), x["path"].alias("path"), x["bits"].alias("bits"))
        return F.when((F.size(kept) >= most) | known | weak, kept).otherwise(F.array_append(kept, entry))

    start = F.array().cast("array<struct<segment:int,role:string,path:string,bits:bigint>>")
    return fold(rows, ["role", "path", "bits", "score", "forced"], ["go", "segment", "i"], start, step)


def with_context(events: DataFrame) -> DataFrame:
    """Events renumbered in order, with the times of the neighbours (their own at the ends) and an action hint."""
    w = in_order()
    side = lambda f: F.coalesce(f("time_sec").over(w), F.col("time_sec"))
    number = F.row_number().over(w)
    return events.withColumns({"start_time": side(F.lag), "end_time": side(F.lead), "event_id": number, "action_hint": hint_of(F.col("text"))})


def cluster_events(events: DataFrame, most: int = 60) -> DataFrame:
    """Events (job_id, ord, time_sec, system, text, diff_score) without those like the last kept one, in context.

    Like: one system, and a token overlap over 0.82 or little change without text. A longer text replaces the kept
    row. Beyond ``most`` the first, the last and the greatest changes stay."""
    row = "struct<ord:int,time_sec:double,system:string,text:string,diff_score:double>"

    def step(kept, x):
        last = F.try_element_at(kept, F.lit(-1))
        like = (x["system"] == last["system"]) & ((jaccard(tokens(x["text"]), tokens(last["text"]), 0.0) > 0.82) | ((x["diff_score"] < 0.025) & (x["text"] == "")))
        entry = F.struct(*[x[c].alias(c) for c in ("ord", "time_sec", "system", "text", "diff_score")]).cast(row)
        replaced = F.array_append(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), entry)
        longer = F.length(x["text"]) > F.length(last["text"])
        return F.when(~F.coalesce(like, F.lit(False)), F.array_append(kept, entry)).when(longer, replaced).otherwise(kept)

    rows = events.withColumn("text", text_of(F.col("text")))
    got = fold(rows, ["ord", "time_sec", "system", "text", "diff_score"], ["ord"], F.array().cast(f"array<{row}>"), step)
    got = got.select("job_id", F.explode("state").alias("x")).select("job_id", "x.*")
    w = Window.partitionBy("job_id")
    n, ends = F.count(F.lit(1)).over(w), (F.col("ord") == F.min("ord").over(w)) | (F.col("ord") == F.max("ord").over(w))
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("diff_score"), "ord"))
    got = got.withColumn("__stays", (n <= most) | ends | (rank <= most - 2)).where("__stays").drop("__stays")
    return with_context(got)


def event_score(text: Column, system: Column, hint: Column, diff: Column, moved: Column) -> Column:
    """How much an event tells: business terms, change, a known system, text, a change of system, a telling hint."""
    low = F.lower(text)
    terms = sum((low.contains(t).cast("int") for t in rules.BUSINESS_TERMS), F.lit(0))
    return (
        terms + F.least(F.lit(4.0), diff * 60) + F.when(system != "Other", 1.0).otherwise(0.0) + F.least(F.lit(3.0), F.length(text) / 180)
        + F.when(moved, 2.0).otherwise(0.0) + F.when(hint.isin("filter", "export", "data entry", "post/save"), 1.5).otherwise(0.0)
    )


def prune_events(events: DataFrame, most: int = 40) -> DataFrame:
    """The events (job_id, ord, time_sec, system, text, diff_score) that tell most, in order and in context.

    Of equal (system, text) the first counts. Toolbars (few tokens, no business term, no known system) go unless
    they begin or end the job, and so does mere scrolling against the last scored event. Beyond ``most`` the job's
    first and last event stay, if scored, and the highest scores, of equals the earlier."""
    w = Window.partitionBy("job_id")
    rows = events.withColumns({"text": text_of(F.col("text")), "end": (F.col("ord") == F.min("ord").over(w)) | (F.col("ord") == F.max("ord").over(w))})
    rows = rows.withColumns({"n_ends": F.when(F.min("ord").over(w) == F.max("ord").over(w), 1).otherwise(2), "signature": event_signature(F.col("system"), F.col("text"))})
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("job_id", "signature").orderBy("ord"))).where("nth = 1")
    terms = sum((F.lower("text").contains(t).cast("int") for t in rules.BUSINESS_TERMS), F.lit(0))
    rows = rows.where(F.col("end") | ~((F.size(tokens(F.col("text"))) <= 4) & (terms == 0) & (F.col("system") == "Other")))
    rows = rows.withColumn("hint", hint_of(F.col("text")))
    row = "struct<ord:int,time_sec:double,system:string,text:string,end:boolean,n_ends:int,score:double>"

    def step(kept, x):
        last = F.try_element_at(kept, F.lit(-1))
        scroll = (x["diff_score"] < 0.018) & (jaccard(tokens(x["text"]), tokens(last["text"]), 0.0) > 0.7) & (x["system"] == last["system"])
        moved = F.coalesce(x["system"] != last["system"], F.lit(False))
        score = F.round(event_score(x["text"], x["system"], x["hint"], x["diff_score"], moved), 6)
        entry = F.struct(*[x[c].alias(c) for c in ("ord", "time_sec", "system", "text", "end", "n_ends")], score.alias("score")).cast(row)
        return F.when(F.coalesce(scroll, F.lit(False)), kept).otherwise(F.array_append(kept, entry))

    got = fold(rows, ["ord", "time_sec", "system", "text", "end", "n_ends", "diff_score", "hint"], ["ord"], F.array().cast(f"array<{row}>"), step)
    got = got.select("job_id", F.explode("state").alias("x")).select("job_id", "x.*")
    rank = F.row_number().over(Window.partitionBy("job_id", "end").orderBy(F.desc("score"), "ord"))
    keep = (F.count(F.lit(1)).over(w) <= most) | F.col("end") | (rank <= most - F.col("n_ends"))
    return with_context(got.withColumn("__keep", keep).where("__keep").drop("__keep", "end", "n_ends"))


def representative_frames(frames: DataFrame, most: int = 80, even: float = 0.4, gap: float = 8.0) -> DataFrame:
    """job_id, ord, reason: frames spread over each job, then those that change most, then whatever fills the rest.

    Jobs of up to ``most`` frames keep all. Otherwise first and last are taken, and then, in turn, even strides,
    changes of 0.01 or more, and all frames at half the gap, each only if it is ``gap`` away in time and over 4
    bits of hash from all taken before. Rows: job_id, ord, time_sec, diff_score, image_hash."""
    w = Window.partitionBy("job_id")
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / max(1, int(most * even)))).cast("int")
    rows = frames.withColumns({"n": F.count(F.lit(1)).over(w), "i": F.row_number().over(in_order()) - 1})
    few = rows.where(F.col("n") <= most).select("job_id", "ord", F.lit("all").alias("reason"))
    many = rows.where(F.col("n") > most)
    i, own = F.col("i"), lambda turn, key, wide, name, force: F.struct(F.lit(turn).alias("turn"), key.alias("key"), F.lit(wide).alias("wide"), F.lit(name).alias("reason"), F.lit(force).alias("force"))
    zero, at = F.lit(0.0), F.col("i").cast("double")
    offers = F.array_compact(F.array(
        F.when(i == 0, own(0, zero, 0.0, "first", True)), F.when(i == F.col("n") - 1, own(1, zero, 0.0, "last", True)), F.when(i % stride == 0, own(2, at, gap, "even", False)),
        F.when(F.col("diff_score") >= 0.01, own(3, -F.col("diff_score"), gap, "change", False)), own(4, at, max(2.0, gap / 2), "fill", False)))
    many = many.select("job_id", "ord", "time_sec", F.coalesce("image_hash", F.lit("")).alias("hash"), F.explode(offers).alias("o")).select("job_id", "ord", "time_sec", "hash", "o.*")

    def step(kept, x):
        clash = F.exists(kept, lambda k: (k["ord"] == x["ord"]) | (~x["force"] & ((F.abs(k["time_sec"] - x["time_sec"]) < x["wide"]) | (hash_distance(k["hash"], x["hash"]) <= 4))))
        entry = F.struct(x["ord"].cast("int").alias("ord"), x["time_sec"].alias("time_sec"), x["hash"].alias("hash"), x["reason"].alias("reason"))
        return F.when(clash | (F.size(kept) >= most), kept).otherwise(F.array_append(kept, entry))

    start = F.array().cast("array<struct<ord:int,time_sec:double,hash:string,reason:string>>")
    got = fold(many, ["time_sec", "hash", "wide", "reason", "force"], ["turn", "key", "ord"], start, step)
    return few.unionByName(got.select("job_id", F.explode("state").alias("x")).select("job_id", "x.ord", "x.reason"))
