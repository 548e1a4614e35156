"""The whole plan from frames to labelled segments: boundaries, spans, evidence text, states, scroll collapse."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.score import segment_score
from tracewright.functions.text import clean_lines, hint_of
from tracewright.operators import boundaries, evidence, screens
from tracewright.operators.ordered import each_row, in_order, run_id
from tracewright.sources import recordings

TELLING = ["filter", "export", "data entry", "post/save"]
ROLES = {"stable_frame": "stable", "entry_frame": "entry", "after_frame": "after"}


def by_role(role: Column, field: str) -> Column:
    """A field of the frame that a segment's role names."""
    return F.coalesce(*[F.when(role == name, F.col(f"{at}.{field}")) for name, at in ROLES.items()])


def initial_segments(frames: DataFrame, most: int = 36, longest: float = 30.0, starts: DataFrame | None = None) -> DataFrame:
    """job_id, event_id, start_ord, end_ord, start_time, end_time, frame_count, forced, closing (the score of the boundary that
    ends it), and of its stable and entry frame and the frame after it ord, time_sec, hash, ocr_text and structure.

    Frames: job_id, ord, time_sec, boundary_score, visual_score, ocr_text, hash, and diff_score and structure where known.
    ``starts``: their ``boundary_starts`` for ``most``, if these are known already.
    All is windows and aggregates by job; the frames are laid beside their parts once, no self join."""
    known = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in frames.columns else F.lit(0.0) for c in ("diff_score", "structure")}
    frames = frames.select("job_id", "ord", "time_sec", "boundary_score", "visual_score", "ocr_text", "hash", known["diff_score"].alias("change"), known["structure"].alias("structure"))
    starts = (boundaries.boundary_starts(frames, most) if starts is None else starts).select("job_id", F.transform("starts", lambda x: x["ord"]).alias("starts"))
    so_far = in_order().rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(F.array_contains("starts", F.col("ord")), F.lit(False))
    spans = frames.select("job_id", "ord", "time_sec", "boundary_score").join(starts, "job_id", "left").withColumn("segment", F.sum(begins.cast("int")).over(so_far) + 1)
    span = Window.partitionBy("job_id", "segment")
    ends = {"start_ord": F.min("ord").over(span), "end_ord": F.max("ord").over(span) + 1, "start_time": F.min("time_sec").over(span), "end_time": F.max("time_sec").over(span)}
    spans = spans.drop("starts").withColumns(ends)
    parts = boundaries.parts_of(boundaries.cuts(spans, longest))

    shown = F.struct("ord", "time_sec", "hash", "ocr_text", "structure")
    rows = boundaries.located(frames, parts, ("segment", "part", "forced")).groupBy("job_id", "start_ord").agg(
        *[F.first(c).alias(c) for c in ("end_ord", "part", "forced")], F.count(F.lit(1)).alias("frame_count"), F.min_by("time_sec", "ord").alias("start_time"), F.max_by("time_sec", "ord").alias("end_time"),
        F.min_by("boundary_score", "ord").alias("start_score"), F.min_by(shown, boundaries.steadiness()).alias("stable"), F.min_by(shown, "ord").alias("entry"),
    )
    w = in_order("start_ord")
    behind = Window.partitionBy("job_id").orderBy(F.desc("start_ord")).rowsBetween(Window.unboundedPreceding, -1)
    closing = F.last(F.when(F.col("part") == 1, F.col("start_score")), ignorenulls=True).over(behind)
    rows = rows.withColumns({"after": F.coalesce(F.lead("entry").over(w), F.col("stable")), "closing": F.coalesce(closing, F.lit(0.0))})
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy((F.col("start_ord") != 0).cast("int"), F.desc("start_score"), "start_ord"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("event_id", F.row_number().over(w)).drop("rank", "part", "start_score")


def with_evidence(segments: DataFrame, most_read: int, told: Callable[..., DataFrame] = each_row) -> DataFrame:
    """Segments with what is read of them: ocr_text of the frames that ``evidence.picks`` takes, cleaned, stable, entry and
    after frame in that order, and evidence (role, score, strength, structure, reason) with evidence_ord, the best of them.

    A frame is read for one segment only, so the frame after a segment tells of it only if it isn't the next one's stable
    frame. At most ``most_read`` frames of a job are read. ``told``: how their texts are cleaned, see ``ordered.by_value``."""
    path = lambda at: F.lpad(F.col(f"{at}.ord").cast("string"), 12, "0")
    chosen = segments.select("job_id", F.col("event_id").alias("segment"), *[path(at).alias(name) for name, at in ROLES.items()], F.col("stable.hash").alias("image_hash"), F.col("closing").alias("boundary_score"), "forced")
    rows, text_of_role = segments, lambda role: clean_lines(by_role(role, "ocr_text"))
    if told is not each_row:
        shown = reduce(DataFrame.unionByName, [segments.select(F.col(f"{at}.ocr_text").alias("text")) for at in ROLES.values()])
        for at in ROLES.values():
            rows = told(rows.withColumn("text", F.col(f"{at}.ocr_text")), ["text"], lambda x: x.withColumn("clean", clean_lines(F.col("text"))), shown).withColumnRenamed("clean", f"clean_{at}").drop("text")
        text_of_role = lambda role: F.coalesce(*[F.when(role == name, F.col(f"clean_{at}")) for name, at in ROLES.items()])
    rows = rows.join(evidence.picks(chosen, most_read), "job_id", "left")
    mine = F.filter("state", lambda x: x["segment"] == F.col("event_id"))
    read = F.transform(mine, lambda x, i: F.struct(i.alias("pos"), x["role"].alias("role"), text_of_role(x["role"]).alias("text"), by_role(x["role"], "structure").alias("structure")))
    rows = rows.withColumn("read", F.coalesce(read, F.array().cast("array<struct<pos:int,role:string,text:string,structure:double>>")))
    text = F.array_join(F.filter(F.col("read.text"), lambda x: x != ""), "\n")
    rows = rows.withColumns({"ocr_text": text, "evidence": evidence.best_role(F.col("read"))})
    return rows.withColumn("evidence_ord", by_role(F.col("evidence.role"), "ord")).drop("read", "state", *[f"clean_{at}" for at in ROLES.values()])


def reviewed(segments: DataFrame, decisions: DataFrame, most: int) -> DataFrame:
    """Segments renumbered, those merged into the one before of which ``decisions`` (job_id, event_id, decision) says so.

    Only the ``most`` boundaries of a job that are hardest to tell may be decided. What is merged adds its end and its
    frames; all else is the first one's."""
    asked = evidence.ambiguous(segments.where("event_id > 1").select("job_id", F.col("event_id").alias("ord"), "boundary_score"), most)
    merge = decisions.where("decision = 'merge'").join(asked.select("job_id", F.col("ord").alias("event_id")), ["job_id", "event_id"]).select("job_id", "event_id").distinct()
    rows = segments.join(merge.withColumn("merge", F.lit(True)), ["job_id", "event_id"], "left")
    rows = rows.withColumn("run", run_id(F.col("merge").isNull(), "event_id"))
    kept = [c for c in segments.columns if c not in ("job_id", "event_id", "end_time", "frame_count")]
    out = rows.groupBy("job_id", "run").agg(F.min_by(F.struct(*kept), "event_id").alias("x"), F.max_by("end_time", "event_id").alias("end_time"), F.sum("frame_count").cast("int").alias("frame_count"))
    return out.select("job_id", F.col("run").cast("int").alias("event_id"), "x.*", "end_time", "frame_count").select(segments.columns)


def segments_of(frames: DataFrame, most: int = 36, longest: float = 30.0, most_read: int = 30, decisions: DataFrame | None = None, most_reviews: int = 8) -> DataFrame:
    """Segments of frames as ``initial_segments`` wants them; with ``decisions``, of up to ``most_reviews`` boundaries of a job, ``reviewed``.

    job_id, event_id, ord (of the stable frame), start_time, end_time, frame_count, ocr_text, system, screen_state_id,
    boundary_score, dense_repeated_run. A segment's score weighs the score of the boundary that closes it, change of text
    and system, and whether its text names an action. States are told before systems are smoothed, scrolling is judged after."""
    return labelled_segments(initial_segments(frames, most, longest), most_read, decisions, most_reviews)


def labelled_segments(segments: DataFrame, most_read: int = 30, decisions: DataFrame | None = None, most_reviews: int = 8, told: Callable[..., DataFrame] = each_row) -> DataFrame:
    """``segments_of`` of segments as ``initial_segments`` gives them. These are read twice, so they should be a table."""
    rows = with_evidence(segments, most_read, told)
    rows = rows.select("job_id", F.col("stable.ord").alias("ord"), F.col("stable.time_sec").alias("time_sec"), F.col("stable.hash").alias("hash"), "start_time", "end_time", "frame_count", "ocr_text", F.col("closing").alias("visual_score"))
    rows = screens.with_deltas(screens.labelled(rows))
    action = F.when(hint_of(F.col("ocr_text")).isin(TELLING), 1.0).otherwise(0.3)
    rows = rows.withColumn("boundary_score", F.round(segment_score(F.col("visual_score"), F.col("text_delta"), F.col("system_delta"), action), 4))
    rows = screens.screen_states(rows, keep=("time_sec", "start_time", "end_time", "frame_count", "system", "ocr_text", "visual_score", "boundary_score"))
    rows = screens.scroll_collapse(screens.smooth_systems(rows))
    return screens.repeated_runs(rows if decisions is None else reviewed(rows, decisions, most_reviews), "screen_state_id")


def job_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = recordings.screens(spark, sf_dir)
    return segments_of(frames.withColumn("hash", F.lpad(F.lower(F.hex(F.col("k") % 5 * 1023)), 16, "0")))
