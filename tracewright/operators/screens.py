"""Labelled screens: continuity, runs, recurring states, scroll collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import bits_apart, contains_any, hash_bits, jaccard, system_of, text_of, tokens
from tracewright.functions import rules
from tracewright.operators.ordered import bound, fold, in_order


def labelled(screens: DataFrame) -> DataFrame:
    return screens.withColumn("system", system_of(F.col("ocr_text")))


def smooth_systems(screens: DataFrame) -> DataFrame:
    """A textless Other between two rows of one other system takes that system."""
    w = in_order()
    left, right = F.lag("system").over(w), F.lead("system").over(w)
    heir = (F.col("system") == "Other") & (F.trim("ocr_text") == "") & (left == right) & (left != "Other")
    return screens.withColumn("inherited", F.coalesce(heir, F.lit(False))).withColumn("system", F.when(F.col("inherited"), left).otherwise(F.col("system")))


def text_deltas(screens: DataFrame) -> DataFrame:
    """job_id, ord, text_delta, system_delta of each row."""
    return with_deltas(screens).select("job_id", "ord", "text_delta", "system_delta")


def with_deltas(screens: DataFrame) -> DataFrame:
    """Adds text_delta (1 - token Jaccard to the previous row) and system_delta."""
    w = in_order()
    screens = screens.withColumn("__tok", tokens(F.col("ocr_text")))
    before = F.coalesce(F.lag("__tok").over(w), F.array().cast("array<string>"))
    changed = (F.lag("system").over(w) != "Other") & (F.lag("system").over(w) != F.col("system"))
    rows = screens.withColumns({"before": before, "system_delta": F.coalesce(changed.cast("int"), F.lit(0))})
    return rows.withColumn("text_delta", F.round(1 - jaccard(F.col("before"), F.col("__tok"), 1.0), 6)).drop("before", "__tok")


def repeated_runs(rows: DataFrame, state: str) -> DataFrame:
    """Adds dense_repeated_run: the state equals a neighbour's."""
    w = in_order()
    same = (F.col(state) == F.lag(state).over(w)) | (F.col(state) == F.lead(state).over(w))
    return rows.withColumn("dense_repeated_run", F.coalesce(same, F.lit(False)))


def screen_states(screens: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """job_id, ord, screen_state_id and the columns to keep: leader clustering in order.

    A row joins the first state of its system whose hash is within 8 bits or whose tokens overlap by more than
    0.72; an Other row without text and with a boundary over 0.02 joins none without text. Leaders don't change."""
    kind = "struct<states:array<struct<system:string,bits:bigint,tok:array<string>,blank:boolean>>,out:array<int>>"

    def step(s, x):
        fit = lambda st: (st["system"] == x["system"]) & ~(st["blank"] & x["blank"] & (x["system"] == "Other") & (x["boundary_score"] > 0.02)) & (
            (bits_apart(st["bits"], x["bits"]) <= 8) | (jaccard(st["tok"], x["tok"], 0.0) > 0.72))
        found = F.array_position(F.transform(s["states"], lambda st: F.coalesce(fit(st), F.lit(False))), True).cast("int")
        new = F.array_append(s["states"], F.struct(x["system"].alias("system"), x["bits"].alias("bits"), x["tok"].alias("tok"), x["blank"].alias("blank")))
        number = lambda at: F.when(at > 0, at).otherwise(F.size(s["states"]) + 1)
        return bound(found, lambda at: F.struct(F.when(at > 0, s["states"]).otherwise(new).alias("states"), F.array_append(s["out"], number(at)).alias("out")))

    start = F.struct(F.array().cast("array<struct<system:string,bits:bigint,tok:array<string>,blank:boolean>>").alias("states"), F.array().cast("array<int>").alias("out")).cast(kind)
    rows = screens.withColumns({"tok": tokens(F.col("ocr_text")), "blank": F.trim(text_of(F.col("ocr_text"))) == "", "bits": hash_bits(F.col("hash"))})
    got = fold(rows, ["ord", "system", "bits", "tok", "blank", "boundary_score", *keep], ["ord"], start, step)
    both = got.select("job_id", F.explode(F.arrays_zip("rows", F.col("state.out").alias("id"))).alias("x"))
    return both.select("job_id", *[f"x.rows.{c}" for c in dict.fromkeys(["ord", *keep])], F.col("x.id").alias("screen_state_id"))


def scroll_collapse(screens: DataFrame) -> DataFrame:
    """job_id, event_id, ord, start_time, end_time, frame_count, ocr_text, system, screen_state_id, boundary_score: rows that only
    scroll are merged into the last kept row.

    end_time and frame_count are those of all rows merged; without such columns a row is one frame at its time.
    With text on both: same system and state, Jaccard over 0.70, boundary under 0.12, visual under 0.01 and no
    operational term. Otherwise: same system and state, visual under 0.01. The longer text is kept."""
    for name, of in (("start_time", F.col("time_sec")), ("end_time", F.col("time_sec")), ("frame_count", F.lit(1))):
        screens = screens if name in screens.columns else screens.withColumn(name, of)
    screens = screens.withColumn("frame_count", F.col("frame_count").cast("int"))
    row = "struct<ord:int,start:double,time_sec:double,system:string,state:int,text:string,n:int,score:double>"

    def step(kept, x):
        last = F.try_element_at(kept, F.lit(-1))
        both = (F.trim(x["ocr_text"]) != "") & (F.trim(last["text"]) != "")
        same = (last["system"] == x["system"]) & (last["state"] == x["screen_state_id"]) & (x["visual_score"] < 0.01)
        words = F.lower(F.concat_ws(" ", x["ocr_text"], last["text"]))
        still = (jaccard(tokens(x["ocr_text"]), tokens(last["text"]), 1.0) > 0.70) & (x["boundary_score"] < 0.12) & ~contains_any(words, rules.OPERATIONAL_TERMS)
        merge = (F.size(kept) > 0) & same & F.when(both, still).otherwise(F.lit(True))
        text = F.when(F.length(x["ocr_text"]) > F.length(last["text"]), x["ocr_text"]).otherwise(last["text"])
        entry = lambda o, begin, t, n, score: F.struct(o.alias("ord"), begin.alias("start"), x["end_time"].alias("time_sec"), x["system"].alias("system"), x["screen_state_id"].alias("state"), t.alias("text"), n.alias("n"), score.alias("score"))
        merged = F.array_append(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), entry(last["ord"], last["start"], text, last["n"] + x["frame_count"], last["score"]))
        return F.when(F.coalesce(merge, F.lit(False)), merged).otherwise(F.array_append(kept, entry(x["ord"], x["start_time"], x["ocr_text"], x["frame_count"], x["boundary_score"])))

    got = fold(screens, ["ord", "start_time", "end_time", "frame_count", "system", "screen_state_id", "ocr_text", "visual_score", "boundary_score"], ["ord"], F.array().cast(f"array<{row}>"), step)
    return got.select("job_id", F.posexplode("state").alias("i", "x")).select("job_id", (F.col("i") + 1).alias("event_id"), "x.ord", F.col("x.start").alias("start_time"), F.col("x.time_sec").alias("end_time"), F.col("x.n").alias("frame_count"), F.col("x.text").alias("ocr_text"), "x.system", F.col("x.state").alias("screen_state_id"), F.col("x.score").alias("boundary_score"))
