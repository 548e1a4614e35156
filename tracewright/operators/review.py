"""Generated steps and their review: defaults, audit flags, the verification budget, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.functions.text import contains_any, generic_review, redacted, text_of, word_norm
from tracewright.operators.ordered import in_order, run_id
from tracewright.operators.steps import known, local_steps, operates, signature

# What speaks for an operation that a generic review of an Excel screen has missed.
OPERATION_HINTS = ["data entry", "filter", "post/save"]
OPERATION_TERMS, PIVOT_TERMS = rules.OPERATION_TERMS, rules.PIVOT_TERMS
OPERATION_SCORE = 0.18
LONG_SECONDS = 45
CONFIDENCES = ["high", "medium", "low"]


def said(c: str):
    """A column's text without blanks around; null if there is none."""
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def called(events: DataFrame, batch: int, max_calls: int) -> DataFrame:
    """job_id, event_id, call of the events that a model is asked about: ``batch`` in a call, ``max_calls`` calls for a job at most."""
    call = F.floor((F.row_number().over(in_order("event_id")) - 1) / batch).cast("int") + 1
    return events.select("job_id", "event_id", call.alias("call")).where(F.col("call") <= max_calls)


def calls_made(events: DataFrame, items: DataFrame, batch: int, max_calls: int) -> DataFrame:
    """job_id, attempted, succeeded: the calls within the budget, and those that an item came of."""
    asked = called(events, batch, max_calls)
    answered = asked.join(items.select("job_id", "event_id").distinct().withColumn("answered", F.lit(True)), ["job_id", "event_id"], "left")
    by = answered.groupBy("job_id", "call").agg(F.bool_or(F.coalesce("answered", F.lit(False))).alias("answered"))
    return by.groupBy("job_id").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("answered").alias("succeeded"))


def generated(events: DataFrame, items: DataFrame | None, batch: int | None = None, max_calls: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One step per event: the model's item for it where there is one, else the local writer's; blank fields likewise.

    ``events`` as for ``local_steps``; ``items`` (None: no model was asked): job_id, event_id, pos, system, action, expected_output,
    confidence, of which the last by pos counts. With ``batch`` and ``max_calls`` only those ``called`` for count. ``keep``: the
    events' columns that go along."""
    own = local_steps(events, (F.col("system").alias("seen"), *keep))
    if items is None:
        seen = F.coalesce(F.nullif(F.col("seen"), F.lit("")), F.lit("Other")).alias("system")
        return own.select("job_id", "event_id", seen, "action", "expected_output", "confidence", "generation_source", *keep)
    if batch is not None and max_calls is not None:
        items = items.join(called(events, batch, max_calls).drop("call"), ["job_id", "event_id"], "left_semi")
    last = items.groupBy("job_id", "event_id").agg(F.max_by(F.struct("system", "action", "expected_output", "confidence"), "pos").alias("i"))
    rows = own.join(last, ["job_id", "event_id"], "left")
    sure = F.lower("i.confidence")
    return rows.select(
        "job_id", "event_id", F.coalesce(F.nullif(F.col("i.system"), F.lit("")), F.nullif(F.col("seen"), F.lit("")), F.lit("Other")).alias("system"),
        F.coalesce(said("i.action"), "action").alias("action"), F.coalesce(said("i.expected_output"), "expected_output").alias("expected_output"),
        F.when(F.col("i").isNull(), F.col("confidence")).when(sure.isin(CONFIDENCES), sure).otherwise("medium").alias("confidence"),
        F.when(F.col("i").isNull(), F.col("generation_source")).otherwise("openai_vision").alias("generation_source"), *keep,
    )


def audited(steps: DataFrame) -> DataFrame:
    """Adds duration, weak_candidate, missing_operation, long_segment and coverage_review_required.

    ``steps``: job_id, step_number, system, action, expected_output, action_hint, boundary_score, ocr_text,
    screen_state_id, start_time, end_time."""
    w = in_order("step_number")
    generic = known(steps, "generic", lambda: generic_review(F.col("action")))
    rows = steps.withColumns({"signature": signature(steps), "is_generic": generic})
    shown = known(steps, "operates", lambda: operates(F.lower(text_of(F.col("ocr_text")))), "screen")
    rows = rows.withColumn("run", run_id(F.col("signature") != F.lag("signature").over(w), "step_number"))
    again = F.row_number().over(Window.partitionBy("job_id", "run").orderBy("step_number")) >= 2
    state = F.col("screen_state_id")
    alone = ~state.eqNullSafe(F.lag(state).over(w)) | ~state.eqNullSafe(F.lead(state).over(w))
    operated = F.coalesce(F.col("action_hint").isin(OPERATION_HINTS), F.lit(False)) | (F.coalesce("boundary_score", F.lit(0.0)) >= OPERATION_SCORE) | shown
    rows = rows.withColumns({
        "weak_candidate": F.col("is_generic") & again, "apart": F.col("is_generic") & alone, "missing_operation": F.col("is_generic") & F.coalesce(F.col("system") == "Excel", F.lit(False)) & operated,
        "duration": F.round(F.greatest(F.lit(0.0), F.coalesce(F.col("end_time") - F.col("start_time"), F.lit(0.0))), 3),
    })
    rows = rows.withColumn("long_segment", F.col("duration") > LONG_SECONDS)
    rows = rows.withColumn("coverage_review_required", F.col("weak_candidate") | F.col("apart") | F.col("missing_operation") | F.col("long_segment"))
    return rows.drop("signature", "is_generic", "run", "apart")


def to_verify(steps: DataFrame, most: int) -> DataFrame:
    """The risky steps that are sent for verification: the first ``most`` of each job."""
    risky = steps.where("risky").withColumn("nth", F.row_number().over(in_order("step_number")))
    return risky.where(F.col("nth") <= most).drop("nth")


def verified(steps: DataFrame, updates: DataFrame) -> DataFrame:
    """Steps after verification: the last update (by pos) of each step, field by field where it says something, then
    risky steps without exact values. ``updates``: job_id, step_number, pos, system, action, expected_output, confidence."""
    last = updates.groupBy("job_id", "step_number").agg(F.max_by(F.struct("system", "action", "expected_output", "confidence"), "pos").alias("u"))
    rows = steps.join(last, ["job_id", "step_number"], "left")
    new = lambda c: F.coalesce(F.nullif(F.col(f"u.{c}"), F.lit("")), F.col(c))
    safe = lambda c: F.when(F.col("risky"), redacted(new(c))).otherwise(new(c)).alias(c)
    kept = [c for c in steps.columns if c not in ("system", "action", "expected_output", "confidence")]
    sure = F.when(F.col("u.confidence").isin(CONFIDENCES), F.col("u.confidence")).otherwise(F.col("confidence"))
    return rows.select(*kept, new("system").alias("system"), safe("action"), safe("expected_output"), sure.alias("confidence"), F.col("u").isNotNull().alias("verified"))


def run_stats(calls: DataFrame) -> DataFrame:
    """job_id, attempted, succeeded, errors: what came of the model calls (job_id, pos, error; null if it succeeded)."""
    failed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("pos", "error"))))
    return calls.groupBy("job_id").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.array_join(failed["error"], "; ").alias("errors"))
