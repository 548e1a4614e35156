"""Cleaning whole procedures: removal with guards, merging, phases, completeness, and the scored report.

Every decision is an expression over windows of one job, so a job's rows are shuffled once; jobs run in parallel.
A job without steps has no rows in the step tables and a row with zeros in the report. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.functions.score import coverage_minimum
from tracewright.functions.text import contains_any, first_rule, normalized, text_of
from tracewright.operators.cleanup import BY_NUMBER, COMPARED, WORDING, category_of, described, duplicate, order_key, phase_of, review_terms, setup_first, step_flags
from tracewright.operators.ordered import each_row, in_order, paired, run_id

TIME = ("order_key", BY_NUMBER)

# Wording of a pivot's set-up and creation when they are merged.
SETUP_WORDING = "Confirm the PivotTable setup and open the blank PivotTable worksheet."
SETUP_RESULT = "The blank PivotTable worksheet is ready."


def job() -> Window:
    return Window.partitionBy("job_id")


def family_of() -> Column:
    """The workflow family of a row's job."""
    text = F.lower(F.concat_ws(" ", text_of(F.col("action")), text_of(F.col("expected_output"))))
    any_of = lambda cond: F.coalesce(F.bool_or(cond).over(job()), F.lit(False))
    out = F.when(any_of(contains_any(text, ["pivottable", "pivot table", "pivotchart", "slicer"])), "excel_pivottable")
    for system, family in (("Excel", "excel"), ("SAP", "sap"), ("Browser", "browser_crud")):
        out = out.when(any_of(F.col("system") == system), family)
    return out.otherwise("generic")


def worded_phases(rows: DataFrame) -> DataFrame:
    """Adds ``phases``: for each family the phase that a step's wording alone tells, before and after overrides."""
    a, e = normalized(F.col("action")), normalized(F.col("expected_output"))
    said = {"action": a, "expected": e, "text": F.trim(F.concat_ws(" ", a, e))}
    of = [F.coalesce(first_rule(rules.PIVOT_PHASES, said), F.lit(rules.PIVOT_DEFAULT)).alias("base"), first_rule(rules.PIVOT_OVERRIDES, said).alias("override")]
    return rows.withColumn("phases", F.struct(*of, *[phase_of(F.concat_ws(" ", a, e), F.lit(name)).alias(name) for name in rules.PHASES]))


def phase_labels(steps: DataFrame) -> DataFrame:
    """Adds family, phase, corrected (whether an override changed it) and phase_error (null if none).

    Steps with ``phases`` (``worded_phases``) give up these, others are looked at row by row."""
    if "phases" in steps.columns:
        pivot, of = F.col("family") == "excel_pivottable", lambda name: F.col(f"phases.{name}")
        base = F.when(pivot, of("base")).otherwise(F.coalesce(*[F.when(F.col("family") == name, of(name)) for name in rules.PHASES]))
        rows = steps.withColumn("family", family_of()).withColumn("base", base).withColumn("phase", F.coalesce(F.when(pivot, of("override")), F.col("base")))
        return rows.withColumns({"corrected": F.col("phase") != F.col("base"), "phase_error": phase_error()}).drop("base", "phases")
    a, e = normalized(F.col("action")), normalized(F.col("expected_output"))
    said = {"action": a, "expected": e, "text": F.trim(F.concat_ws(" ", a, e))}
    pivot = F.col("family") == "excel_pivottable"
    base = F.when(pivot, F.coalesce(first_rule(rules.PIVOT_PHASES, said), F.lit(rules.PIVOT_DEFAULT))).otherwise(phase_of(F.concat_ws(" ", a, e), F.col("family")))
    rows = steps.withColumn("family", family_of()).withColumn("base", base)
    rows = rows.withColumn("phase", F.coalesce(F.when(pivot, first_rule(rules.PIVOT_OVERRIDES, said)), F.col("base")))
    return rows.withColumns({"corrected": F.col("phase") != F.col("base"), "phase_error": phase_error()}).drop("base")


def phase_error() -> Column:
    """What is implausible about a pivot step's phase; null if nothing is."""
    said = {"action": normalized(F.col("action")), "phase": F.col("phase")}
    return F.when(F.col("family") == "excel_pivottable", first_rule(rules.PHASE_ERRORS, said))


def phase_sections(steps: DataFrame) -> DataFrame:
    """job_id, step_number, family, phase, section: runs of one phase are sections; a phase may come again."""
    rows = phase_labels(steps)
    section = run_id(F.col("phase") != F.lag("phase").over(in_order("step_number")), "step_number")
    return rows.select("job_id", "step_number", "family", "phase", section.alias("section"))


def legacy_phases(steps: DataFrame) -> DataFrame:
    """job_id, step_number, phase by the five older phases."""
    text = F.lower(F.concat_ws(" ", text_of(F.col("system")), text_of(F.col("action")), text_of(F.col("expected_output"))))
    phase = F.when(F.col("system") == "Excel", rules.LEGACY_PHASES[0][0])
    for name, terms in rules.LEGACY_PHASES:
        phase = phase.when(contains_any(text, terms), name)
    rows = steps.withColumn("phase", phase)
    nth = F.count_if(F.col("phase").isNull()).over(in_order(BY_NUMBER).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("job_id", BY_NUMBER, F.coalesce("phase", F.when(nth <= rules.LEGACY_FIRST, "Access system").otherwise("Validate")).alias("phase"))


Told = Callable[..., DataFrame]  # ``ordered.each_row`` or ``ordered.by_value``: how what a step's wording tells is found


def judged(steps: DataFrame, info: DataFrame, told: Told = each_row) -> DataFrame:
    """Steps with order_key, flags, category, and the removal of each: null, noise or filler. Neighbours are those by order_key.

    Guards: where removal would leave less than 0.60 steps an event (from 25 events), where there were too few
    steps to begin with, or where over 40 % of five or more steps would go, only noise goes."""
    rows = told(steps, WORDING, lambda x: step_flags(x.withColumn("terms", review_terms())))
    rows = rows.withColumn("order_key", order_key(steps)).join(info.select("job_id", "n_events"), "job_id").withColumn("family", family_of())
    rows = rows.withColumn("category", category_of(in_order(*TIME), F.col("terms"))).drop("terms")
    n, events = F.count(F.lit(1)).over(job()), F.col("n_events")
    going = F.count_if(F.col("noise") | F.col("category").eqNullSafe(F.lit("passive_filler"))).over(job())
    few = (events > 0) & (n < coverage_minimum(events))
    guard = few | ((events >= 25) & ((n - going) / events < 0.60)) | ((going / n > 0.40) & (n >= 5))
    rows = rows.withColumn("guarded", guard)
    removal = F.when(F.col("noise"), "noise").when(~F.col("guarded") & (F.col("category") == "passive_filler"), "filler")
    alone = F.when(F.col("category").isNotNull(), F.when(F.col("checkpoint"), "operational_checkpoint").otherwise("passive_filler"))
    return rows.withColumns({"removal": removal, "category": F.when(F.col("guarded"), alone).otherwise(F.col("category")), "n_before": n})


def merged(rows: DataFrame, told: Told = each_row) -> DataFrame:
    """One row for each step or pair of adjacent duplicates: the more specific one with ``sources`` (numbers).

    A job whose merging would fall below its coverage minimum stays unmerged. Of a pivot's set-up and creation the
    creation's expected output stays, or else the set-up's, or else a fixed one."""
    score = F.size("words") + 8 * F.col("meaningful").cast("int") - 5 * F.col("passive").cast("int") + 4 * F.col("checkpoint").cast("int")
    own = [c for c in rows.columns if c != "job_id"]
    rows = described(rows, told)
    rows = rows.withColumn("me", F.struct(*COMPARED, *[c for c in own if c not in COMPARED], score.alias("score")))
    rows = rows.select("job_id", *TIME, "n_events", "me", F.lead("me").over(in_order(*TIME)).alias("next"))
    rows = paired(rows, duplicate("me", "next"), *TIME)
    n, pairs, least = F.count(F.lit(1)).over(job()), F.count_if("first").over(job()), coverage_minimum(F.col("n_events"))
    undo = (least > 0) & (n - pairs < least) & (least <= n)
    rows = rows.withColumns({"second": F.coalesce(F.lag("first").over(in_order(*TIME)), F.lit(False)), "undo": undo})
    rows = rows.where("undo or not second").withColumn("pair", F.col("first") & ~F.col("undo"))
    setup = setup_first("me", "next")
    best = F.when(F.col("pair") & (setup | (F.col("next.score") > F.col("me.score"))), F.col("next")).otherwise(F.col("me"))
    said = F.when(F.col("pair") & setup, SETUP_WORDING)
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    shown = F.when(F.col("pair") & setup, F.coalesce(blank("next.expected_output"), blank("me.expected_output"), F.lit(SETUP_RESULT)))
    sources = F.when(F.col("pair"), F.array("me.step_number", "next.step_number")).otherwise(F.array("me.step_number"))
    rows = rows.select("job_id", best.alias("x"), sources.alias("sources"), said.alias("said"), shown.alias("shown")).select("job_id", *[F.col(f"x.{c}").alias(c) for c in own], "sources", "said", "shown")
    return rows.withColumns({"action": F.coalesce("said", "action"), "expected_output": F.coalesce("shown", "expected_output")}).drop("said", "shown")


def clean_steps(steps: DataFrame, info: DataFrame, most: int | None = None) -> DataFrame:
    """The cleaned procedure: judged, merged, capped, renumbered by ``order_key`` as ``place``, with phases and sections."""
    return clean_judged(judged(steps, info), most)


def clean_judged(rows: DataFrame, most: int | None = None, told: Told = each_row) -> DataFrame:
    """``clean_steps`` of steps that are ``judged`` already."""
    stay = rows.where("removal is null")
    rows = merged(stay, told).withColumn("place", F.row_number().over(in_order(*TIME)))
    rows = rows if most is None else rows.where(F.col("place") <= most)
    if told is not each_row:
        shown = stay.select("expected_output").unionByName(stay.sparkSession.createDataFrame([(SETUP_RESULT,)], "expected_output string"))
        rows = told(rows, WORDING, worded_phases, stay.select(*WORDING).unionByName(shown.withColumn("action", F.lit(SETUP_WORDING))))
    rows = phase_labels(rows).drop("order_key")
    return rows.withColumn("section", run_id(F.col("phase") != F.lag("phase").over(in_order("place")), "place"))


def removed_steps(steps: DataFrame, info: DataFrame) -> DataFrame:
    """job_id, step_number, reason: noise, filler, or repeated filler (the same words were removed before)."""
    return removed_judged(judged(steps, info))


def removed_judged(rows: DataFrame) -> DataFrame:
    """``removed_steps`` of steps that are ``judged`` already."""
    rows = rows.where("removal is not null")
    words = F.concat_ws(" ", normalized(F.col("action")), normalized(F.col("expected_output")))
    again = F.row_number().over(Window.partitionBy("job_id", "removal", words).orderBy(*TIME)) > 1
    return rows.select("job_id", BY_NUMBER, F.when((F.col("removal") == "filler") & again, "repeated filler").otherwise(F.col("removal")).alias("reason"))


def watched(clean: DataFrame, told: Told = each_row) -> DataFrame:
    """Adds what is counted along the order: event_gap to the last operational step, in_review, run, twice.

    The gap is in source_event_index where there is such a column, else in step numbers."""
    w, at = in_order("place"), F.col("source_event_index" if "source_event_index" in clean.columns else BY_NUMBER)
    before = F.last(F.when(F.col("meaningful"), at), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    in_review = F.coalesce(F.col("category").isin("contextual_review", "passive_filler"), F.lit(False)) | (F.col("review") & ~F.col("meaningful"))
    rows = described(clean, told).withColumns({"event_gap": F.when(F.col("meaningful"), at - before), "in_review": in_review})
    rows = rows.withColumn("run", run_id(~F.col("in_review"), "place"))
    rows = rows.withColumn("run_at", F.when(F.col("in_review"), F.count_if("in_review").over(Window.partitionBy("job_id", "run").orderBy("place"))))
    rows = rows.withColumn("me", F.struct(*COMPARED))
    return rows.withColumn("next", F.lead("me").over(w)).withColumn("twice", F.coalesce(duplicate("me", "next"), F.lit(False)))


def job_counts(clean: DataFrame, told: Told = each_row) -> DataFrame:
    """One row per job: counts of its cleaned steps, and which actions the evidence asks for but no step describes.

    Evidence is what steps say, expect and, where there is a column ocr_text, show. It and what is done are looked for in
    the texts of all steps of a job, one after another, so a phrase may go on from one step to the next."""
    n = F.count(F.lit(1))
    action = normalized(F.col("action"))
    seen = [F.col(c) for c in ("action", "expected_output", "ocr_text") if c in clean.columns]
    text = normalized(F.concat_ws(" ", *[text_of(c) for c in seen]))
    pivot = F.first("family") == "excel_pivottable"
    of_pivot = lambda c: F.when(F.col("family") == "excel_pivottable", F.struct("place", c.alias("said")))  # noqa: E731  (others ask for nothing)
    together = lambda c: F.array_join(F.array_sort(F.collect_list(of_pivot(c)))["said"], " ")
    any_of = lambda column, terms: contains_any(F.col(column), terms if isinstance(terms, list) else [terms])
    missing = []
    for name, evidence, acted, asked, phrases in rules.EXPECTED_ACTIONS:
        done = any_of("acts", phrases) if asked else any_of("acts", acted) & any_of("acts", phrases)
        asks = any_of("evidence", evidence) & (any_of("acts", acted) if asked else F.lit(True))
        missing.append(F.when(F.col("pivot") & asks & ~done, name))
    diagnostic = F.col("generation_source").eqNullSafe(F.lit("diagnostic_fallback"))
    counts = watched(clean, told).groupBy("job_id").agg(
        n.alias("steps"), F.first("n_before").alias("before"), F.count_if("noise").alias("noise"), F.count_if(F.col("passive") | F.col("category").eqNullSafe(F.lit("contextual_review"))).alias("passive"),
        F.count_if("twice").alias("duplicates"), F.count_if(F.size("sources") > 1).alias("merged"), F.count_if(~F.col("confidence").eqNullSafe(F.lit("high"))).alias("low"), F.count_if(diagnostic).alias("diagnostic"),
        F.count_if((F.col("review") & ~F.col("meaningful")) | action.startswith("review the process state shown")).alias("generic"), F.count_if(F.col("meaningful")).alias("operational"),
        F.count_if(F.col("category") == "contextual_review").alias("contextual"), F.count_if(F.col("category") == "operational_checkpoint").alias("checkpoints"),
        F.count_if(F.col("run_at") == 2).alias("review_runs"), F.coalesce(F.max("event_gap"), F.lit(0)).alias("widest_gap"), F.count_if(F.col("duration") > 45).alias("long"),
        F.count_if("corrected").alias("corrections"), F.count("phase_error").alias("phase_errors"), F.count_if(F.col("phase").isin(rules.GENERIC_PHASES)).alias("generic_phases"), F.size(F.collect_set("phase")).alias("phases"),
        pivot.alias("pivot"), together(text).alias("evidence"), together(action).alias("acts"),
    )
    return counts.withColumn("missing", F.array_join(F.array_compact(F.array(*missing)), ",")).drop("pivot", "evidence", "acts")


def completeness(clean: DataFrame, info: DataFrame) -> DataFrame:
    """job_id, review_runs, thin (few operational steps for the events), gappy (five events or more without one), missing."""
    rows = job_counts(clean).join(info.select("job_id", "n_events"), "job_id")
    big = F.col("n_events") >= 25
    thin = big & (F.col("operational") < F.greatest(F.lit(12), F.floor(F.col("steps") * 0.55)))
    return rows.select("job_id", "review_runs", thin.alias("thin"), (big & (F.col("widest_gap") >= 5)).alias("gappy"), "missing")


def quality_report(clean: DataFrame, info: DataFrame, late: DataFrame, told: Told = each_row) -> DataFrame:
    """One row per job of ``info``: counts, ratios, score 0 to 100, readiness, blockers in the order of their rules.

    ``late``: the rows out of order at the start (job_id). Order itself is repaired by then, so it costs points only."""
    c = F.col
    violations = late.groupBy("job_id").agg(F.count(F.lit(1)).alias("violations"))
    rows = info.join(job_counts(clean, told), "job_id", "left").join(violations, "job_id", "left").fillna(0).fillna("", ["missing"])
    n, events = c("steps"), c("n_events")
    share = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    rows = rows.withColumns({
        "ratio": F.when(events > 0, F.round(n / events, 3)), "coverage": F.round(c("operational") / F.greatest(F.lit(1), n), 3), "density": F.when(c("duration") > 0, F.round(n / (c("duration") / 60), 3)),
        "n_missing": F.when(c("missing") == "", 0).otherwise(F.size(F.split("missing", ","))),
    })
    below = lambda x: F.coalesce(c("ratio") < x, F.lit(False))
    excused = c("justification") != ""
    rows = rows.withColumns({
        "raw_low": (events > 0) & (c("before") < coverage_minimum(events)), "final_low": below(0.60), "short": (events >= 25) & below(0.70), "vague": (events >= 25) & (c("coverage") < 0.55), "wordy": share(c("generic")) > 0.20,
        "sparse": (c("mode") == "production_vision") & (c("duration") > 300) & F.coalesce(c("density") < c("target_density"), F.lit(False)) & ~excused,
    })
    rows = rows.withColumn("uncovered", (c("raw_low") | c("final_low")) & ~excused)
    free = lambda name: F.greatest(F.lit(0), c(name) - rules.FREE.get(name, 0))
    each = [F.least(F.lit(rules.MOST_POINTS.get(name, 10**6)), points * free(name)) for name, points in rules.POINTS_EACH.items()]
    holds = {
        "raw_low": c("raw_low"), "final_low": c("final_low"), "short": c("short"), "vague": c("vague"), "wordy": c("wordy"), "few": n < 8, "unsure": share(c("low")) > 0.25, "violations": c("violations") > 0,
        "one_phase": (c("phases") == 1) & (c("generic_phases") > 0), "generic_phases": c("generic_phases") == n, "phase_errors": c("phase_errors") > 0, "sparse": c("sparse"),
    }
    costs = each + [F.when(holds[name], points).otherwise(0) for name, points in rules.POINTS_ONCE.items()]
    score = F.when(n == 0, 0).otherwise(100 - reduce(lambda a, b: a + b, costs))
    limit = F.when(c("n_missing") > 0, rules.SCORE_MISSING).when((c("phase_errors") > 0) | c("sparse"), rules.SCORE_IMPLAUSIBLE).otherwise(100)
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(limit, score)).cast("int"))
    crowded = c("contextual") > F.greatest(F.lit(3), F.floor(n / 5))
    block = [
        ("noise", c("noise") > 0), ("coverage", c("short")), ("under-coverage", c("uncovered")), ("passive reviews", crowded), ("diagnostic mode", c("mode") == "diagnostic_only"), ("diagnostic steps", c("diagnostic") > n / 2),
        ("no evidence source", ~c("model_ready") & (c("ocr_count") == 0)), ("model failed", c("model_ready") & (c("calls") > 0) & (c("succeeded") == 0)), ("few operations", c("vague")), ("generic reviews", c("wordy")),
        ("missing actions", c("n_missing") > 0), ("phase errors", c("phase_errors") > 0), ("density", c("sparse")), ("long segments", c("long") > 0),
    ]
    rows = rows.withColumn("blockers", F.array_join(F.array_compact(F.array(*[F.when(cond, name) for name, cond in block])), ","))
    ready = (c("score") >= 80) & (c("blockers") == "") & ~c("raw_low") & (c("diagnostic") == 0)
    return rows.select(
        "job_id", "n_events", "before", "steps", "merged", "noise", "passive", "duplicates", "low", "diagnostic", "generic", "operational", "contextual", "checkpoints", "review_runs", "long", "corrections", "phase_errors", "violations", "missing",
        "ratio", "coverage", "density", "score", F.when(ready, "demo_ready").when(c("score") >= 60, "needs_review").otherwise("not_ready").alias("readiness"), "blockers",
    )
