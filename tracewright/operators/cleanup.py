"""Cleaning steps without breaking their order, phases, and the quality report of each job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.functions.score import seconds_in
from tracewright.functions.text import action_roots, checkpoint, contains_any, content_tokens, generic_review, jaccard, meaningful, noise, normalized, passive, review_style, text_of
from tracewright.operators.ordered import each_row, in_order, paired, run_id

BY_NUMBER = "step_number"


#: What a step is worded by.
WORDING = ["action", "expected_output"]


def step_flags(steps: DataFrame) -> DataFrame:
    a, e = F.col("action"), F.col("expected_output")
    rows = steps.withColumns({"meaningful": meaningful(a), "checkpoint": checkpoint(a, e), "review": review_style(a), "generic": generic_review(a)})
    return rows.withColumns({"noise": noise(a, e, F.col("meaningful")), "passive": passive(a, e, F.col("meaningful"), F.col("checkpoint"))})


def first_of(steps: DataFrame, names: tuple[str, ...], kind: str = "double") -> Column:
    """The first value given among those of the columns that there are; null if there is none."""
    return F.coalesce(*[F.col(c).try_cast(kind) for c in names if c in steps.columns], F.lit(None).cast(kind))


def start_of(steps: DataFrame) -> Column:
    """When a step begins: the first given of start_time and time_sec, or else the seconds in the screenshot's name."""
    named = seconds_in(F.col("screenshot")) if "screenshot" in steps.columns else F.lit(None).cast("double")
    return F.coalesce(first_of(steps, ("start_time", "time_sec")), named)


def order_key(steps: DataFrame) -> Column:
    """(kind, value) by which steps are ordered: 0 and the time, or 1 and the event's number, or 2 and the step's.

    Steps with a time so come before those without one. A number that isn't one counts as 0."""
    time, event = start_of(steps), first_of(steps, ("event_index", "source_event_index", "event_id"))
    kind = F.when(time.isNotNull(), 0).when(event.isNotNull(), 1).otherwise(2)
    return F.struct(kind.alias("kind"), F.coalesce(time, event, F.col(BY_NUMBER).try_cast("double"), F.lit(0.0)).alias("value"))


def chronology(steps: DataFrame) -> DataFrame:
    """Rows whose key is below that of the row they follow: job_id, step_number, kind, value, prior_kind, prior_value."""
    rows = steps.select("job_id", BY_NUMBER, order_key(steps).alias("key")).withColumn("prior", F.lag("key").over(in_order(BY_NUMBER))).where("key < prior")
    return rows.select("job_id", BY_NUMBER, "key.*", F.col("prior.kind").alias("prior_kind"), F.col("prior.value").alias("prior_value"))


def ordering_keys(steps: DataFrame) -> DataFrame:
    """Adds the kind and value of ``order_key``, and ``place`` by them."""
    rows = steps.withColumn("__key", order_key(steps)).withColumns({"kind": F.col("__key.kind"), "value": F.col("__key.value")}).drop("__key")
    return rows.withColumn("place", F.row_number().over(in_order("kind", "value", BY_NUMBER)))


def in_time(steps: DataFrame) -> DataFrame:
    """Steps renumbered by their key, then their number: job_id, original, step_number."""
    return ordering_keys(steps).select("job_id", F.col(BY_NUMBER).alias("original"), F.col("place").alias(BY_NUMBER))


def workflow_family(steps: DataFrame) -> DataFrame:
    """job_id, family: by pivot terms, then Excel, SAP and Browser steps, else generic."""
    text = F.lower(F.concat_ws(" ", text_of(F.col("action")), text_of(F.col("expected_output"))))
    has = lambda s: F.bool_or(F.coalesce(F.col("system") == s, F.lit(False)))
    family = F.when(F.bool_or(contains_any(text, ["pivottable", "pivot table", "pivotchart", "slicer"])), "excel_pivottable").when(has("Excel"), "excel").when(has("SAP"), "sap").when(has("Browser"), "browser_crud").otherwise("generic")
    return steps.groupBy("job_id").agg(family.alias("family"))


def phase_of(text: Column, family: Column) -> Column:
    """The first phase rule of the family that the text meets; null for a family without a table."""
    out = None
    for name, table in rules.PHASES.items():
        case = F.coalesce(*[F.when(contains_any(text, terms), phase) for terms, phase in table if terms], F.lit(table[-1][1]))
        own = F.when(family == name, case)
        out = own if out is None else F.coalesce(out, own)
    return out


def terms_in(tokens: Column, terms: list[str]) -> Column:
    return F.array_sort(F.array_intersect(tokens, F.array(*map(F.lit, terms))))


def described(steps: DataFrame, told: Callable[..., DataFrame] = each_row) -> DataFrame:
    """Adds what pairs are compared by. ``told``: how what their wording tells is found, see ``ordered.by_value``."""
    begins = start_of(steps)
    times = {"begins": F.coalesce(begins, F.lit(0.0)), "ends": F.coalesce(first_of(steps, ("end_time",)), begins, F.lit(0.0))}
    return told(steps, WORDING, compared).withColumns(times)


def compared(steps: DataFrame) -> DataFrame:
    """Adds what pairs are compared by that their wording alone tells."""
    a, e = text_of(F.col("action")), text_of(F.col("expected_output"))
    words = F.col("words")
    details = F.array_sort(F.array_union(F.array_intersect(words, F.array(*map(F.lit, rules.DETAIL_TERMS))), F.filter(words, lambda w: w.rlike("^[0-9]+$"))))
    body = normalized(F.concat_ws(" ", a, e))
    fields = F.filter(F.array(*map(F.lit, rules.FIELD_TERMS)), lambda t: normalized(a).contains(t))
    steps = steps.withColumn("words", content_tokens(F.concat_ws(" ", a, e)))
    return steps.withColumns({"body": body, "fields": fields, "pivot": normalized(a).contains("pivottable"), "action_words": content_tokens(a), "expected_words": content_tokens(e), "targets": terms_in(words, rules.DOMAIN_TERMS), "details": details, "roots": terms_in(action_roots(a), rules.VERBS)})


# Phrases that name one intent.
SAME_INTENT = [("pivottable setup", "create a new pivottable"), ("review the sales data table", "review the worksheet data")]


def canned(x: Column, y: Column, pairs: list = SAME_INTENT) -> Column:
    out = F.lit(False)
    for a, b in pairs:
        out = out | (x.contains(a) & y.contains(b)) | (x.contains(b) & y.contains(a))
    return out


COMPARED = ["step_number", "begins", "ends", "system", "body", "fields", "pivot", "words", "action_words", "expected_words", "targets", "details", "roots"]


def duplicate(a: str, b: str) -> Column:
    """Whether two described steps are one: the vetoes in order, then the same intent.

    Near is within 2 numbers, or 45 s from the end of the first to the beginning of the second."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    both = lambda c: (F.size(x(c)) > 0) & (F.size(y(c)) > 0)
    near = (F.abs(y("step_number") - x("step_number")) <= 2) | (F.abs(y("begins") - x("ends")) <= 45)
    targets = ~(both("targets") & ~F.arrays_overlap(x("targets"), y("targets")))
    details = ~(both("details") & (x("details") != y("details")))
    setup = canned(x("body"), y("body"), SAME_INTENT[:1])
    fields = ~((x("pivot") | y("pivot")) & both("fields") & (x("fields") != y("fields")))
    verbs = setup | ~(both("roots") & (x("roots") != y("roots")) & (jaccard(x("action_words"), y("action_words"), 1.0) < 0.72))
    alike = jaccard(x("words"), y("words"), 1.0)
    intent = canned(x("body"), y("body")) | (alike > 0.72) | ((jaccard(x("expected_words"), y("expected_words"), 1.0) > 0.45) & (alike > 0.55))
    return (x("system") == y("system")) & fields & near & targets & details & verbs & intent


def setup_first(a: str, b: str) -> Column:
    """Whether the set-up of a pivot comes before its creation: the creation's row stays then."""
    return F.col(f"{a}.body").contains(SAME_INTENT[0][0]) & F.col(f"{b}.body").contains(SAME_INTENT[0][1])


def merged_pairs(steps: DataFrame) -> DataFrame:
    """job_id, left_number, right_number, kept: adjacent steps that are one, taken from the left without overlap.

    The more specific step is kept, the left one if they are equal; of the set-up of a pivot and its creation the latter."""
    flags = step_flags(described(steps))
    score = F.size("words") + 8 * F.col("meaningful").cast("int") - 5 * F.col("passive").cast("int") + 4 * F.col("checkpoint").cast("int")
    rows = flags.withColumn("me", F.struct(*COMPARED, score.alias("score")))
    rows = rows.select("job_id", "step_number", "me", F.lead("me").over(in_order(BY_NUMBER)).alias("next"))
    rows = paired(rows, duplicate("me", "next"), BY_NUMBER).where("first")
    return rows.select("job_id", F.col("step_number").alias("left_number"), F.col("next.step_number").alias("right_number"), F.when((F.col("me.score") >= F.col("next.score")) & ~setup_first("me", "next"), F.col("step_number")).otherwise(F.col("next.step_number")).alias("kept"))


def review_runs(steps: DataFrame) -> DataFrame:
    """job_id, first_number, last_number, n: runs of two or more review-style steps."""
    rows = step_flags(steps).withColumn("run", run_id(~F.col("review"), BY_NUMBER)).where("review")
    return rows.groupBy("job_id", "run").agg(F.min(BY_NUMBER).alias("first_number"), F.max(BY_NUMBER).alias("last_number"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("run")


def removed(steps: DataFrame, numbers: DataFrame) -> DataFrame:
    """Steps whose number isn't among those to remove."""
    return steps.join(numbers, ["job_id", "step_number"], "left_anti")


def semantic_counts(steps: DataFrame) -> DataFrame:
    """One row per job: steps, noise, passive, generic, operational, low_confidence, coverage (operational share)."""
    n = F.count(F.lit(1))
    count = lambda c: F.count_if(F.col(c))
    return step_flags(steps).groupBy("job_id").agg(
        n.alias("steps"), count("noise").alias("noise"), count("passive").alias("passive"), count("generic").alias("generic"), count("meaningful").alias("operational"),
        F.count_if(~F.col("confidence").eqNullSafe(F.lit("high"))).alias("low_confidence"), F.round(count("meaningful") / n, 3).alias("coverage"),
    )


def state_counts(steps: DataFrame, part: str, lg_k: int = 12) -> DataFrame:
    """job_id, states: about how many screen states a job has, from sketches of its parts, merged.

    The relative error is about 1.04 / 2 ** (lg_k / 2), 1.6 % by default; small counts are exact."""
    parts = steps.groupBy("job_id", part).agg(F.hll_sketch_agg("screen_state_id", F.lit(lg_k)).alias("sketch"))
    return parts.groupBy("job_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("states"))


def distinct_states(rows: DataFrame) -> DataFrame:
    """Each job's states in order of first appearance: job_id, state, first_number, place."""
    first = rows.groupBy("job_id", F.col("screen_state_id").alias("state")).agg(F.min(BY_NUMBER).alias("first_number"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("first_number")))


# What a review may be about, and phrases that decide within Excel workflows.
REVIEW_OBJECTS = ["table", "worksheet", "source data", "header row", "pivottable", "pivotchart", "pivot chart", "chart", "slicer", "filter", "summary", "total", "result", "confirmation", "status", "message", "output", "export"]
FILLER = ["worksheet data", "fields pane", "design tab", "visible process screen", "screen remains visible"]
OUTPUTS = ["formatted excel table", "selected header row", "source data table", "pivottable summary", "pivot table summary", "pivottable with", "pivot table with", "pivotchart", "pivot chart", "slicer", "filter", "percentage column"]


def review_terms() -> Column:
    """Whether a step's wording names what a review may be about, filler, and outputs."""
    body = F.concat_ws(" ", normalized(F.col("action")), normalized(F.col("expected_output")))
    return F.struct(contains_any(body, REVIEW_OBJECTS).alias("about"), contains_any(body, FILLER).alias("filler"), contains_any(body, OUTPUTS).alias("outputs"))


def category_of(order: Window, terms: Column | None = None) -> Column:
    """operational_checkpoint, contextual_review or passive_filler for a review-like step, by its neighbours in
    ``order``; null for others. Needs the flags and family. ``terms``: ``review_terms``, if they are known already.

    A step between two meaningful ones bridges them only if the next is meaningful, so that case is part of it."""
    before, after = (F.coalesce(f("meaningful").over(order), F.lit(False)) for f in (F.lag, F.lead))
    terms, excel = review_terms() if terms is None else terms, F.col("family").startswith("excel")
    about, shows = terms["about"], excel & terms["outputs"]
    category = (
        F.when(F.col("checkpoint"), "operational_checkpoint").when(excel & terms["filler"], "passive_filler").when(shows & before, "operational_checkpoint")
        .when(shows & after, "contextual_review").when(about & before, "operational_checkpoint").when(about & after, "contextual_review").otherwise("passive_filler")
    )
    return F.when(F.col("review") | F.col("passive") | F.col("checkpoint"), category)


def review_categories(steps: DataFrame) -> DataFrame:
    """job_id, step_number, category of review-like steps."""
    rows = step_flags(steps).join(workflow_family(steps), "job_id").withColumn("category", category_of(in_order(BY_NUMBER)))
    return rows.where("category is not null").select("job_id", "step_number", "category")
