"""Procedure steps: wording by rules, audit, risk flags, validation, updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.functions.text import contains_any, generic_review, hint_of, redacted, text_of, word_norm
from tracewright.operators.ordered import fold, in_order, run_id

# Wording of the local step writer: rule name, action, expected.
FALLBACK = {
    "validated export": ("Validate that the exported file is available.", "The exported file is visible and ready for review."),
    "export": ("Export the displayed data.", "The data export is prepared or completed."),
    "submit": ("Submit the visible update and review the confirmation.", "The system confirms that the update was saved."),
    "update": ("Update the visible process fields.", "The visible fields reflect the required changes."),
    "filter": ("Apply or review the visible filter criteria.", "The filtered results are displayed for review."),
    "data entry": ("Enter or review the visible business fields.", "The required fields are populated or ready for validation."),
    "post/save": ("Save or post the visible transaction after review.", "The system records the transaction status."),
    "invoice": ("Review the visible invoice or supplier details.", "The required business details are visible for validation."),
    "excel analysis": ("Review or configure the visible Excel analysis element.", "The Excel worksheet or analysis view reflects the visible configuration change."),
    "excel": ("Review or update the visible spreadsheet data.", "The spreadsheet shows the relevant working data."),
    "sap": ("Open or review the visible SAP transaction screen.", "The SAP screen displays the relevant process information."),
    "navigation": ("Open or navigate to the visible process area.", "The next process screen is available for review."),
}


def known(rows: DataFrame, name: str, otherwise: Callable[[], Column], of: str = "worded") -> Column:
    """What ``worded`` or ``screen`` (see ``screened``) says where there is such a column, else the expression itself."""
    return F.col(f"{of}.{name}") if of in rows.columns else otherwise()


def screened(rows: DataFrame) -> DataFrame:
    """Adds ``screen``, what the text on a screen and its system alone tell: the hint, and the rule that words the step, if one holds."""
    hint, text = hint_of(F.col("ocr_text")), F.lower(text_of(F.col("ocr_text")))
    rows = rows.withColumn("hint", hint).withColumn("low", text)
    rule = first_fallback(F.col("low"), F.col("system"), F.col("hint"))
    return rows.withColumn("screen", F.struct("hint", rule.alias("rule"), operates(F.col("low")).alias("operates"))).drop("hint", "low")


def worded(rows: DataFrame) -> DataFrame:
    """Adds ``worded``, what a step's system and wording alone tell: whether it is generic or specific, and itself without exact values."""
    a, e = F.col("action"), F.col("expected_output")
    rows = rows.withColumns({"safe_action": redacted(a), "safe_expected": redacted(e)})
    words = lambda x, y: F.concat_ws("|", word_norm(F.col(x)), word_norm(F.col(y)))
    told = F.struct(
        generic_review(a).alias("generic"), signature(rows).alias("signature"), specific(rows).alias("specific"), "safe_action", "safe_expected", words("action", "expected_output").alias("words"), words("safe_action", "safe_expected").alias("safe_words"),
    )
    return rows.withColumn("worded", told).drop("safe_action", "safe_expected")


def signature(steps: DataFrame) -> Column:
    """System and wording, normalised: equal for steps that say the same."""
    return known(steps, "signature", lambda: word_norm(F.concat_ws(" ", text_of(F.col("system")), text_of(F.col("action")), text_of(F.col("expected_output")))))


def specific(steps: DataFrame) -> Column:
    """Whether a step names a specific action or an exact value."""
    both = F.concat_ws(" ", text_of(F.col("action")), text_of(F.col("expected_output")))
    return known(steps, "specific", lambda: both.rlike(rules.SPECIFIC_ACTION) | both.rlike(rules.EXACT_VALUE))


def operates(low: Column) -> Column:
    """Whether a lower-cased screen names something that is operated."""
    return contains_any(low, rules.OPERATION_TERMS) | contains_any(low, rules.PIVOT_TERMS)


def first_fallback(text: Column, system: Column, hint: Column) -> Column:
    return F.coalesce(*[F.when(cond, name) for name, cond in fallback_rules(text, system, hint)])


def fallback_rules(text: Column, system: Column, hint: Column) -> list[tuple[str, Column]]:
    """Rules of the local step writer in order; the first that holds names the wording."""
    has = lambda *terms: contains_any(text, list(terms))
    return [
        ("validated export", has("validate exported") | (has("exported file") & has("ready", "appears"))),
        ("export", (hint == "export") | has("export", "download")),
        ("submit", has("submit") & has("confirmation", "saved")),
        ("update", has("update") & has("field", "terms", "priority", "status", "owner")),
        ("filter", (hint == "filter") | has("filter")),
        ("data entry", hint == "data entry"),
        ("post/save", (hint == "post/save") | has("save", "post")),
        ("invoice", has("invoice", "supplier", "vendor")),
        ("excel analysis", (system == "Excel") & has("pivot", "field", "measure")),
        ("excel", system == "Excel"),
        ("sap", system == "SAP"),
        ("navigation", hint == "navigation"),
    ]


def local_steps(events: DataFrame, keep: tuple[str | Column, ...] = ()) -> DataFrame:
    """job_id, event_id, rule, action, expected_output, confidence, generation_source of events with clean_text,
    system, action_hint and screen_state_id, and the events' columns to keep."""
    found = known(events, "rule", lambda: first_fallback(F.lower(text_of(F.col("clean_text"))), F.col("system"), F.col("action_hint")), "screen")
    rule = F.coalesce(found, F.when(F.col("screen_state_id").isNotNull(), "state").otherwise("default"))
    wording = F.create_map(*[F.lit(x) for name, (a, e) in FALLBACK.items() for x in (name, f"{a}\t{e}")])
    number = F.col("event_id").cast("string")
    own = F.when(F.col("rule") == "state", F.concat(F.lit("Review the process state shown at event "), number, F.lit(".\tScreen state "), F.col("screen_state_id").cast("string"), F.lit(" is visible for the next workflow action.")))
    own = own.when(F.col("rule") == "default", F.concat(F.lit("Review the visible process screen for event "), number, F.lit(".\tThe relevant process information is available for chronological review.")))
    said = F.split(F.coalesce(own, F.try_element_at(wording, F.col("rule"))), "\t")
    empty = text_of(F.col("clean_text")) == ""
    return events.withColumn("rule", rule).select(
        "job_id", "event_id", "rule", said[0].alias("action"), said[1].alias("expected_output"), F.when(empty, "low").otherwise("medium").alias("confidence"),
        F.when(F.trim(text_of(F.col("clean_text"))) == "", "diagnostic_fallback").otherwise("local_ocr").alias("generation_source"), *keep,
    )


def audit_runs(steps: DataFrame) -> DataFrame:
    """Adds run_length of equal consecutive (system, action, expected) and weak: such a run, or a generic review."""
    same = F.struct("system", "action", "expected_output")
    w = in_order("step_number")
    rows = steps.withColumn("run", run_id(~same.eqNullSafe(F.lag(same).over(w)), "step_number"))
    n = F.count(F.lit(1)).over(Window.partitionBy("job_id", "run"))
    return rows.select("job_id", "step_number", n.alias("run_length"), ((n >= 2) | generic_review(F.col("action"))).alias("weak"))


def risk_flags(steps: DataFrame) -> DataFrame:
    """Adds risky: not of high confidence, a specific action or exact value, two systems that disagree, or a step
    whose coverage the audit wants reviewed (if there is such a column)."""
    apart = (F.col("rule_system") != "Other") & (F.col("system") != F.col("rule_system")) & (F.col("rule_system") != "") & (F.col("system") != "")
    risky = ~F.col("confidence").eqNullSafe(F.lit("high")) | specific(steps) | F.coalesce(apart, F.lit(False))
    if "coverage_review_required" in steps.columns:
        risky = risky | F.coalesce("coverage_review_required", F.lit(False))
    return steps.withColumn("risky", risky)


def verified_offline(steps: DataFrame) -> DataFrame:
    """Risky steps without exact values and at most of medium confidence."""
    safe = lambda c, name: F.when(F.col("risky"), known(steps, name, lambda: redacted(F.col(c)))).otherwise(F.col(c)).alias(c)
    kept = [c for c in steps.columns if c not in ("action", "expected_output", "confidence", "worded")]
    words = [F.when(F.col("risky"), F.col("worded.safe_words")).otherwise(F.col("worded.words")).alias("words")] if "worded" in steps.columns else []
    return steps.select(*kept, *words, safe("action", "safe_action"), safe("expected_output", "safe_expected"), F.when(F.col("risky") & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence")).alias("confidence"))


def repaired(steps: DataFrame, toolbar: bool = True) -> DataFrame:
    """Steps with an action (that doesn't begin like a toolbar entry, unless ``toolbar`` is off), with a known
    system: an unknown one gives way to the rules', and theirs overrides and costs high confidence."""
    return with_repairs(steps.where(told(toolbar)))


def told(toolbar: bool = True) -> Column:
    """Whether a step has an action, and (with ``toolbar``) none that begins like a toolbar entry."""
    action = F.trim(text_of(F.col("action")))
    return (action != "") & ~F.lower(action).rlike(rules.TOOLBAR) if toolbar else action != ""


def with_repairs(rows: DataFrame) -> DataFrame:
    """Steps with trimmed texts, a known system and a known confidence."""
    known, action = F.array(*map(F.lit, [*rules.SYSTEMS, "Other"])), F.trim(text_of(F.col("action")))
    rule_known = F.array_contains(known, F.coalesce("rule_system", F.lit("")))
    first = F.when(F.array_contains(known, F.coalesce("system", "rule_system", F.lit("Other"))), F.coalesce("system", "rule_system", F.lit("Other"))).when(rule_known, F.col("rule_system")).otherwise("Other")
    sure = F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("medium")
    over = rule_known & (F.col("rule_system") != "Other") & (first != F.col("rule_system"))
    kept = [c for c in rows.columns if c not in ("action", "system", "confidence", "expected_output")]
    return rows.select(*kept, action.alias("action"), F.trim(text_of(F.col("expected_output"))).alias("expected_output"), F.when(over, F.col("rule_system")).otherwise(first).alias("system"), F.when(over & (sure == "high"), "medium").otherwise(sure).alias("confidence"))


def keyed(steps: DataFrame) -> DataFrame:
    """All steps, repaired, with the key by which they are told apart (null for those that ``repaired`` leaves out) and generic."""
    rows = with_repairs(steps.withColumn("told", told()))
    words = F.col("words") if "words" in steps.columns else F.concat_ws("|", word_norm(F.col("action")), word_norm(F.col("expected_output")))
    rows = rows.withColumn("words", words).withColumn("key", F.when(F.col("told"), F.concat_ws("|", "system", "words")))
    return rows.drop("told").withColumn("generic", F.replace("words", F.lit("|"), F.lit(" ")).isin(
        "review the visible process screen the relevant process information is available on screen", "review the visible process screen the expected screen is displayed")).drop("words")


def validated(steps: DataFrame, most: int = 40) -> DataFrame:
    """job_id, step_number, source_number: repaired steps without those that repeat the last kept one, see ``told_once``."""
    got = told_once(steps, most)
    return got.select("job_id", F.posexplode("state").alias("i", "x")).select("job_id", (F.col("i") + 1).alias("step_number"), F.col("x.number").alias("source_number"))


def validated_steps(steps: DataFrame, most: int = 40) -> DataFrame:
    """The repaired steps that ``validated`` keeps, renumbered; they come out of the fold, so nothing is joined."""
    own = [c for c in steps.columns if c not in ("job_id", "step_number", "words")]
    got = told_once(steps, most, tuple(own)).withColumn("numbers", F.col("state.number"))
    kept = got.select("job_id", F.posexplode(F.filter("rows", lambda x: F.array_contains("numbers", x["step_number"]))).alias("i", "x"))
    return kept.select("job_id", *[F.col(f"x.{c}").alias(c) for c in own], (F.col("i") + 1).alias("step_number"))


def told_once(steps: DataFrame, most: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """job_id, state, rows: a job's repaired steps with the columns to keep, and as state those that don't repeat the last kept one.

    Equal system and wording, the same screen state or screenshot (a column that may be missing), and within one
    event or 12 units of time; without any state or screenshot the latter alone counts, for the generic review
    the former. The event is source_event_index where there is such a column, else the number."""
    for name, of in (("screenshot", F.lit(None).cast("string")), ("source_event_index", F.col("step_number"))):
        steps = steps if name in steps.columns else steps.withColumn(name, of)
    rows = keyed(steps).where("key is not null").withColumn("shot", F.nullif(F.col("screenshot"), F.lit("")))
    rows = rows.withColumn("event", F.col("source_event_index").cast("int"))

    def step(kept, x):
        last = F.try_element_at(kept, F.lit(-1))
        sure = lambda c: F.coalesce(c, F.lit(False))
        close = sure(F.abs(x["event"] - last["event"]) <= 1) | sure(F.abs(x["time_sec"] - last["time_sec"]) <= 12)
        there = sure(x["screen_state_id"] == last["state"]) | sure(x["shot"] == last["shot"])
        keyless = F.coalesce(x["screen_state_id"].cast("string"), last["state"].cast("string"), x["shot"], last["shot"]).isNull()
        repeat = (x["key"] == last["key"]) & F.when(x["generic"], there).when(keyless, close).otherwise(there & close)
        entry = F.struct(x["step_number"].alias("number"), x["event"].alias("event"), x["shot"].alias("shot"), x["time_sec"].alias("time_sec"), x["key"].alias("key"), x["screen_state_id"].alias("state"))
        return F.when((F.size(kept) >= most) | ((F.size(kept) > 0) & F.coalesce(repeat, F.lit(False))), kept).otherwise(F.array_append(kept, entry))

    start = F.array().cast("array<struct<number:int,event:int,shot:string,time_sec:double,key:string,state:int>>")
    return fold(rows, ["step_number", "event", "shot", "time_sec", "key", "screen_state_id", "generic", *keep], ["step_number"], start, step)


def updated(steps: DataFrame, updates: DataFrame) -> DataFrame:
    """Steps with the last update (by pos) for their number, where there is one: action and confidence replaced."""
    last = updates.groupBy("job_id", "step_number").agg(F.max_by(F.struct("action", "confidence"), "pos").alias("u"))
    rows = steps.join(last, ["job_id", "step_number"], "left")
    return rows.select("job_id", "step_number", F.coalesce("u.action", "action").alias("action"), F.coalesce("u.confidence", "confidence").alias("confidence"))
