"""The paragraphs of each job's document, in order: a row for each, so a document may be of any length.

Columns: job_id, section, at, line (the order within a job), style, label (bold, before the text; null if none), text.
A job without steps has all sections but no steps. Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import text_of

# The headings of a document, in order.
HEADINGS = {
    "summary": "1. Summary", "prerequisites": "Prerequisites", "assumptions": "Assumptions", "warnings": "Evidence warnings", "steps": "2. Steps grouped by phases", "screenshots": "3. Screenshots per step",
    "confidence": "4. Confidence indicators", "checklist": "Low-confidence review checklist", "metadata": "Appendix: Job metadata", "quality": "Cleanup and quality report", "removed": "Removed steps", "merged": "Merged steps",
}
READINESS = {"demo_ready": "Demo-ready", "needs_review": "Needs manual review", "not_ready": "Not ready"}
MODES = {"production_vision": "Production SOP", "local_ocr_draft": "OCR draft", "diagnostic_only": "Diagnostic draft"}
FEW = 25  # steps below which a document says that it has few

# Own wording: what stands under headings that are the same for all jobs.
SAID = {
    "prerequisites": ["Access to every system that is shown.", "The rights to view, change, export or post the records concerned.", "A review of the steps below of which the evidence is not sure."],
    "assumptions": ["Only what was seen on the screen and read there is described.", "Values are put in general terms unless they name fields or business objects."],
    "screenshots": ["The frame that shows a step best is named with it."],
    "confidence": ["High: picture and text both show the step.", "Medium: the step is likely; its wording is general.", "Low: there is little to go by; look at the frame before you rely on the step."],
}
COUNTS = ["before", "steps", "n_events", "ratio", "merged", "operational", "generic", "diagnostic", "phase_errors", "violations", "long", "density", "coverage", "score", "readiness"]


def named(names: dict[str, str], x: Column, default: str) -> Column:
    return F.coalesce(*[F.when(x == key, name) for key, name in names.items()], F.lit(default))


def blocks(clean: DataFrame, report: DataFrame, removed: DataFrame, info: DataFrame, audience: str = "New employee", notes: str = "") -> DataFrame:
    """The paragraphs of all jobs in ``report``.

    ``clean``: cleaned steps with place, section, phase, sources and, where known, risky and evidence_ord; ``removed``: step_number and
    reason; ``info``: the mode of each job."""
    c, n = F.col, iter(range(100))
    jobs = report.join(info.select("job_id", "mode"), "job_id", "left")
    steps = clean.select("job_id", "place", "section", "phase", "system", "action", "expected_output", F.coalesce("confidence", F.lit("medium")).alias("confidence"), "sources", (F.coalesce(c("risky"), F.lit(False)) if "risky" in clean.columns else F.lit(False)).alias("risky"))
    out = []

    def add(rows: DataFrame, *lines: tuple, at: Column | None = None) -> None:
        """``lines``: (style, label, text[, condition]) for each row of ``rows``, as one section."""
        section = next(n)
        struct = lambda i, style, label, text, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(i).alias("line"), F.lit(style).alias("style"), F.lit(label).cast("string").alias("label"), text_of(text if isinstance(text, Column) else F.lit(text)).alias("text")))
        found = rows.select("job_id", F.lit(section).alias("section"), (F.lit(0) if at is None else at).cast("int").alias("at"), F.explode(F.array_compact(F.array(*[struct(i, *x) for i, x in enumerate(lines)]))).alias("x"))
        out.append(found.select("job_id", "section", "at", "x.*"))

    covered = F.concat(c("steps").cast("string"), F.lit(" steps from "), c("n_events").cast("string"), F.lit(" events"), F.when(c("ratio").isNotNull(), F.format_string(" (%.3f)", "ratio")).otherwise(""))
    summary = F.concat(F.lit("The procedure of a recorded screen. Kind: "), named(MODES, c("mode"), "SOP draft"), F.lit(". Readiness: "), named(READINESS, c("readiness"), "Needs manual review"), F.lit(". Coverage: "), covered, F.lit("."))
    add(jobs, ("Title", None, F.concat(F.lit("SOP: job "), c("job_id").cast("string"))), ("Heading1", None, HEADINGS["summary"]), ("Normal", None, summary), ("Normal", "Target audience", audience), ("Normal", "Department / system notes", notes, F.lit(notes != "")))
    for name in ("prerequisites", "assumptions"):
        add(jobs, ("Heading2", None, HEADINGS[name]), *[("Normal", None, t) for t in SAID[name]])
    few, blocked = c("steps") < FEW, c("blockers") != ""
    add(jobs, ("Heading2", None, HEADINGS["warnings"], few | blocked), ("Normal", None, F.concat(F.lit("Only "), c("steps").cast("string"), F.lit(" steps rest on evidence; none were made up.")), few), ("Normal", None, F.concat(F.lit("To settle: "), F.replace("blockers", F.lit(","), F.lit(", "))), blocked))

    add(jobs, ("Heading1", None, HEADINGS["steps"]))
    first = F.row_number().over(Window.partitionBy("job_id", "section").orderBy("place")) == 1
    kv = lambda label, text: ("Normal", label, text)
    add(
        steps.withColumn("first", first), ("Heading2", None, c("phase"), c("first")), ("Heading3", None, F.concat(F.lit("Step "), c("place").cast("string"))), kv("System", c("system")), kv("Action", c("action")), kv("Expected output", c("expected_output")),
        kv("Confidence", F.initcap("confidence")), ("Normal", "Review note", "Marked for a cautious review.", c("risky")), at=c("place"),
    )
    for name in ("screenshots", "confidence"):
        add(jobs, ("Heading1", None, HEADINGS[name]), *[("Normal", None, t) for t in SAID[name]])
    add(jobs, ("Heading1", None, HEADINGS["checklist"]), ("Normal", None, "All steps are of high confidence.", c("low") == 0))
    add(steps.where("confidence <> 'high'"), ("Normal", None, F.concat(F.lit("Step "), c("place").cast("string"), F.lit(": look at the frame and confirm the wording (confidence "), c("confidence"), F.lit(")."))), at=c("place"))
    add(jobs, ("Heading1", None, HEADINGS["metadata"]), kv("job", c("job_id").cast("string")), kv("mode", c("mode")), kv("events", c("n_events").cast("string")))
    add(jobs, ("Heading1", None, HEADINGS["quality"]), *[kv(x, F.coalesce(c(x).cast("string"), F.lit("unknown"))) for x in COUNTS])
    gone = removed.withColumn("head", F.row_number().over(Window.partitionBy("job_id").orderBy("step_number")) == 1)
    add(gone, ("Heading2", None, HEADINGS["removed"], c("head")), ("Normal", None, F.concat(F.lit("Step "), c("step_number").cast("string"), F.lit(": "), c("reason"))), at=c("step_number"))
    pairs = steps.where(F.size("sources") > 1).withColumn("head", F.row_number().over(Window.partitionBy("job_id").orderBy("place")) == 1)
    add(pairs, ("Heading2", None, HEADINGS["merged"], c("head")), ("Normal", None, F.concat(F.lit("Steps "), F.array_join(c("sources").cast("array<string>"), " and "), F.lit(": "), text_of(c("action")))), at=c("place"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows
