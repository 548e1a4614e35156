"""Relations of recorded work from ordinary event tables, and the sampling grid of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators.ordered import dealt

# Own wording: (system, action, expected, confidence), picked by an event's key.
STEPS = [
    ("SAP", "Open the transaction FB60 for the vendor.", "The SAP posting screen is displayed.", "high"),
    ("SAP", "Enter the invoice amount 1250.00 in the field.", "The amount field is updated.", "high"),
    ("SAP", "Save the document.", "The document number 190001 is posted.", "medium"),
    ("SAP", "Validate that the posting status changed.", "The status shows posted.", "high"),
    ("Excel", "Open the sales workbook.", "The worksheet is visible.", "high"),
    ("Excel", "Format the selected range as a table.", "The formatted Excel table appears.", "high"),
    ("Excel", "Review the worksheet data.", "The worksheet data is visible.", "medium"),
    ("Excel", "Insert a chart from the Insert tab.", "The chart updates.", "high"),
    ("Excel", "Export the summary to xlsx.", "The file is exported and listed.", "high"),
    ("Browser", "Click the customer record in the browser.", "The customer record is displayed.", "high"),
    ("Browser", "Update the status field of the customer record.", "The status field is changed.", "medium"),
    ("Browser", "Update the status field of the customer record now.", "The status field is changed.", "medium"),
    ("Browser", "Submit the change.", "The confirmation appears and the record is saved.", "high"),
    ("Browser", "Review the visible process screen.", "The screen is visible.", "low"),
    ("Email", "Reply to the approval email in Outlook.", "The reply is listed in sent items.", "medium"),
    ("Other", "Presenter outro screen.", "Subscribe on social media.", "low"),
    ("Other", "Search for the customer record.", "The search result is listed.", "medium"),
    ("PDF", "Download the pdf report.", "The report is available.", "high"),
    ("Other", "File", "", "low"),
    ("Other", "", "The expected screen is displayed.", "low"),
]

# Own wording: the steps of pivot workflows.
PIVOT_STEPS = [
    ("Excel", "Open the workbook with regional figures.", "The workbook is open.", "high"),
    ("Excel", "Select the data range.", "The selected range is highlighted.", "high"),
    ("Excel", "Format the range as a table.", "The table with headers is created.", "high"),
    ("Excel", "Open the Insert tab and choose PivotTable.", "The PivotTable dialog is displayed.", "high"),
    ("Excel", "Open the Insert tab.", "The ribbon changed.", "high"),
    ("Excel", "Complete the PivotTable setup.", "A blank PivotTable appears.", "high"),
    ("Excel", "Create a new PivotTable on its own sheet.", "The PivotTable is created.", "high"),
    ("Excel", "Add region to the rows area.", "Regions are listed.", "high"),
    ("Excel", "Select the sales amount field.", "The sales amount is shown.", "high"),
    ("Excel", "Rename the percentage column.", "The percentage has a new name.", "medium"),
    ("Excel", "Show values as a percentage.", "Shares are displayed.", "high"),
    ("Excel", "Insert a PivotChart.", "The PivotChart appears.", "high"),
    ("Excel", "Insert slicers for the region.", "The slicer appears.", "high"),
    ("Excel", "Apply the region slicer.", "The chart updates.", "high"),
    ("Excel", "Review the PivotTable summary.", "The totals are visible.", "medium"),
    ("Excel", "Review the PivotTable fields pane.", "The pane is visible.", "low"),
    ("Excel", "Review the visible process screen.", "The screen is visible.", "low"),
    ("Excel", "Verify the totals.", "The result shows all regions.", "high"),
    ("Excel", "Drag the entry to its place.", "The slicer appears.", "high"),
    ("Excel", "Confirm the choice.", "The table has its headers formatted.", "high"),
    ("Excel", "Apply the product filter.", "Fewer rows are listed.", "high"),
    ("Other", "Presenter outro screen.", "Subscribe on social media.", "low"),
]

# Own wording: what is read on screen at an event; some is empty on purpose.
TEXTS = [
    "SAP transaction FB60 vendor invoice posting", "Excel workbook pivot column formula", "", "Outlook inbox subject reply to vendor", "Chrome browser http www.example.com url",
    "Adobe pdf page 1 of 3", "Teams channel chat meeting", "File\nEdit\n10:32 AM\nInvoice total 200\nInvoice total 200\nok\nDelivery note", "filter criteria date range status", "export download xlsx csv",
    "update the priority field", "submit confirmation saved", "", "Excel sheet1 field measure pivottable", "open display search", "supplier invoice details", "nothing of note here", "exported file is ready",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_key() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with job_id, ord (from 0, by time and event_id) and time_sec (hours since the job's first event)."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events")
    events = dealt(events.select("event_id", "user_id", "event_type", "value", "ts", event_key().alias("k")), events.count(), "user_id")
    hours = F.round((at - F.min(at).over(Window.partitionBy("user_id"))) / 3.6e9, 6)
    return events.select(F.col("user_id").alias("job_id"), (F.row_number().over(order) - 1).alias("ord"), hours.alias("time_sec"), "event_id", "event_type", "value", "k")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, ord, time_sec, event_id, k, boundary_score, visual_score, diff_score."""
    score = F.round(F.col("value") / 500, 6)
    return ordered_events(spark, sf_dir).select("job_id", "ord", "time_sec", "event_id", "k", score.alias("boundary_score"), F.round(score / 3, 6).alias("visual_score"), (F.col("k") % 7 / 10).alias("diff_score"))


def pick(values: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.struct(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for v in values]), (key % len(values)) + 1)


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with ocr_text."""
    return frames(spark, sf_dir).withColumn("ocr_text", pick(TEXTS, F.col("k")))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, step_number, time_sec, k, system, rule_system, action, expected_output, confidence, screen_state_id.

    Every 17th key is out of order in time, every 11th names another system than the rules."""
    step = pick(STEPS, F.col("k"))
    late = F.when(F.col("k") % 17 == 0, F.greatest(F.lit(0.0), F.col("time_sec") - 50)).otherwise(F.col("time_sec"))
    return ordered_events(spark, sf_dir).select(
        "job_id", (F.col("ord") + 1).alias("step_number"), F.round(late, 6).alias("time_sec"), "k",
        F.when(F.col("k") % 11 == 0, "Unknown").otherwise(step["col1"]).alias("system"), step["col1"].alias("rule_system"),
        step["col2"].alias("action"), step["col3"].alias("expected_output"), step["col4"].alias("confidence"), (F.col("k") % 7 + 1).alias("screen_state_id"),
    )


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps as ``steps`` gives them, in odd jobs of pivot workflows, with generation_source, duration, end_time and
    ocr_text. Every 13th key has no time, some of them no event either."""
    i = F.when(F.col("job_id") % 2 == 0, F.col("k") % len(STEPS)).otherwise(len(STEPS) + F.col("k") % len(PIVOT_STEPS))
    step = pick([*STEPS, *PIVOT_STEPS], i)
    said = {"rule_system": step["col1"], "action": step["col2"], "expected_output": step["col3"], "confidence": step["col4"]}
    rows = steps(spark, sf_dir).withColumns(said).withColumn("system", F.col("rule_system"))
    source = F.when(F.col("k") % 29 == 0, "diagnostic_fallback").when(F.col("job_id") % 5 == 0, "local_ocr").otherwise("openai_vision")
    k = F.col("k")
    shown = F.when(k % 9 == 0, "Slicer settings").when(k % 10 == 0, "Percentage of total").when(k % 11 == 0, "PivotChart fields")
    rows = rows.withColumns({"generation_source": source, "duration": (k % 47).cast("double"), "ocr_text": shown, "source_event_index": F.when(k % 3 > 0, F.col("step_number"))})
    rows = rows.withColumn("time_sec", F.when(k % 13 > 0, F.col("time_sec")))
    return rows.withColumn("end_time", F.col("time_sec") + F.col("duration"))


def job_info(steps: DataFrame) -> DataFrame:
    """One row per job of ``steps``: what a run would have recorded about it, by key arithmetic."""
    j = F.col("job_id")
    rows = steps.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.max("time_sec").alias("duration"))
    mode = F.when(j % 3 == 0, "production_vision").when(j % 3 == 1, "local_ocr_draft").otherwise("diagnostic_only")
    return rows.select(
        "job_id", F.when(j % 4 == 0, F.col("n") * 2).when(j % 4 == 1, F.lit(0)).otherwise(F.col("n")).alias("n_events"), F.when(j % 7 == 0, "short training clip").otherwise("").alias("justification"),
        mode.alias("mode"), (j % 3 == 0).alias("model_ready"), F.when(j % 3 == 0, 3).otherwise(0).alias("calls"), F.when(j % 6 == 0, 2).otherwise(0).alias("succeeded"), F.when(j % 2 == 0, 5).otherwise(0).alias("ocr_count"),
        "duration", F.lit(3.0).alias("target_density"),
    )


def sampling_grid(recordings: DataFrame, interval: float, most: int) -> DataFrame:
    """job_id, frame_id, time_sec: sample times of recordings (job_id, duration), with the end if it would be missed."""
    n = F.least(F.lit(most), F.ceil(F.col("duration") / interval).cast("int"))
    times = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.least(F.col("duration"), i * F.lit(float(interval))))
    full = F.when(F.element_at(times, -1) < F.col("duration") - 1, F.array_append(times, F.col("duration"))).otherwise(times)
    return recordings.select("job_id", F.posexplode(full).alias("frame_id", "time_sec"))
