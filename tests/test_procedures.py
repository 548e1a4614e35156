"""Whole procedures, many jobs at once: what is kept, merged, removed, how it is ordered and what the report says."""

import pytest

from tracewright.operators import cleanup, procedure

STEP = "job_id int, step_number int, time_sec double, start_time double, source_event_index int, system string, action string, expected_output string, confidence string, generation_source string, duration double, ocr_text string"
INFO = "job_id int, n_events long, justification string, mode string, model_ready boolean, calls int, succeeded int, ocr_count int, duration double, target_density double"
SHOWN = "The expected screen is displayed."

# Own wording: a recording of a pivot workflow.
PIVOT = [
    "Open the quarterly sales data workbook in Excel.", "Review the sales data table on the first worksheet.", "Select the data range with its header row.", "Review the worksheet data.", "Start creating a table from the chosen range.",
    "Confirm the settings of the table.", "Start creating a PivotTable from this table.", "Confirm the PivotTable setup.", "Create a new PivotTable from this table.", "Review the PivotTable Fields pane.",
    "Add Product as a row field in the PivotTable.", "Add Sales Amount as a value field summarized by maximum.", "Change the Sales Amount calculation back to sum.", "Add Region as a column field in the PivotTable.", "Move Region from columns to rows.",
    "Add a second sales amount measure and display it as a percentage.", "Rename the percentage measure.", "Review the PivotTable Design tab.", "Insert a PivotChart.", "Remove the percentage series from the PivotChart.",
    "Open the dialog for slicers.", "Add a Region slicer.", "Apply the Region slicer to all regions in the list.", "Review the presenter outro screen.", "Review the presenter outro screen.",
]
BROWSER = ["Open the customer web app.", "Search for the customer record.", "Update the customer status field.", "Submit the changes.", "Validate that the confirmation message appears.", "Export the customer report.", "Review the presenter outro screen."]

# job: (system, rows of (number, action, options), what the run knows)
JOBS = {
    1: ("Excel", [(i, a, {}) for i, a in enumerate(PIVOT, 1)], {}),
    2: ("Excel", [(i, a, {}) for i, a in enumerate(PIVOT, 1)], {"n_events": 24}),
    3: ("Browser", [(i, a, {"start": 10.0 * i}) for i, a in enumerate(BROWSER, 1)], {}),
    4: ("Browser", [(1, BROWSER[3], {"start": 30.0}), (2, BROWSER[0], {"start": 0.0}), (3, BROWSER[1], {"start": 10.0})], {}),
    5: ("Browser", [(10, "Open the report page.", {"start": 0.0}), (20, "Open the report page.", {"start": 8.0}), (30, "Export the report.", {"start": 70.0})], {}),
    6: ("Browser", [(1, BROWSER[0], {}), (2, BROWSER[2], {}), (3, "Validate that the update appears on the record.", {}), (4, "Update the customer priority field.", {})], {}),
    7: ("Excel", [(1, "Open the workbook.", {}), (2, "Review the worksheet data.", {}), (3, "Review the PivotTable Fields pane.", {}), (4, "Review the visible process screen.", {}), (5, "Review the presenter outro screen.", {})], {}),
    8: ("Other", [(i, f"Review the process state shown at event {i}.", {"expected": f"Screen state {i} is visible for the next workflow action.", "confidence": "low", "source": "diagnostic_fallback"}) for i in range(1, 36)], {"n_events": 35, "mode": "diagnostic_only", "ocr_count": 0}),
    9: ("Browser", [(i, f"Complete operational action {i}.", {}) for i in range(1, 10)], {"n_events": 9, "mode": "production_vision", "model_ready": True, "calls": 1}),
    10: ("Browser", [(i, f"Complete operational action {i}.", {}) for i in range(1, 14)], {"n_events": 35}),
    11: ("Excel", [(1, "Open the sales data workbook.", {}), (2, "Create a PivotTable from the table.", {}), (3, "Rename the percentage measure.", {"shown": "Show Values As"}), (4, "Insert a PivotChart.", {}), (5, "Apply the Region slicer to one town.", {})], {"n_events": 8}),
    12: ("Browser", [(i, f"Update workflow record field {i}.", {"start": 25.0 * i}) for i in range(1, 18)], {"n_events": 21, "mode": "production_vision", "model_ready": True, "calls": 2, "succeeded": 2, "duration": 516.0}),
    13: ("SAP", [(1, "Confirm that the invoice status changed to Posted.", {}), (2, "Review the visible process screen.", {})], {}),
    14: ("Excel", [(1, "Open the Insert menu.", {}), (2, "Choose the PivotChart option.", {}), (3, "Confirm the PivotChart dialog settings.", {})], {"n_events": 3}),
    15: ("Excel", [(1, "Insert a PivotChart.", {}), (2, "Add a Region slicer.", {}), (3, "Apply the Region slicer to one town.", {})], {}),
}


@pytest.fixture(scope="module")
def results(spark):
    """(steps in order, numbers removed, report) of each job."""
    rows, info = [], []
    for j, (system, steps, known) in JOBS.items():
        rows += [(j, n, 5.0 * n, o.get("start"), n, system, a, o.get("expected", SHOWN), o.get("confidence", "high"), o.get("source"), 0.0, o.get("shown")) for n, a, o in steps]
        base = {"job_id": j, "n_events": 0, "justification": "", "mode": "", "model_ready": False, "calls": 0, "succeeded": 0, "ocr_count": 1, "duration": 0.0, "target_density": 3.0} | known
        info.append(tuple(base[k.split()[0]] for k in INFO.split(", ")))
    steps, info = spark.createDataFrame(rows, STEP), spark.createDataFrame(info, INFO)
    clean = procedure.clean_steps(steps, info).persist()
    reports = {r.job_id: r for r in procedure.quality_report(clean, info, cleanup.chronology(steps)).collect()}
    removed = procedure.removed_steps(steps, info).collect()
    kept = sorted(clean.collect(), key=lambda r: (r.job_id, r.place))
    yield {j: ([r for r in kept if r.job_id == j], sorted(r.step_number for r in removed if r.job_id == j), reports[j]) for j in JOBS}
    clean.unpersist()


def numbers(rows):
    return [list(r.sources) for r in rows]


@pytest.mark.parametrize("j", [1, 2])
def test_pivot_is_ready(results, j):
    rows, removed, report = results[j]
    assert removed == [4, 10, 18, 24, 25] and [8, 9] in numbers(rows) and len(rows) == 19
    assert (report.readiness, report.blockers, report.missing, report.phase_errors) == ("demo_ready", "", "", 0) and report.score >= 80
    phases = {r.phase for r in rows}
    assert {"Prepare source data", "Create Excel table", "Create PivotTable", "Configure PivotTable fields", "Add calculations and formatting", "Build chart and slicer", "Validate final output"} == phases


def test_plain_workflow(results):
    rows, removed, report = results[3]
    assert removed == [7] and numbers(rows) == [[i] for i in range(1, 7)] and report.violations == 0
    assert list(dict.fromkeys(r.phase for r in rows)) == ["Navigate to record", "Update fields", "Submit changes", "Validate result", "Export, save, or close process"]


def test_order(results):
    rows, _, report = results[4]
    assert numbers(rows) == [[2], [3], [1]] and report.violations == 1
    assert numbers(results[5][0]) == [[10, 20], [30]]
    assert [r.phase for r in results[6][0]] == ["Navigate to record", "Update fields", "Validate result", "Update fields"] and [r.section for r in results[6][0]] == [1, 2, 3, 4]


def test_guards(results):
    rows, removed, _ = results[7]
    assert removed == [5] and len(rows) >= 3  # over 40 % were at risk: only noise goes
    rows, removed, report = results[10]
    assert len(rows) == 13 and removed == [] and report.ratio < 0.6 and report.readiness != "demo_ready" and "under-coverage" in report.blockers
    assert results[13][1] == [2] and numbers(results[13][0]) == [[1]]
    assert numbers(results[14][0]) == [[1], [2], [3]]


def test_blockers(results):
    assert results[8][2].readiness == "not_ready" and results[8][2].diagnostic > 0 and "diagnostic mode" in results[8][2].blockers
    assert results[9][2].readiness != "demo_ready" and "model failed" in results[9][2].blockers
    assert results[11][2].missing == "percentage" and results[11][2].readiness != "demo_ready" and results[11][2].score <= 69
    assert results[12][2].density < 3.0 and results[12][2].score <= 79 and "density" in results[12][2].blockers


def test_phases_put_right(results):
    assert [r.phase for r in results[15][0]] == ["Build chart and slicer", "Build chart and slicer", "Validate final output"]
