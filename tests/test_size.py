"""What only shows on many rows: rounding of rare values, tasks that stay small, tables computed once."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import jobs, ordered, stages
from tracewright.plans import report
from tracewright.streaming import folds, replay

SF = "/root/testdata/sf0.001"


def test_halves(spark):
    """Times and scores half-way between two decimals are rounded by their exact value, as printf does."""
    values = [0.05, 0.15, 0.25, 0.35, 200.25, 599.05, 1234567.75, 0.0, *(i * 0.05 for i in range(400)), *(i / 20 + 1000 for i in range(200))]
    rows = spark.createDataFrame([(i, 1, v, v, 3, v / 1000) for i, v in enumerate(values)], "job_id int, segment int, start_time double, end_time double, frame_count int, boundary_score double")
    want = [f"- 1: {v:.1f}-{v:.1f} s, 3 frames, score {v / 1000:.4f}" for v in values]
    assert [r.report for r in jobs.segment_report(rows).orderBy("job_id").collect()] == want
    known = {"event_id": "1", "system": "'SAP'", "screen_state_id": "2", "action_hint": "'save'"}
    found = rows.selectExpr("*", *[f"{v} AS {k}" for k, v in known.items()])
    about = rows.selectExpr("job_id", "4 AS n_frames", "1 AS n_candidates", "start_time AS threshold", "start_time AS median", "start_time AS mad")
    got = [r.report for r in jobs.segmentation_report(found, about).orderBy("job_id").collect()]
    assert all(f"{v:.1f}s-{v:.1f}s" in r and f"Median/MAD: {v:.4f} / {v:.4f}" in r for v, r in zip(values, got))


def test_tasks_grow(spark, monkeypatch):
    """The rows of jobs that a task gets don't grow with the table, from the events to the cleaned steps and between stages."""
    monkeypatch.setattr(ordered, "ROWS_A_TASK", 50)
    n = spark.read.parquet(f"{SF}/events.parquet").count() // 50
    assert n > 4 and report.cleaned(spark, SF).rdd.getNumPartitions() >= n
    assert ordered.dealt(spark.range(100).withColumnRenamed("id", "job_id")).rdd.getNumPartitions() == 4


def test_stages_are_dealt(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ordered, "ROWS_A_TASK", 50)
    seen = []
    plan = [stages.Stage("a", ("rows",), lambda rows: rows), stages.Stage("b", ("a",), lambda a: seen.append(a.rdd.getNumPartitions()) or a)]
    stages.run(f"file://{tmp_path}/run", {"rows": spark.range(1000).withColumnRenamed("id", "job_id")}, plan)
    assert seen == [20]


@pytest.mark.parametrize("files", [1, 3])
def test_replay_once(spark, monkeypatch, files):
    """Rows that are sent as a stream are computed once, whatever the number of batches and files."""
    monkeypatch.setattr(replay, "ROWS_A_FILE", -(-600 // (6 * files)))
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return float(x % 7)

    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 600_000_000)
    rows = spark.range(600).select((F.col("id") % 5).alias("job_id"), F.col("id").alias("event_id"), at.alias("ts"), counted("id").alias("boundary_score"))
    got = replay.replayed(rows, lambda s: folds.boundary_candidates(s, 20), partitions=2)
    assert {r.job_id for r in got.collect()} == set(range(5)) and made.value == 600
