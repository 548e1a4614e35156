"""Ordered-event operators on small tables and against DuckDB on the smallest scale."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright import queries as core
from tracewright.functions import text
from tracewright.operators import boundaries, cleanup, jobs, ordered, screens, steps

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return v if isinstance(v, (str, bool)) else int(v) if float(v) == int(v) else round(float(v), 6)

    return sorted((tuple(plain(v) for v in r) for r in frame), key=str)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = core.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(core.oracle_sql()[name])
    at = [x[0] for x in want.description]
    assert sorted(at) == columns
    order = [at.index(c) for c in columns]
    assert rows_of(tuple(r) for r in got.select(columns).collect()) == rows_of(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def frames(spark, scores, gap=1.0):
    return spark.createDataFrame([(1, i, i * gap, float(s), 0.0) for i, s in enumerate(scores)], "job_id int, ord int, time_sec double, boundary_score double, visual_score double")


def test_threshold_and_candidates(spark):
    f = frames(spark, [0, 0.01, 0.02, 0.5, 0.02, 0.55])
    assert boundaries.thresholds(f).first()["threshold"] > 0.02
    assert {3, 5} & {r.ord for r in boundaries.boundary_candidates(f).collect()}
    assert boundaries.thresholds(frames(spark, [0.1])).first()["threshold"] == 1.0


def test_narrow_scores(spark):
    """Scores within 0.03: the threshold is the 94th percentile, the percentile that is reported stays the 88th."""
    scores = [0.0] + [0.02 + 0.0001 * i for i in range(60)]
    got = boundaries.thresholds(frames(spark, scores)).first()
    rest = sorted(scores[1:])
    at = lambda q: rest[int(q * 59)] + (q * 59 % 1) * (rest[int(q * 59) + 1] - rest[int(q * 59)])
    assert (got["percentile"], got["threshold"]) == pytest.approx((at(0.88), at(0.94)), abs=1e-12)


def test_short_recordings(spark):
    """Boundaries two apart: both stay in a recording under 20, one in a longer one."""
    scores = [0.0, 0.0, 0.5, 0.0, 0.6, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.ord for r in boundaries.boundary_candidates(frames(spark, scores)).orderBy("ord").collect()] == [2, 4]
    assert [r.ord for r in boundaries.boundary_candidates(frames(spark, scores + [0.0] * 11)).orderBy("ord").collect()] == [4]


def test_blank_screens(spark):
    """Only screens without any text are kept apart; two that read ok are one state."""
    rows = [(1, i, "Other", t, "00", 0.5) for i, t in enumerate(["ok", "ok", "", " "])] + [(2, 0, "Other", "", "00", 0.5), (2, 1, "Other", " ", "00", 0.5)]
    got = screens.screen_states(spark.createDataFrame(rows, "job_id int, ord int, system string, ocr_text string, hash string, boundary_score double"))
    assert [r.screen_state_id for r in got.orderBy("job_id", "ord").collect()] == [1, 1, 1, 1, 1, 2]


def test_nearby_duplicates(spark):
    """Equal steps a second apart: one stays without any evidence key, with one state or with one screenshot."""
    schema = "job_id int, step_number int, time_sec double, system string, rule_system string, action string, expected_output string, confidence string, screen_state_id int, screenshot string"
    for left, right, kept in [((None, None), (None, None), 1), ((1, None), (1, None), 1), ((1, "a"), (2, "a"), 1), ((1, "a"), (2, "b"), 2), ((None, "a"), (None, None), 2)]:
        rows = [(1, n, float(n), "SAP", "SAP", "Save the invoice.", "It is saved.", "high", *key) for n, key in ((1, left), (2, right))]
        assert steps.validated(spark.createDataFrame(rows, schema)).count() == kept


def test_own_profiles(spark):
    own = spark.createDataFrame([("Mine", 1), ("Showcase fast", 2)], "profile string, batch int")
    rows = spark.createDataFrame([(1, "Mine"), (2, "Balanced"), (3, None)], "id int, profile string")
    assert {r.id: r.batch for r in jobs.with_profile(rows, own).collect()} == {1: 1, 2: 2, 3: 2}


def test_artifacts(spark, tmp_path):
    made = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "job_id long, action string")
    jobs.write_artifacts({"steps": made}, f"file://{tmp_path}/out")
    got = {(r.job_id, r.name): r.n for r in jobs.artifact_counts(spark, f"file://{tmp_path}/out", ["steps", "report"]).collect()}
    assert got == {(1, "steps"): 2, (2, "steps"): 1, (None, "report"): None}


def test_forced_split(spark):
    f = frames(spark, [0.0] * 13, 10.0)
    spans = boundaries.spans(f, f.limit(0).select("job_id", "ord"))
    parts = boundaries.split_long(spans, f, 30.0).collect()
    assert len(parts) >= 4 and all(p.forced for p in parts) and max(p.end_ord - p.start_ord for p in parts) <= 4


def test_texts(spark):
    df = spark.createDataFrame([("File\n10:32 AM\nInvoice total\nInvoice total\nab", "saved created opening uses", None)], "a string, b string, c string")
    r = df.select(text.clean_lines(F.col("a")).alias("a"), text.action_roots(F.col("b")).alias("b"), text.clean_lines(F.col("c")).alias("c"), text.redacted(F.lit("Click 123456 and Type $4.50")).alias("d")).first()
    assert r.a == "Invoice total" and r.b == ["sav", "create", "open", "uses"] and r.c == "" and r.d == "Select the visible value and Enter the visible value"
    near = spark.sql("SELECT 'alpha beta gamma' a, 'alpha beta gamma delta' b, '' e")
    j = near.select(text.jaccard(text.tokens(F.col("a")), text.tokens(F.col("b")), 1.0), text.jaccard(text.tokens(F.col("e")), text.tokens(F.col("e")), 1.0), text.hash_distance(F.lit("zz"), F.lit("00")), text.hash_distance(F.lit("ff"), F.lit("0f"))).first()
    assert tuple(j) == (0.75, 1.0, 64, 4)


def test_systems(spark):
    got = [spark.range(1).select(text.system_of(F.lit(t))).first()[0] for t in ("SAP vendor posting", "Excel worksheet", "Outlook inbox", "slack huddle", "nothing", None)]
    assert got == ["SAP", "Excel", "Email", "Slack/Teams", "Other", "Other"]


def step_rows(spark, rows):
    return spark.createDataFrame([(1, i + 1, float(t), s, s, a, e, c, i % 3 + 1) for i, (t, s, a, e, c) in enumerate(rows)], "job_id int, step_number int, time_sec double, system string, rule_system string, action string, expected_output string, confidence string, screen_state_id int")


def test_steps(spark):
    same = ("Excel", "Review the visible process screen.", "The expected screen is displayed.", "high")
    kept = steps.validated(step_rows(spark, [(15 * i, *same) for i in range(35)])).count()
    assert kept == 35
    risky = steps.verified_offline(steps.risk_flags(step_rows(spark, [(0, "SAP", "Click document 190001.", "", "high")]))).first()
    assert risky.risky and risky.confidence == "medium" and "190001" not in risky.action
    late = step_rows(spark, [(20, "SAP", "Open it.", "", "high"), (10, "SAP", "Save it.", "", "high")])
    assert cleanup.chronology(late).count() == 1
    assert [r.original for r in cleanup.in_time(late).orderBy("step_number").collect()] == [2, 1]


def test_pairs(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate([True, True, True, False, True, False])], "job_id int, ord int, edge boolean")
    assert [r.ord for r in ordered.paired(df, F.col("edge")).where("first").orderBy("ord").collect()] == [0, 2, 4]
    two = step_rows(spark, [(0, "Browser", "Update the status field.", "The status is changed.", "high"), (8, "Browser", "Update the status field now.", "The status is changed.", "high"), (70, "Browser", "Submit the change.", "Saved.", "high")])
    assert [(r.left_number, r.right_number) for r in cleanup.merged_pairs(two).collect()] == [(1, 2)]


def test_scroll(spark):
    rows = [(1, 0, 0.0, "SAP", 1, "vendor list page number one of many", 0.0, 0.05), (1, 1, 1.0, "SAP", 1, "vendor list page number one of many more", 0.0, 0.05), (1, 2, 2.0, "Excel", 1, "", 0.0, 0.05)]
    df = spark.createDataFrame(rows, "job_id int, ord int, time_sec double, system string, screen_state_id int, ocr_text string, visual_score double, boundary_score double")
    got = screens.scroll_collapse(df).orderBy("event_id").collect()
    assert [(r.ord, r.frame_count) for r in got] == [(0, 2), (2, 1)] and got[0].ocr_text.endswith("more")


def test_cost(spark):
    got = {r.profile: (r.calls, r.images, r.input_tokens, r.output_tokens, r.usd) for r in jobs.cost_estimate(jobs.profiles(spark)).collect()}
    assert got == {"Showcase fast": (4, 44, 15260, 3240, 0.1735), "Balanced": (6, 148, 25900, 3600, 0.2375), "Lowest cost": (4, 40, 13160, 2520, 0.1414), "Highest accuracy": (8, 199, 34015, 3600, 0.2781)}


def test_streams(spark, tmp_path):
    from tracewright.streaming import live

    source = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    q = live.activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("activity").collect())) == sorted(map(str, live.activity(source).collect()))


def info_rows(spark, n_events, **other):
    base = {"job_id": 1, "n_events": n_events, "justification": "", "mode": "local_ocr_draft", "model_ready": False, "calls": 0, "succeeded": 0, "ocr_count": 5, "duration": 100.0, "target_density": 3.0} | other
    kinds = "job_id int, n_events long, justification string, mode string, model_ready boolean, calls int, succeeded int, ocr_count int, duration double, target_density double"
    return spark.createDataFrame([tuple(base[k.split()[0]] for k in kinds.split(", "))], kinds)


def report_of(spark, rows, info):
    from tracewright.operators import procedure

    rows = rows.withColumns({"generation_source": F.lit("local_ocr"), "duration": F.lit(1.0)})
    return procedure.quality_report(procedure.clean_steps(rows, info), info, cleanup.chronology(rows)).first()


def test_reports(spark):
    # Distinct operations, no two of which are one.
    words = [("Open the ledger", "It is displayed"), ("Select vendor alpha", "Alpha is chosen"), ("Enter net price", "Price accepted"), ("Filter for region", "Fewer rows"), ("Export everything", "Done"), ("Submit all", "Sent"), ("Approve batch", "Approved"), ("Delete draft", "Gone"), ("Rename sheet", "Renamed")]
    good = step_rows(spark, [(100 * i, "Browser", a + ".", e + ".", "high") for i, (a, e) in enumerate(words)])
    r = report_of(spark, good, info_rows(spark, 9))
    assert (r.steps, r.score, r.readiness, r.blockers) == (9, 100, "demo_ready", "")
    r = report_of(spark, good, info_rows(spark, 35))
    assert r.readiness == "not_ready" and "coverage" in r.blockers and r.ratio < 0.6
    r = report_of(spark, good, info_rows(spark, 9, model_ready=True, calls=2))
    assert r.blockers == "model failed" and r.readiness != "demo_ready"
    only = step_rows(spark, [(0, "Other", "Review the visible process screen.", "The screen is visible.", "high")])
    r = report_of(spark, only, info_rows(spark, 1))
    assert (r.steps, r.score, r.readiness) == (0, 0, "not_ready")
    none = report_of(spark, good.limit(0), info_rows(spark, 0))
    assert (none.steps, none.score) == (0, 0)


def test_pivot_merge(spark):
    from tracewright.operators import procedure

    rows = step_rows(spark, [(0, "Excel", "Complete the PivotTable setup.", "A blank sheet.", "high"), (5, "Excel", "Create a new PivotTable.", "The sheet is ready.", "high"), (9, "Excel", None, None, "low")])
    rows = rows.withColumns({"generation_source": F.lit("local_ocr"), "duration": F.lit(1.0)})
    got = procedure.clean_steps(rows, info_rows(spark, 3)).orderBy("place").collect()
    assert got[0].sources == [1, 2] and got[0].step_number == 2 and got[0].action == procedure.SETUP_WORDING and got[0].phase == "Create PivotTable"
