"""Whole plans on small recordings: segments by a plain model, order without times, resumed runs, streams taken up again."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tracewright.operators import boundaries, cleanup, evidence, ordered, procedure, stages
from tracewright.plans import job, segments

FRAME = "job_id int, ord int, time_sec double, boundary_score double, visual_score double, ocr_text string, hash string, diff_score double, structure double"


def distance(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1") if a and b else 64


def model(frames, starts, most, longest, most_read):
    """Segments of one job's frames (dicts) by the rules, one after another."""
    cuts, parts = [0, *sorted(starts), len(frames)], []
    for a, b in zip(cuts, cuts[1:]):
        closing = frames[b]["boundary_score"] if b < len(frames) else 0.0
        lasts = frames[b - 1]["time_sec"] - frames[a]["time_sec"]
        inside = set()
        if lasts > longest:
            k = max(2, math.ceil(lasts / longest))
            inner = [f for f in frames[a + 1 : b - 1] if f["boundary_score"] >= 0.01]
            for i in range(1, k):
                target = frames[a]["time_sec"] + lasts * i / k
                at = min(inner, key=lambda f: (abs(f["time_sec"] - target), -f["boundary_score"], f["ord"]))["ord"] if inner else min(b - 1, max(a + 1, round(a + (b - a) * i / k)))
                inside |= {at} if a < at < b else set()
        edges = [a, *sorted(inside), b]
        parts += [(x, y, closing, len(edges) > 2) for x, y in zip(edges, edges[1:])]
    parts = sorted(sorted(parts, key=lambda p: (p[0] != 0, -frames[p[0]]["boundary_score"], p[0]))[:most])
    found = []
    for a, b, closing, forced in parts:
        stable = min(frames[a:b], key=lambda f: (f["visual_score"], -f["diff_score"], f["ord"]))
        found.append({"start_ord": a, "n": b - a, "closing": closing, "forced": forced, "stable_frame": stable, "entry_frame": frames[a], "after_frame": frames[b] if b < len(frames) else stable, "read": []})
    taken, hashes = set(), []
    for roles in (["stable_frame"], ["entry_frame", "after_frame"]):
        for s in found:
            for role in roles:
                f, h = s[role], s["stable_frame"]["hash"]
                weak = s["closing"] < 0.02 and not s["forced"] and any(distance(h, x) <= 2 for x in hashes)
                if f["ord"] in taken or weak or len(taken) >= most_read:
                    continue
                taken.add(f["ord"])
                hashes.append(h)
                s["read"].append((role, f["ocr_text"], f["structure"]))
    return found


def random_frames(rng, n, job):
    shown = ["SAP vendor invoice list", "Excel workbook pivot column formula", "", "Outlook inbox reply", "a dialog with options"]
    at, rows = 0.0, []
    for i in range(n):
        at += rng.choice([0.5, 1.0, 4.0, 30.0, 0.0])
        score = rng.choice([0.0, 0.005, 0.01, 0.02, 0.3, 0.5, 0.7])
        rows.append((job, i, at, score, rng.choice([0.0, 0.1, 0.2]), rng.choice(shown), f"{rng.choice([0, 1, 255, 2**40 - 1]):016x}", rng.choice([0.0, 0.5]), rng.choice([0.0, 0.4, 0.9])))
    return rows


def test_segments_by_model(spark):
    rng, names = random.Random(8), [c.split()[0] for c in FRAME.split(", ")]
    jobs = {j: random_frames(rng, rng.choice([1, 2, 5, 30, 80]), j) for j in range(14)}
    df = spark.createDataFrame([r for rows in jobs.values() for r in rows], FRAME)
    starts = {r.job_id: [x.ord for x in r.starts] for r in boundaries.boundary_starts(df, 9).collect()}
    got = segments.with_evidence(segments.initial_segments(df, 9, 20.0), 8).collect()
    for j, rows in jobs.items():
        want = model([dict(zip(names, r)) for r in rows], starts.get(j, []), 9, 20.0, 8)
        mine = sorted((r for r in got if r.job_id == j), key=lambda r: r.event_id)
        assert [(r.start_ord, r.frame_count, r.closing, r.forced, r.stable.ord, r.entry.ord, r.after.ord) for r in mine] == [
            (s["start_ord"], s["n"], s["closing"], s["forced"], *(s[f"{x}_frame"]["ord"] for x in ("stable", "entry", "after"))) for s in want]
        assert [r.ocr_text for r in mine] == ["\n".join(t for _, t, _ in s["read"] if t) for s in want]
        for r, s in zip(mine, want):
            assert r.evidence.role in [x[0] for x in s["read"]] if s["read"] else r.evidence.reason == "default stable frame"
            assert r.evidence_ord == s[r.evidence.role]["ord"]


@pytest.mark.parametrize("near", [False, True])
def test_neighbours_evidence(spark, near):
    """The frame after a segment, taken as the next one's own, doesn't tell of it; frames like known ones give no text."""
    text = ["Outlook inbox reply"] * 4 + ["Excel workbook pivot column formula"] + ["SAP vendor invoice list"] * 4
    score = [0.0, 0.0, 0.0, 0.0, 0.6, 0.5, 0.0, 0.0, 0.0]
    hashes = [f"{((2**20 - 1) << (20 * min(part, 1 if near else 2))) + part:016x}" for part in (0, 0, 0, 0, 1, 2, 2, 2, 2)]
    rows = [(1, i, i * 5.0, score[i], score[i], text[i], hashes[i], 0.0, 0.0) for i in range(9)]
    got = segments.segments_of(spark.createDataFrame(rows, FRAME)).orderBy("event_id").collect()
    assert [(r.start_time, r.system) for r in got][-1] == (25.0, "Other" if near else "SAP")


def test_reviewed(spark):
    """Boundaries near 0.16 may be decided, others not; a run of merged ones is one segment."""
    kinds = "job_id int, event_id int, ord int, start_time double, end_time double, frame_count int, ocr_text string, system string, screen_state_id int, boundary_score double"
    rows = [(1, i, 10 * i, float(i), i + 0.5, i, f"t{i}", "SAP", i, s) for i, s in enumerate([0.9, 0.15, 0.17, 0.8, 0.16], 1)] + [(2, 1, 0, 0.0, 1.0, 1, "", "SAP", 1, 0.16)]
    said = [(1, i, "merge") for i in (1, 2, 3, 4)] + [(1, 5, "keep"), (1, 2, "merge"), (2, 1, "merge"), (3, 2, "merge")]
    decisions = spark.createDataFrame(said, "job_id int, event_id int, decision string")
    got = segments.reviewed(spark.createDataFrame(rows, kinds), decisions, 3).orderBy("job_id", "event_id").collect()
    assert [(r.job_id, r.event_id, r.ord, r.start_time, r.end_time, r.frame_count, r.ocr_text) for r in got] == [(1, 1, 10, 1.0, 3.5, 6, "t1"), (1, 2, 40, 4.0, 4.5, 4, "t4"), (1, 3, 50, 5.0, 5.5, 5, "t5"), (2, 1, 0, 0.0, 1.0, 1, "")]


def test_sketches(spark):
    """Thresholds and states from sketches of days, merged, are within the error stated; a job's scores are never together."""
    n = 60_000
    f = spark.range(n).select((F.col("id") % 2).cast("int").alias("job_id"), F.floor(F.col("id") / 2).cast("int").alias("ord"), F.floor(F.col("id") / 2000).alias("day"), (F.pow(F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1e6, 3)).alias("boundary_score"))
    sketches = boundaries.score_sketches(f, ["job_id", "day"])
    assert sketches.count() == 60 and sketches.agg(F.max(F.octet_length("sketch"))).first()[0] < 40_000
    found = {r.job_id: r for r in boundaries.sketched_thresholds(f, "day").collect()}
    exact = {r.job_id: r for r in boundaries.thresholds(f).collect()}
    scores = {j: sorted(r[0] for r in f.where((F.col("job_id") == j) & (F.col("ord") > 0)).select("boundary_score").collect()) for j in found}
    import bisect

    for j, r in found.items():
        rank = lambda x: bisect.bisect(scores[j], x) / len(scores[j])  # noqa: B023, E731
        assert abs(rank(r.median) - 0.5) < 0.01 and abs(rank(r.percentile) - 0.88) < 0.01 and abs(r.mad - exact[j].mad) < 0.02 and abs(r.threshold - exact[j].threshold) < 0.06
    assert boundaries.sketched_thresholds(f.where("ord = 0"), "day").first().threshold == 1.0
    s = spark.range(20_000).select((F.col("id") % 2).cast("int").alias("job_id"), F.floor(F.col("id") / 500).alias("day"), F.pmod(F.xxhash64("id"), F.lit(3000)).cast("int").alias("screen_state_id"))
    true = {r.job_id: r.n for r in s.groupBy("job_id").agg(F.countDistinct("screen_state_id").alias("n")).collect()}
    assert all(abs(r.states - true[r.job_id]) < 0.06 * true[r.job_id] for r in cleanup.state_counts(s, "day").collect())


def test_roles(spark):
    read = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(role).alias("role"), F.lit(t).alias("text"), F.lit(s).alias("structure")) for i, (role, t, s) in enumerate([("stable_frame", "", 0.2), ("entry_frame", "", 0.9), ("after_frame", "", 0.9)])])
    got = spark.range(1).select(evidence.best_role(read).alias("x"), evidence.best_role(F.lit(None).cast("array<struct<pos:int,role:string,text:string,structure:double>>")).alias("y")).first()
    assert (got.x.role, got.x.structure, got.x.reason) == ("entry_frame", 0.9, "entry_frame showed the richest visible screen structure")
    assert (got.y.role, got.y.score) == ("stable_frame", 0.0)


def test_full_precision(spark):
    """Scores equal to the threshold reach it, however many digits they have."""
    rows = [(1, i, i * 5.0, 2 / 3 if i else 0.0, 0.0, "", "", 0.0, 0.0) for i in range(9)]
    got = boundaries.boundary_candidates(spark.createDataFrame(rows, FRAME), 20).collect()
    assert [r.reason for r in got] == ["adaptive-threshold"] * 8


def test_stable_tie(spark):
    f = spark.createDataFrame([(1, i, 0.1, [0.0, 0.3, 0.3][i]) for i in range(3)], "job_id int, ord int, visual_score double, diff_score double")
    parts = spark.createDataFrame([(1, 0, 3)], "job_id int, start_ord int, end_ord int")
    assert boundaries.stable_frames(parts, f).first().stable_ord == 1
    assert boundaries.stable_frames(parts, f.drop("diff_score")).first().stable_ord == 0


def test_long_recording(spark):
    """Two hundred thousand frames of one job, one long span: cut in time, not frame by frame against every target."""
    n = 200_000
    f = spark.range(n).select(F.lit(1).alias("job_id"), F.col("id").cast("int").alias("ord"), F.col("id").cast("double").alias("time_sec"), F.lit(0.02).alias("boundary_score"), F.lit(0.1).alias("visual_score"))
    spans = spark.createDataFrame([(1, 1, 0, n, 0.0, n - 1.0)], "job_id int, segment int, start_ord int, end_ord int, start_time double, end_time double")
    began = time.perf_counter()
    parts = boundaries.split_long(spans, f, 30.0)
    got = boundaries.stable_frames(parts, f).agg(F.count(F.lit(1)), F.countDistinct("stable_ord")).first()
    assert tuple(got) == (math.ceil((n - 1) / 30), math.ceil((n - 1) / 30)) and time.perf_counter() - began < 60


STEP = "job_id int, step_number int, time_sec double, source_event_index int, system string, action string, expected_output string, confidence string, generation_source string, duration double, ocr_text string, end_time double"


def step_table(spark, rows):
    return spark.createDataFrame([(1, i + 1, t, e, "Excel", a, x, "high", "local_ocr", 1.0, o, end) for i, (t, e, a, x, o, end) in enumerate(rows)], STEP)


def info_table(spark, n):
    return spark.createDataFrame([(1, n)], "job_id int, n_events long")


def test_rows_without_time(spark):
    """They come last, by their event, and before that they are out of order."""
    rows = step_table(spark, [(5.0, 1, "Open the ledger.", "", None, None), (None, 2, "Save the workbook.", "", None, None), (9.0, 3, "Export the report.", "", None, None), (None, None, "Enter the amount.", "", None, None)])
    assert [(r.step_number, r.prior_kind) for r in cleanup.chronology(rows).collect()] == [(3, 1)]
    assert [r.original for r in cleanup.in_time(rows).orderBy("step_number").collect()] == [1, 3, 2, 4]
    assert [r.step_number for r in procedure.clean_steps(rows, info_table(spark, 4)).orderBy("place").collect()] == [1, 3, 2, 4]


def test_near_by_ends(spark):
    """A long step that ends where the next one begins is near it."""
    said = ("Update the status field.", "The status is changed.")
    rows = [(0.0, 1, *said, None, 100.0), (30.0, 2, "Open the ledger.", "It is shown.", None, 31.0), (60.0, 3, "Export all.", "Done.", None, 61.0), (101.0, 4, "Update the status field now.", said[1], None, 102.0)]
    df = step_table(spark, rows).where("step_number in (1, 4)")
    assert cleanup.merged_pairs(df).count() == 1 and cleanup.merged_pairs(df.withColumn("end_time", F.lit(None).cast("double"))).count() == 0


def test_setup_result(spark):
    for first, second, want in (("", "", procedure.SETUP_RESULT), ("A blank sheet.", "", "A blank sheet."), ("A blank sheet.", "It is ready.", "It is ready.")):
        rows = step_table(spark, [(0.0, 1, "Complete the PivotTable setup.", first, None, None), (5.0, 2, "Create a new PivotTable.", second, None, None)])
        got = procedure.clean_steps(rows, info_table(spark, 2)).collect()
        assert [(r.action, r.expected_output) for r in got] == [(procedure.SETUP_WORDING, want)]


def test_shown_evidence(spark):
    """What is only shown asks for an action too, and a phrase may go on from one step to the next."""
    base = [(0.0, 1, "Create a new PivotTable.", "It is there.", None, None), (90.0, 5, "Enter the total.", "Entered.", "Slicer settings", None)]
    missing = lambda rows: procedure.completeness(procedure.clean_steps(step_table(spark, rows), info_table(spark, len(rows))), info_table(spark, len(rows))).first().missing
    assert missing(base) == "slicer"
    assert missing([*base, (200.0, 9, "Open the slicer and apply the", "", None, None), (300.0, 12, "Slicer for the east.", "", None, None)]) == ""


def run_frames(spark):
    rng = random.Random(3)
    return spark.createDataFrame([r for j in range(4) for r in random_frames(rng, 40, j)], FRAME)


def test_resume(spark, tmp_path):
    """A run broken at any stage and begun again reads what was whole, makes the rest, and ends as if nothing had happened."""
    frames, broken = run_frames(spark), {}

    def breaking(stage):
        def make(*tables):
            if broken.get("at") == stage.name:
                raise RuntimeError("lost")
            return stage.make(*tables)

        return stages.Stage(stage.name, stage.reads, make, stage.version)

    plan = [breaking(s) for s in job.STAGES]
    whole = {k: sorted(map(str, v.collect())) for k, v in stages.run(f"file://{tmp_path}/whole", {"frames": frames}, plan).items()}
    assert set(whole) == {s.name for s in job.STAGES} and whole["report"]
    root, seen = f"file://{tmp_path}/broken", {}
    for stage in plan[1:]:
        broken["at"] = stage.name
        with pytest.raises(stages.StageFailed) as failed:
            stages.run(root, {"frames": frames}, plan)
        assert failed.value.name == stage.name
        marks = {r.name: r.attempt for r in stages.manifest(spark, root).collect()}
        assert seen.items() <= marks.items() and stage.name not in marks
        seen = marks
    broken.clear()
    done = stages.run(root, {"frames": frames}, plan)
    assert {k: sorted(map(str, v.collect())) for k, v in done.items()} == whole
    assert seen.items() <= {r.name: r.attempt for r in stages.manifest(spark, root).collect()}.items()
    # Other rows are another run, in the same folder.
    other = stages.run(root, {"frames": frames.where("job_id < 2")}, plan[:3])
    assert {r.job_id for r in other["segments"].collect()} == {0, 1}


def test_fallback(spark, tmp_path):
    """After a failure the first events are written up and the log says so; without segments the failure is the caller's."""

    def fails(*tables):
        raise RuntimeError("lost")

    frames = run_frames(spark)
    plan = [stages.Stage(s.name, s.reads, fails if s.name == "steps" else s.make, s.version) for s in job.STAGES]
    done = job.run_jobs(frames, f"file://{tmp_path}/a", plan)
    log = {r.id: r for r in done["log"].where("status = 'complete'").collect()}
    assert set(log) == {0, 1, 2, 3} and all("fallback" in r.message and "steps" in r.error for r in log.values())
    assert done["report"].count() == 4 and all("after a failure" in r.document for r in done["document"].collect())
    with pytest.raises(stages.StageFailed):
        job.run_jobs(frames, f"file://{tmp_path}/b", [stages.Stage(s.name, s.reads, fails, s.version) for s in job.STAGES])
    good = job.run_jobs(frames, f"file://{tmp_path}/c")
    assert all(r.error is None for r in good["log"].collect()) and good["segmentation"].first().report.startswith("# Segmentation Report")


def test_failure_is_no_result(spark, tmp_path, monkeypatch):
    """A stage that fails fails the query; a fallback's report is never ready and says why in every row."""

    def fails(*tables):
        raise RuntimeError("lost")

    short = [stages.Stage(s.name, s.reads, fails if s.name == "steps" else s.make, s.version) for s in job.STAGES if s.name in ("starts", "parts", "segments", "jobs", "steps")]
    report = job.run_jobs(run_frames(spark), f"file://{tmp_path}", short)["report"].collect()
    assert len(report) == 4 and all(r.readiness == "not_ready" and r.blockers.startswith("first events only, after a failure") for r in report)
    monkeypatch.setattr(job, "STAGES", short)
    monkeypatch.setattr(job, "hashed_frames", lambda spark, sf_dir: run_frames(spark))
    with pytest.raises(stages.StageFailed, match="stage steps failed"):
        job.job_pipeline(spark, "")


def test_work_once(spark):
    """Starts are folded once, and steps are written, audited, verified and validated without another shuffle of their jobs."""
    frames = spark.createDataFrame([(1, i, i * 5.0, 0.5, 0.0, "", "", 0.0, 0.0) for i in range(9)], FRAME)
    assert boundaries.boundary_starts(frames)._jdf.queryExecution().optimizedPlan().toString().count("hysteresis-replace") == 1
    kinds = "job_id long, event_id int, start_time double, end_time double, boundary_score double, ocr_text string, screen_state_id int, system string"
    rows = [(j, i, i * 20.0, i * 20.0 + 5, 0.1 * i, ["SAP vendor invoice", "", "Excel pivot field", "export download"][i % 4], i % 3, ["SAP", "Other", "Excel", "Other"][i % 4]) for j in range(2) for i in range(1, 9)]
    segments_ = ordered.dealt(spark.createDataFrame(rows, kinds), 16)
    plain = job.job_steps(segments_)
    assert plain._jdf.queryExecution().sparkPlan().toString().count("Join") == 0 and plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    looked_up = job.job_steps(segments_, told=ordered.by_value)
    assert sorted(map(str, looked_up.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_by_value(spark, monkeypatch):
    """What a value tells is the same, row by row or looked up, with nulls, many values or long ones; no row is lost."""
    rows = spark.createDataFrame([(i, [None, "", "a", "b"][i % 4], "x" if i % 3 else None) for i in range(24)], "i int, a string, b string")
    make = lambda x: x.withColumn("said", F.concat_ws("-", F.coalesce("a", F.lit("none")), "b"))
    want = sorted(map(str, make(rows).collect()))
    for few, length in ((20_000, 8_000_000), (3, 8_000_000), (20_000, 5)):
        monkeypatch.setattr(ordered, "FEW_VALUES", few)
        monkeypatch.setattr(ordered, "FEW_BYTES", length)
        got = ordered.by_value(rows, ["a", "b"], make)
        assert sorted(map(str, got.collect())) == want and ("Join" in got._jdf.queryExecution().sparkPlan().toString()) == (few > 3 and length > 5)


def test_digest(spark):
    rows = spark.createDataFrame([(i, f"t{i % 3}") for i in range(20)], "a int, b string")
    same = stages.content_digest(rows.repartition(3).select("b", "a"))
    assert stages.content_digest(rows) == same != stages.content_digest(rows.limit(19)) and stages.content_digest(rows.limit(0)) != same


def test_stream_goes_on(spark, tmp_path):
    """A stream broken off and begun again from its checkpoint, with late and shuffled rows, ends as the batch does."""
    from tracewright.operators import screens
    from tracewright.streaming import folds

    rng = random.Random(6)
    text = ["SAP vendor list page one of many", "SAP vendor list page one of many more", "", "Excel sheet row", "Excel sheet row"]
    rows = [(j, i * 60 + j, i, rng.choice(text), rng.choice(["SAP", "Excel"]), rng.randrange(2), rng.choice([0.0, 0.005, 0.5]), 0.05) for j in range(3) for i in range(60)]
    kinds = "job_id long, event_id long, hour long, ocr_text string, system string, screen_state_id int, visual_score double, boundary_score double"
    df = spark.createDataFrame(rows, kinds).withColumn("ts", F.timestamp_seconds(F.col("hour") * 600 + 1_000_000_000)).drop("hour")
    by_time = df.withColumn("batch", F.floor((F.unix_seconds("ts") - 1_000_000_000 + F.pmod(F.xxhash64("event_id"), F.lit(7200))) / 14_500).cast("int"))
    last = df.limit(1).select(*[F.lit(-1).cast("long").alias(c) if c == "job_id" else F.timestamp_seconds(F.lit(1_100_000_000)).alias(c) if c == "ts" else F.col(c) for c in df.columns])
    for i in range(4):
        (by_time.where(F.col("batch") == i).drop("batch") if i < 3 else last).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
        with folds.keyed_state(spark):
            query = folds.scroll_collapse(stream, late="3 hours", idle_ms=folds.DAY_MS).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
            query.awaitTermination()
    assert by_time.agg(F.max("batch")).first()[0] == 2
    from pyspark.sql import Window

    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    first = F.min("ts").over(Window.partitionBy("job_id"))
    ordered = df.withColumns({"ord": F.row_number().over(order) - 1, "time_sec": F.round((F.unix_micros("ts") - F.unix_micros(first)) / 3.6e9, 6)})
    want = screens.scroll_collapse(ordered)
    got = spark.read.parquet(f"{tmp_path}/out").where("job_id >= 0").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
