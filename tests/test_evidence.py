"""Evidence, job state, documents and pixels on small tables."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.functions import pixels
from tracewright.operators import evidence, jobs
from tracewright.plans import segments

EVENT = "job_id int, ord int, time_sec double, system string, text string, diff_score double"


def test_cluster(spark):
    rows = [(1, 0, 0.0, "SAP", "vendor list one two", 0.5), (1, 1, 1.0, "SAP", "vendor list one two", 0.5), (1, 2, 2.0, "SAP", "", 0.01), (1, 3, 3.0, "Excel", None, 0.01)]
    got = evidence.cluster_events(spark.createDataFrame(rows, EVENT)).orderBy("event_id").collect()
    assert [(r.ord, r.event_id, r.start_time, r.end_time) for r in got] == [(0, 1, 0.0, 3.0), (3, 2, 0.0, 3.0)]
    many = spark.createDataFrame([(1, i, float(i), f"S{i}", "", i / 10) for i in range(9)], EVENT)
    assert [r.ord for r in evidence.cluster_events(many, 4).orderBy("ord").collect()] == [0, 7, 8]
    assert evidence.cluster_events(many.limit(0)).count() == 0


def test_prune(spark):
    rows = [(1, 0, 0.0, "Other", "", 0.0), (1, 1, 1.0, "Other", "ok", 0.9), (1, 2, 2.0, "SAP", "open vendor invoice", 0.5), (1, 3, 3.0, "SAP", "open vendor invoice", 0.5), (1, 4, 4.0, "Other", "bye", 0.0)]
    got = evidence.prune_events(spark.createDataFrame(rows, EVENT)).orderBy("ord").collect()
    assert [r.ord for r in got] == [0, 2, 4]  # a toolbar and a repeated signature go, the ends stay
    assert {r.ord for r in evidence.prune_events(spark.createDataFrame(rows, EVENT), 2).collect()} == {0, 4}


def test_evidence(spark):
    kinds = "job_id int, segment int, stable_frame string, entry_frame string, after_frame string, image_hash string, boundary_score double, forced boolean"
    rows = [(1, 1, "a", "b", None, "ff", 0.31, False), (1, 2, "c", "a", "d", "ff", 0.01, False), (1, 3, "e", None, None, "ff", 0.01, True), (1, 4, "f", None, None, None, None, None)]
    df = spark.createDataFrame(rows, kinds)
    assert [r.path for r in evidence.pick_evidence(df, 9).orderBy("event_id").collect()] == ["a", "e", "f", "b"]
    assert [r.path for r in evidence.pick_evidence(df, 2).orderBy("event_id").collect()] == ["a", "e"]
    two = spark.createDataFrame([(1, 1, "a", None, None, "00", 0.01, False), (1, 2, "b", None, None, "00", 0.31, False)], kinds)
    assert evidence.pick_evidence(two, 9).count() == 2


def test_strides_and_frames(spark):
    df = spark.createDataFrame([(1, i) for i in range(20)], "job_id int, ord int")
    assert sorted(r.ord for r in evidence.strided(df, 6).collect()) == [0, 3, 6, 9, 12, 19]
    assert evidence.strided(df, 20).count() == 20
    f = spark.createDataFrame([(1, i, i * 5.0, 0.0, f"{i * 77777:x}") for i in range(40)], "job_id int, ord int, time_sec double, diff_score double, image_hash string")
    got = {r.ord: r.reason for r in evidence.representative_frames(f, 6).collect()}
    assert len(got) <= 6 and got[0] == "first" and got[39] == "last"
    assert {r.reason for r in evidence.representative_frames(f, 40).collect()} == {"all"}


def test_merges_and_roles(spark):
    df = spark.createDataFrame([(1, i, i, i + 1, float(i), i + 0.5, 1) for i in (1, 2, 3)], "job_id int, segment int, start_ord int, end_ord int, start_time double, end_time double, frame_count int")
    said = spark.createDataFrame([(1, 1, "merge"), (1, 3, "merge"), (1, 2, "keep")], "job_id int, segment int, decision string")
    got = evidence.apply_merges(df, said).orderBy("event_id").collect()
    assert [(r.start_ord, r.end_ord, r.merged) for r in got] == [(1, 2, 0), (2, 4, 1)]
    read = spark.createDataFrame([(1, 1, 0, "stable_frame", "", 0.5), (1, 1, 1, "entry_frame", None, None), (1, 2, 0, "stable_frame", "a dialog with words", 0.1), (1, 2, 1, "after_frame", "", 0.9)], "job_id int, segment int, pos int, role string, text string, structure double")
    assert [r.role for r in evidence.role_scores(read).orderBy("segment").collect()] == ["stable_frame", "after_frame"]


def test_job_state(spark):
    log = spark.createDataFrame([(1, 1, 1, "queued", '{"a": 3, "b": 7}'), (1, 2, 2, None, None), (1, 3, 3, "done", None), (2, 1, 4, "queued", "{bad")], "id int, updated long, seq int, status string, meta string")
    state = jobs.job_state(log, ["status", "meta"])
    assert {r.id: (r.status, r.updated) for r in state.collect()} == {1: ("done", 3), 2: ("queued", 1)}
    assert [(r.id, r.stage, r.seconds) for r in jobs.slowest_stage(state, "meta").collect()] == [(1, "b", 7.0)]
    row = lambda *x: jobs.capabilities(spark.createDataFrame([(1, *x)], "id int, key string, disabled string, ocr_available boolean, ocr_count int")).first()
    assert row("k", None, False, 0).mode == "production_vision" and row("k", "on", True, 0).mode == "local_ocr_draft" and row("replace_me", None, False, 0).mode_after_text == "diagnostic_only"


def brute_ssim(a, b):
    k = np.exp(-((np.arange(7) - 3) ** 2) / 4.5)
    k = np.outer(k, k) / k.sum() ** 2
    a, b, out = np.pad(a, 3, mode="reflect"), np.pad(b, 3, mode="reflect"), []
    for i in range(8):
        for j in range(8):
            x, y = a[i : i + 7, j : j + 7], b[i : i + 7, j : j + 7]
            mx, my = (k * x).sum(), (k * y).sum()
            vx, vy, xy = (k * x * x).sum() - mx * mx, (k * y * y).sum() - my * my, (k * x * y).sum() - mx * my
            out.append((2 * mx * my + 6.5025) * (2 * xy + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)))
    return float(np.mean(out))


def test_pixels(spark):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 256, (2, 64))
    rows = [(1, a.tolist(), b.tolist()), (2, a.tolist(), a.tolist()), (3, None, a.tolist()), (4, [1], [2])]
    df = pixels.ssim(spark.createDataFrame(rows, "id int, before array<int>, after array<int>"), 8, 8)
    got = {x.id: (x.ssim, x.d) for x in df.withColumn("d", pixels.diff_score(F.col("before"), F.col("after"))).collect()}
    assert abs(got[1][0] - brute_ssim(a.reshape(8, 8).astype(float), b.reshape(8, 8).astype(float))) < 1e-9 and abs(got[2][0] - 1) < 1e-9
    assert got[3] == (None, 0.0) and got[4][0] is None and abs(got[1][1] - np.abs(a - b).mean() / 255) < 1e-9


def test_segment_plan(spark):
    shown = ["SAP vendor invoice list", "Excel workbook pivot column formula", "Outlook inbox reply"]
    rows = [(1, i, i * 5.0, 0.5 if i in (4, 8) else 0.0, 0.5 if i in (4, 8) else 0.0, shown[i // 4], f"{255 << (20 * (i // 4)):016x}") for i in range(12)]
    got = segments.segments_of(spark.createDataFrame(rows, "job_id int, ord int, time_sec double, boundary_score double, visual_score double, ocr_text string, hash string")).orderBy("event_id").collect()
    # The frame after a segment tells of it too, and Excel has five terms there.
    assert [r.system for r in got] == ["Excel", "Excel", "Email"] and len({r.screen_state_id for r in got}) == 3
