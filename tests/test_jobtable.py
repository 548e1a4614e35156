"""The job table as a sink: replayed batches, broken attempts, order of changes, compaction."""

import random

import pytest

from tracewright.streaming import jobtable


def change(i, at, kind, **fields):
    return (i, at, at, kind, {k: None if v is None else str(v) for k, v in fields.items()})


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), jobtable.CHANGE)


def state(spark, root):
    return {r.id: r for r in jobtable.jobs(spark, root).collect()}


def test_upsert(spark, tmp_path):
    root = f"file://{tmp_path}/jobs"
    sink = jobtable.upsert(root)
    assert jobtable.jobs(spark, root).count() == 0
    jobtable.init(spark, root)
    jobtable.init(spark, root)
    assert jobtable.jobs(spark, root).count() == 0
    sink(batch(spark, change(1, 10, "create", input_path="a.mp4", color="red"), change(2, 11, "update", status="lost"), (None, 1, 1, "create", {}), (3, 5, 5, "create", None)), 0)
    sink(batch(spark, change(1, 20, "update", status="running", progress=0.5, error="x", color="red")), 1)
    got = state(spark, root)
    assert set(got) == {1, 3} and (got[1].status, got[1].progress, got[1].input_path, got[1].created, got[1].updated) == ("running", 0.5, "a.mp4", 10, 20)
    assert (got[3].status, got[3].message, got[3].meta) == ("queued", "Queued", {}) and "color" not in got[1].asDict()
    # Sent again, the batch changes nothing; a later one sets a field to nothing; an earlier change that comes late doesn't hold.
    sink(batch(spark, change(1, 99, "update", status="wrong")), 1)
    sink(batch(spark, change(1, 30, "update", error=None, meta_json='{"a": 1}'), change(1, 15, "update", status="early"), change(1, 31, "create", status="new")), 2)
    got = state(spark, root)[1]
    assert (got.status, got.error, got.meta, got.created, got.updated) == ("running", None, {"a": "1"}, 10, 30)
    # A create that comes late, but is earlier than an update that was lost, brings the update into force.
    sink(batch(spark, change(2, 1, "create")), 3)
    assert state(spark, root)[2].status == "lost"


def test_broken_attempt(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/jobs"
    sink = jobtable.upsert(root)

    def dies(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(jobtable, "mark", dies)
        with pytest.raises(RuntimeError):
            sink(batch(spark, change(1, 1, "create", status="half")), 0)
    assert jobtable.jobs(spark, root).count() == 0
    sink(batch(spark, change(1, 1, "create", status="whole")), 0)
    assert state(spark, root)[1].status == "whole"


def test_compact(spark, tmp_path):
    """Compaction changes nothing, whatever came before and comes after."""
    rng = random.Random(7)
    plain, packed = f"file://{tmp_path}/plain", f"file://{tmp_path}/packed"
    times = rng.sample(range(1000), 90)
    for n in range(5):
        rows = [change(rng.randrange(6), times.pop(), rng.choice(["create", "update", "update"]), **{f: rng.choice([None, 1, 2]) for f in rng.sample(["status", "error", "progress", "nothing"], rng.randrange(4))}) for _ in range(18)]
        for root in (plain, packed):
            jobtable.upsert(root)(batch(spark, *rows), n)
        if n % 2:
            jobtable.compact(spark, packed)
            assert len(jobtable.attempts(spark, packed)) == 1
        assert state(spark, plain) == state(spark, packed)
    jobtable.upsert(packed)(batch(spark, change(0, 5000, "update", status="again")), 2)  # a batch that compaction has covered
    assert state(spark, plain) == state(spark, packed)
