"""Recordings as a source: equal to the grid made by expressions, pruned by filters, and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.sources import grid, recordings

DURATIONS = [0.0, 0.4, 1.0, 4.5, 9.0, 9.9, 10.0, 100.0, 123.4, 3_000.0, 3_825.1, 9_999.0]


def rows(df):
    return sorted((r.job_id, r.frame_id, round(r.time_sec, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    spark.dataSource.register(grid.Recordings)
    path = f"file://{tmp_path_factory.mktemp('recordings')}/in"
    rng = random.Random(5)
    made = [(i, d) for i, d in enumerate(DURATIONS)] + [(100 + i, rng.random() * 500) for i in range(60)] + [(500, None)]
    spark.createDataFrame(made, "job_id long, duration double").repartition(3).write.parquet(path)
    return path


def load(spark, path, **options):
    reader = spark.read.format("recording").option("path", path).option("interval", "4.5").option("most", "850")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


@pytest.mark.parametrize("size", [7, 1_000, 10**6])
def test_grid(spark, path, size):
    want = rows(recordings.sampling_grid(spark.read.parquet(path).where("duration is not null"), 4.5, 850))
    with grid.pushed(spark):
        assert rows(load(spark, path, slice=str(size), pushdown="true")) == want


def test_pruned(spark, path):
    want = recordings.sampling_grid(spark.read.parquet(path).where("duration is not null"), 4.5, 850)
    conditions = ["job_id = 10", "job_id in (3, 9, 777)", "time_sec < 9", "time_sec >= 3000 and time_sec < 3100", "time_sec > 9 and job_id in (5, 6, 7)", "time_sec > 9990", "time_sec <= 0", "job_id = 9 and frame_id > 600", "job_id = -1", "time_sec > 3820 and time_sec < 3826", "job_id > 140"]
    with grid.pushed(spark):
        whole = lambda: load(spark, path, slice="50", pushdown="true")
        for condition in conditions:
            assert rows(whole().where(condition)) == rows(want.where(condition)), condition
        parts = lambda df: df.rdd.getNumPartitions()
        assert parts(whole().where("job_id = 1")) == 1 < parts(whole())
        assert parts(whole().where("time_sec < 9")) < parts(whole()) // 5
    plain = load(spark, path, slice="50")
    assert all(rows(plain.where(c)) == rows(want.where(c)) for c in conditions[:2]) and rows(plain) == rows(want)
    assert grid.Grid({"slice": "10"}).slices([]) == []


def test_stream(spark, path, tmp_path):
    spark.dataSource.register(grid.Recordings)
    batches = [[(1, 10.0), (2, 3.0)], [(3, 70.5)], [], [(4, 0.0), (5, 44.0)]]
    for i, made in enumerate(batches):
        if made:
            one = spark.createDataFrame(made, "job_id long, duration double")
            one.toPandas().to_parquet(f"{tmp_path}/{i:03d}.parquet")
        stream = spark.readStream.format("recording").option("path", f"file://{tmp_path}").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").start()
        query.processAllAvailable()
        query.stop()
    want = recordings.sampling_grid(spark.createDataFrame([x for b in batches for x in b], "job_id long, duration double"), 4.5, 850)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(want)
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("job_id", "frame_id").count().where(F.col("count") > 1).count() == 0
