"""A table's rows as a stream again: in micro-batches, shuffled, some of them late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ordered import settled, work_dir
from tracewright.streaming.folds import keyed_state

ROWS_A_FILE = 100_000
FAR = 3_650  # days after the last row, when a last one ends all recordings


def arrivals(rows: DataFrame, batches: int, late_hours: float) -> DataFrame:
    """``rows`` (ts, event_id) with ``batch`` from 0: rows arrive up to ``late_hours`` after they happened, by a hash of event_id."""
    delay = F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000 * late_hours * 3600
    arrived = F.unix_micros("ts") / 1e6 + delay
    low, high = rows.select(F.min(arrived), F.max(arrived)).first()
    share = (arrived - F.lit(low)) / F.lit(max(high - low, 1e-9)) if low is not None else F.lit(0.0)
    return rows.withColumn("batch", F.least(F.lit(batches - 1), F.floor(share * batches)).cast("int"))


def sent(rows: DataFrame, root: str, batches: int, files: int) -> int:
    """Writes each batch of ``arrivals`` to a folder of its own, as so many files each; the number of these.

    A micro-batch takes a fixed number of files, so where a batch is too small for them, all are written as one file each."""
    for n in dict.fromkeys((files, 1)):
        for i in range(batches):
            rows.where(F.col("batch") == i).drop("batch").repartition(n).sortWithinPartitions(F.xxhash64("event_id")).write.mode("overwrite").parquet(f"{root}/in/{i:04d}")
        if n == 1 or all(len(rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/in/{i:04d}").inputFiles()) == n for i in range(batches)):
            return n


def replayed(rows: DataFrame, through: Callable[[DataFrame], DataFrame], batches: int = 6, late_hours: float = 4.0, partitions: int | None = None) -> DataFrame:
    """What the stream operator ``through`` gives for ``rows`` (job_id, ts, event_id, ...), sent batch by batch.

    The rows are computed once; they, the batches' files (of ``ROWS_A_FILE`` rows), the checkpoint and the results are in new
    shared folders. At the end a row of job -1 far in the future ends all recordings; a stream that goes on needs none.
    ``partitions`` state stores keep the state, by default one for each core, 8 at least."""
    rows = settled(rows)
    spark, root = rows.sparkSession, work_dir(rows.sparkSession)
    partitions = partitions or max(8, spark.sparkContext.defaultParallelism)
    files = sent(arrivals(rows, batches, late_hours), root, batches, -(-rows.count() // (batches * ROWS_A_FILE)) or 1)
    end = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.make_dt_interval(F.lit(FAR))).alias("ts"), F.lit(-1).cast("long").alias("job_id"), F.lit(-1).cast("long").alias("event_id"))
    end = rows.limit(0).unionByName(end.select(*(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in end.columns)), allowMissingColumns=True)
    end.coalesce(1).write.parquet(f"{root}/in/{batches:04d}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in/*")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with keyed_state(spark):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            query = through(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.parquet(f"{root}/out").where("job_id >= 0")
