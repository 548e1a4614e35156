"""Recordings as a source: their sampling grids, read in slices, with filters on job and time pushed down, and as a stream.

    spark.dataSource.register(Recordings)
    spark.read.format("recording").option("path", "file:///shared/recordings").option("interval", "4.5").load()

The path holds Parquet files of recordings (job_id, duration). A partition is about ``slice`` samples: a part of a long
recording, or many short ones. Filters on job_id reach the files, those on time_sec the grid, so recordings and slices
that can't match are no partitions at all; this needs the option pushdown and a setting, see ``pushed``. As a stream,
each micro-batch reads the files whose names come after those read before. The rows are those of
``recordings.sampling_grid``. Recordings without a duration have no samples.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# The source travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@contextmanager
def pushed(spark: SparkSession) -> Iterator[None]:
    """Tables loaded inside with the option pushdown get filters pushed down. Spark keeps with a loaded table what one query has pushed down to it, so
    load it anew for each query; without this, a table may be used many times and filters are applied behind it."""
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    try:
        yield
    finally:
        spark.conf.set(PUSHDOWN, before)


class Grid:
    """The sample times of a recording: every ``interval``, ``most`` at most, and its end if that would be missed."""

    def __init__(self, options: dict[str, str]):
        self.interval, self.most, self.slice = float(options.get("interval", 4.5)), int(options.get("most", 850)), int(options.get("slice", 100_000))

    def size(self, duration: float) -> int:
        n = max(1, min(self.most, math.ceil(duration / self.interval)))
        return n + (min(duration, (n - 1) * self.interval) < duration - 1)

    def times(self, duration: float, first: int, last: int):
        """Of samples ``first`` to ``last`` - 1."""
        import numpy as np

        out = np.minimum(duration, np.arange(first, last) * self.interval)
        n = max(1, min(self.most, math.ceil(duration / self.interval)))
        if last > n:
            out[n - first :] = duration
        return out

    def within(self, duration: float, low: float, high: float) -> tuple[int, int]:
        """The samples that may be from ``low`` to ``high``."""
        n = self.size(duration)
        first = 0 if low == -math.inf else min(n, max(0, math.floor(min(low, duration) / self.interval) - 1))
        if first and self.times(duration, n - 1, n)[0] >= low:
            first = min(first, n - 1)
        # The last sample may be the recording's end, which isn't on the grid.
        last = n if high >= duration else min(n, max(0, math.floor(high / self.interval) + 2))
        return first, last

    def slices(self, recordings: Iterable[tuple[int, float]], low: float = -math.inf, high: float = math.inf) -> list[InputPartition]:
        out, here, room = [], [], self.slice
        for job, duration in recordings:
            first, last = self.within(duration, low, high)
            while first < last:
                end = min(last, first + room)
                here.append((job, duration, first, end))
                room -= end - first
                first = end
                if room <= 0:
                    out.append(InputPartition(here))
                    here, room = [], self.slice
        return out + [InputPartition(here)] if here else out

    def batches(self, partition: InputPartition, keep=None):
        import numpy as np
        import pyarrow as pa

        for job, duration, first, last in partition.value:
            times = self.times(duration, first, last)
            at = np.arange(first, last)
            if keep is not None:
                at, times = at[keep(times)], times[keep(times)]
            yield pa.record_batch([pa.array(np.full(len(at), job), pa.int64()), pa.array(at, pa.int32()), pa.array(times, pa.float64())], names=["job_id", "frame_id", "time_sec"])


def listed(path: str, files: list[str] | None = None, jobs: set[int] | None = None) -> Iterator[tuple[int, float]]:
    """(job_id, duration) of the recordings in the files, one row group at a time."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(path)
    data = ds.dataset([f"{root}/{x}" for x in files] if files is not None else root, filesystem=fs, format="parquet")
    wanted = ds.field("duration").is_valid() & ds.field("job_id").is_valid()
    if jobs is not None:
        wanted &= ds.field("job_id").isin(sorted(jobs))
    for batch in data.to_batches(columns=["job_id", "duration"], filter=wanted):
        yield from zip(batch.column("job_id").to_pylist(), batch.column("duration").to_pylist())


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.grid = options["path"], Grid(options)
        self.jobs: set[int] | None = None
        self.bounds: list[tuple[str, float]] = []

    def partitions(self) -> list[InputPartition]:
        low = max((v for k, v in self.bounds if k.startswith("Greater")), default=-math.inf)
        high = min((v for k, v in self.bounds if k.startswith("Less")), default=math.inf)
        return self.grid.slices(listed(self.path, jobs=self.jobs), low, high) or [InputPartition([])]

    def read(self, partition):
        import numpy as np

        tests = {"GreaterThan": np.greater, "GreaterThanOrEqual": np.greater_equal, "LessThan": np.less, "LessThanOrEqual": np.less_equal}
        keep = lambda times: np.logical_and.reduce([np.ones(len(times), bool), *(tests[k](times, v) for k, v in self.bounds)])
        yield from self.grid.batches(partition, keep)


class FilteredReader(RecordingReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "job_id" and isinstance(f, (EqualTo, In)):
                found = set(f.value) if isinstance(f, In) else {f.value}
                self.jobs = found if self.jobs is None else self.jobs & found
            elif name == "time_sec" and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.bounds.append((type(f).__name__, float(f.value)))
            else:
                yield f


class RecordingStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.grid = options["path"], Grid(options)

    def names(self) -> list[str]:
        from pyarrow.fs import FileSelector, FileSystem

        fs, root = FileSystem.from_uri(self.path)
        return sorted(x.base_name for x in fs.get_file_info(FileSelector(root)) if x.base_name.endswith(".parquet") and x.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [x for x in self.names() if start["after"] < x <= end["after"]]
        return self.grid.slices(listed(self.path, new)) if new else []

    def read(self, partition):
        yield from self.grid.batches(partition)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return "job_id long, frame_id int, time_sec double"

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("pushdown", "false").lower() == "true" else RecordingReader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RecordingStream(dict(self.options))
