"""Helpers that several operators share: the work folder, words, Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tracewright.llm

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(tracewright.llm)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def work_dir(spark: SparkSession) -> str:
    """A new folder under the shared ``spark.checkpoint.dir``. It may be unset only where there is one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tracewright-work"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Folders written within the innermost ``scratch`` of this thread or task; none outside of one.
WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and the columns stay prunable."""
    folder = work_dir(df.sparkSession)
    path = f"{folder}/{name}.parquet"
    if (mine := WRITTEN.get()) is not None:
        mine.append(folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside, in this thread, are deleted at the end. Results must have been written by then.

    Runs in other threads keep theirs."""
    token = WRITTEN.set([])
    try:
        yield
    finally:
        for folder in WRITTEN.get():
            removed(spark, folder)
        WRITTEN.reset(token)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def if_small(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of a few numbers a row, broadcast if it has at most ``most`` rows; else it is shuffled."""
    return F.broadcast(ids) if ids.count() <= most else ids


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded: whole texts may be long, and a task holds a batch several times."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def shipped(spark: SparkSession, data: Any, make: Callable[[Any], Any] = lambda data: data) -> Callable[[], Any]:
    """A function that gives ``make(data)`` in a task, made once for each Python worker.

    ``data`` is broadcast and must be of bounded size. It should consist of built-in types and arrays, which
    need no package on the executors; ``make`` travels with the job. ``.destroy()`` frees it when its jobs are done.
    """
    shared = spark.sparkContext.broadcast(data)

    def get():
        if not hasattr(shared, "made"):
            shared.made = make(shared.value)
        return shared.made

    get.destroy = shared.destroy
    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` has a fast path for text that is all ASCII, where it does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column without a copy, and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, one row at least, so memory doesn't follow the batch size."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, the public MurmurHash3 fmix64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter(map(h, words), dtype=np.uint64, count=len(words))


class Runs:
    """Hashes of any runs of tokens in constant time each: prefix sums of a polynomial mod 2**64.

    ``salt`` picks one of several independent hashes.
    """

    def __init__(self, tokens: np.ndarray, salt: int = 0):
        base = 0x9E3779B97F4A7C15 + 2 * salt
        self.power = np.full(len(tokens) + 1, base, np.uint64)
        back = np.full(len(tokens), pow(base, -1, 1 << 64), np.uint64)
        self.power[0] = 1
        back[:1] = 1
        self.power, back = np.cumprod(self.power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens + np.uint64(salt)) * back, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.power[start])

    def windows(self, size: int) -> np.ndarray:
        """The hash of every run of ``size`` tokens, in order."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.power[:n])


def texts(column: pa.Array) -> list[bytes]:
    """Rows of an Arrow string column as bytes; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
