"""Stages that a broken run takes up again: each one's table is written once and marked when it is whole.

A stage is a function of the stages before it. Its table goes to a folder named by the attempt; then one row in the
manifest says which attempt is the stage's, what it was made from (``digest``) and how many rows it has. What an
attempt that died has left behind is never named, so never read. A run reads every stage whose digest is in the
manifest and computes the others; a digest covers the stage's name and version and the digests of all it reads,
down to the rows of the source, so a stage is made anew if and only if something before it is different.

Cases. A stage without rows is whole too. Two runs at once may both make a stage; the first mark by name of the
attempt counts for all later ones, and both tables have the same rows. Empty sources have a digest of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.ordered import dealt

MARKS = "digest string, name string, attempt string, n long"


@dataclass(frozen=True)
class Stage:
    """``make`` gets the tables named in ``reads``, in that order. A change of what it does needs a new ``version``."""

    name: str
    reads: tuple[str, ...]
    make: Callable[..., DataFrame]
    version: str = "1"


class StageFailed(RuntimeError):
    """A stage broke; ``done`` are the tables of the stages before it, whole."""

    def __init__(self, name: str, done: dict[str, DataFrame]):
        super().__init__(f"stage {name} failed")
        self.name, self.done = name, done


def content_digest(df: DataFrame) -> str:
    """A digest of the rows of a table, in any order: their number and two sums of 64-bit hashes of whole rows."""
    return digest_and_number(df)[0]


def digest_and_number(df: DataFrame) -> tuple[str, int]:
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    sums = df.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(F.xxhash64(row, F.lit(i)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) for i in (1, 2))).first()
    return hashlib.sha256(repr((sorted(df.dtypes), [str(x) for x in sums])).encode()).hexdigest(), sums[0]


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """digest, name, attempt, n of the stages that are whole; of several attempts the first by name."""
    try:
        marks = spark.read.schema(MARKS).parquet(f"{root}/marks/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MARKS)
    return marks.groupBy("digest").agg(F.min(F.struct("attempt", "name", "n")).alias("x")).select("digest", "x.name", "x.attempt", "x.n")


def run(root: str, sources: dict[str, DataFrame], stages: list[Stage]) -> dict[str, DataFrame]:
    """The tables of all stages, by name, read from ``root`` where they are whole and made there where they aren't."""
    spark = next(iter(sources.values())).sparkSession
    marks = {r["digest"]: r for r in manifest(spark, root).collect()}  # one row for each stage ever made
    tables, digests = {}, {}
    for name, df in sources.items():
        digests[name], n = digest_and_number(df)
        tables[name] = by_job(df, n)
    done: dict[str, DataFrame] = {}
    for stage in stages:
        digest = hashlib.sha256(repr((stage.name, stage.version, [(x, digests[x]) for x in stage.reads])).encode()).hexdigest()
        digests[stage.name] = digest
        try:
            attempt, n = (marks[digest]["attempt"], marks[digest]["n"]) if digest in marks else made(spark, root, stage, digest, [tables[x] for x in stage.reads])
        except Exception as error:
            raise StageFailed(stage.name, done) from error
        done[stage.name] = spark.read.parquet(f"{root}/tables/{attempt}")
        tables[stage.name] = by_job(done[stage.name], n)
    return done


def by_job(table: DataFrame, n: int) -> DataFrame:
    return dealt(table, n) if "job_id" in table.columns else table


def made(spark: SparkSession, root: str, stage: Stage, digest: str, reads: list[DataFrame]) -> tuple[str, int]:
    attempt = f"{stage.name}-{uuid.uuid4().hex}"
    stage.make(*reads).write.parquet(f"{root}/tables/{attempt}")
    n = spark.read.parquet(f"{root}/tables/{attempt}").count()
    spark.createDataFrame([(digest, stage.name, attempt, n)], MARKS).coalesce(1).write.parquet(f"{root}/marks/{attempt}")
    return attempt, n
