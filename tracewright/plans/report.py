"""The whole plan: events to repaired, verified, cleaned steps and a quality report for each job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators import cleanup, procedure, steps
from tracewright.operators.ordered import dealt, settled
from tracewright.sources import recordings


def verified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Repaired and redacted steps of all jobs, and what is known about each job."""
    raw = recordings.procedures(spark, sf_dir)
    return steps.verified_offline(steps.risk_flags(steps.repaired(raw))), recordings.job_info(raw)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procedure.clean_steps(*verified(spark, sf_dir))


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Steps as ``verified`` gives them, what is known about each job, cleaned steps and reports. All but the last are
    computed and written here, so whatever reads them several times reads files."""
    rows, info = verified(spark, sf_dir)
    rows, info = dealt(settled(rows)), settled(info)
    clean = dealt(settled(procedure.clean_steps(rows, info)))
    return rows, info, clean, procedure.quality_report(clean, info, cleanup.chronology(rows))


def job_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)[3]
