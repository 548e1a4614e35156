"""A training corpus from ``documents``: the stages of ``tracewright.llm.pipeline``, by the names that the driver asks for."""

from tracewright.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
