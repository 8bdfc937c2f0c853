"""The corpus pipeline, from documents to packed training sequences; the stages are in ``entitrail.llm.pipeline``."""

from entitrail.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
