"""The text pipeline: its stages are in ``plumbline.llm.pipeline``."""

from plumbline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
