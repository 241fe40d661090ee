"""The corpus pipeline: its stages and run() are in the subpackage of corpus operators."""

from hushframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
