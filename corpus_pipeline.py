"""From documents to training sequences in five stages, which ``inkwell.llm.stages`` describes."""

from inkwell.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
