"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next."""

from newsloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
