"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phaseloom.plans import kernel_queries, scalar_queries, table_queries
from phaseloom.plans.kernel_queries import flagship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**scalar_queries.QUERIES, **table_queries.QUERIES, **kernel_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**scalar_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **kernel_queries.ORACLE_SQL}

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
