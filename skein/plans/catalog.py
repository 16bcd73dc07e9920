"""Registry of the library's queries and their oracle SQL.

A plan module holds QUERIES (name -> callable) and ORACLE (name -> SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import lda_queries, model_queries

MODULES = (lda_queries, model_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """All registered oracle statements."""
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
