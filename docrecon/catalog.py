"""Every registered query of the reconciliation engine, with its SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docrecon.plans import queries as plans
from docrecon.plans import grid_queries, learn_queries, sheet_queries, structure_queries, page_queries, unit_queries  # noqa: F401  they add their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.ORACLE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against found items of every unit."""
    return plans.q_count_mismatch(spark, sf_dir)
