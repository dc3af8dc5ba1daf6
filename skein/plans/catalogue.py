"""Registry of the library's own queries and their DuckDB twins, by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cells, certification, checks, crawl, exports, matches, pages, proofs, readings, relational, values, work

FAMILIES = (relational, cells, values, pages, exports, work, matches, checks, crawl, certification, proofs, readings)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by region and month."""
    return relational.usage_by_region_month(spark, sf_dir)


def queries():
    return {name: query for family in FAMILIES for name, (query, _) in family.QUERIES.items()}


def oracle_sql():
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
