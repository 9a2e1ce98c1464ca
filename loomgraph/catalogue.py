"""All registered queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import charting, graphs, likeness, skeletons, spaces, tables

MODULES = (tables, charting, graphs, likeness, spaces, skeletons)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.flagship_priority_revenue(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}
