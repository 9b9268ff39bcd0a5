"""Registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.model.driver_tables import tables
from paperloom.operators import bibliometrics
from paperloom.plans import collections, scholar


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bibliometrics.annual_impact(tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return scholar.QUERIES | collections.QUERIES


def oracle_sql() -> dict[str, str]:
    return scholar.ORACLES | collections.ORACLES
