"""Queries by name, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from privlake.plans import detector, forms, geometry, ledger, pages, planning, reports, runs, spatial, stores, text, untrusted
from privlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "detector", "flagship", "forms", "geometry", "ledger", "pages", "planning", "reports", "runs", "spatial", "stores", "text", "untrusted"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What personal data the documents hold, by category."""
    return QUERIES["pii_by_category"](spark, sf_dir)
