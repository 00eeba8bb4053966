"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import content, duplicates, notices, records, relational, streams

PARTS = (content, duplicates, notices, records, relational, streams)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, groups, elected primaries: each group with its primary, members and kinds of link."""
    return duplicates.group_overview(spark, sf_dir)
