"""One check per operator: a Spark query over the driver tables and, where there is one, its SQL answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylint.checks import corpus as made
from quarrylint.plans.scan import Scan, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

ISSUE_FIELDS = [
    "project", "rule_id", "checker", "category", "severity", "path", "line", "column", "symbol",
    "measure", "threshold", "message", "snippet",
]

_scans: dict[tuple[str, str], Scan] = {}


def check(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


def corpus_scan(spark: SparkSession, sf_dir: str) -> Scan:
    """The full scan of the whole corpus, staged once per session and shared by the roll-ups."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _scans:
        _scans[key] = scan(made.corpus(spark, sf_dir))
    return _scans[key]


def corpus_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All projects, among them one without files per supplier."""
    supplier = made.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("project"))
    return corpus_scan(spark, sf_dir).facts.select("project").distinct().unionByName(supplier)


PROJECTS = "projects AS (SELECT DISTINCT project FROM files UNION ALL SELECT s_name FROM supplier)"
