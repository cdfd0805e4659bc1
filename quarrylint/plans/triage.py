"""Filters, search and order over the issue table; they combine by chaining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylint.functions.staging import numbered
from quarrylint.operators.findings import ISSUE_ORDER

ALL = "all"


def by_category(issues: DataFrame, category: str) -> DataFrame:
    return issues if category == ALL else issues.filter(F.col("category") == category)


def by_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues if severity == ALL else issues.filter(F.col("severity") == severity)


def by_file(issues: DataFrame, path: str | None, project: str | None = None) -> DataFrame:
    if project is not None:
        issues = issues.filter(F.col("project") == project)
    return issues if path is None else issues.filter(F.col("path") == path)


def search(issues: DataFrame, text: str) -> DataFrame:
    """Case-insensitive plain substring in message, path or rule name; no wildcards."""
    if not text:
        return issues
    wanted = F.lower(F.lit(text))
    found = lambda name: F.contains(F.lower(name), wanted)
    return issues.filter(found("message") | found("path") | found("checker"))


def triage_order(collation: str | None = None) -> list[Column]:
    """Worst severity first, then path, scan order and project; ``collation`` as ``UNICODE`` for locale order."""
    path = F.collate("path", collation) if collation else F.col("path")
    return [F.col("severity_rank"), path, *[F.col(c) for c in ISSUE_ORDER if c != "path"], F.col("project"), F.col("path")]


def triage_places(
    issues: DataFrame, within: Sequence[str] = (), collation: str | None = None, folder: str | None = None
) -> DataFrame:
    """Issues with ``place``, their number in triage order, in the whole table or ``within`` groups of any size.

    The order of a locale is the order of the range partitions themselves, so no task sorts a group.
    """
    path = F.collate("path", collation) if collation else F.col("path")
    order = ["severity_rank", "_path", *(c for c in ISSUE_ORDER if c != "path"), "project", "path"]
    placed = numbered(issues.withColumn("_path", path), within, order, "place", folder)
    return placed.drop("_path")


def triage(
    issues: DataFrame,
    category: str = ALL,
    severity: str = ALL,
    path: str | None = None,
    text: str = "",
    top: int | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Filtered issues, worst first; with ``top`` Spark keeps only that many rows per task."""
    rows = search(by_file(by_severity(by_category(issues, category), severity), path), text)
    ordered = rows.orderBy(*triage_order(collation))
    return ordered if top is None else ordered.limit(top)
