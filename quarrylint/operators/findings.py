"""The shape of a finding inside a file row, and of an issue as a table row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING_DDL = (
    "struct<severity:string,line:int,column:int,symbol:string,measure:int,threshold:int,"
    "message:string,snippet:string,bfs:bigint,ord:int>"
)
NO_FINDINGS = f"array<{FINDING_DDL}>"

ISSUE_COLUMNS = (
    "project", "rule_id", "checker", "category", "severity", "severity_rank", "path", "line",
    "column", "symbol", "measure", "threshold", "message", "snippet",
)
# Columns that order the issues of a project: rules over all files come last, then by file,
# rule and place in the syntax tree.
ISSUE_ORDER = ("phase", "path", "rule_order", "bfs", "ord")


def _value(value, kind: str) -> Column:
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast(kind)


def finding(
    severity, line, message, *, bfs=0, ord=0, column=0, symbol=None, measure=None, threshold=None,
    snippet="",
) -> Column:
    return F.struct(
        _value(severity, "string").alias("severity"),
        _value(line, "int").alias("line"),
        _value(column, "int").alias("column"),
        _value(symbol, "string").alias("symbol"),
        _value(measure, "int").alias("measure"),
        _value(threshold, "int").alias("threshold"),
        _value(message, "string").alias("message"),
        _value(snippet, "string").alias("snippet"),
        _value(bfs, "bigint").alias("bfs"),
        _value(ord, "int").alias("ord"),
    )


def no_findings() -> Column:
    return F.array().cast(NO_FINDINGS)
