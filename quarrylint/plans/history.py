"""Scan history: a Parquet table that scans are added to, read newest first."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylint.functions.staging import remove

KEPT_ROWS = 20  # fixed value: rows shown
HISTORY_DDL = "project STRING, scanned_at TIMESTAMP, overall INT, total INT, security INT, quality INT"
_FOLDER = "append-"


def history_rows(overview: DataFrame, scanned_at: Column | datetime | None = None) -> DataFrame:
    """One history row per project of an overview (see ``report.project_overview``)."""
    when = F.current_timestamp() if scanned_at is None else scanned_at
    when = when if isinstance(when, Column) else F.lit(when)
    return overview.select(
        "project", when.alias("scanned_at"), F.col("score_overall").alias("overall"),
        "total", "security", "quality",
    )


def append_history(rows: DataFrame, table: str, scan_id: str) -> None:
    """Add the rows of one scan. Each scan has a folder of its own, so a job that runs again replaces its rows."""
    if not re.fullmatch(r"[\w.-]+", scan_id):
        raise ValueError("a scan id is made of letters, digits, dots, hyphens and underscores")
    rows.withColumn("scan_id", F.lit(scan_id)).write.mode("overwrite").parquet(f"{table}/{_FOLDER}{scan_id}")


def read_history(spark: SparkSession, table: str) -> DataFrame:
    """All rows that are kept; one that a compaction has copied but not yet removed counts once."""
    rows = spark.read.schema(f"{HISTORY_DDL}, scan_id STRING").parquet(f"{table}/{_FOLDER}*")
    return rows.dropDuplicates(["scan_id", "project"]).drop("scan_id")


def compact_history(spark: SparkSession, table: str, rows: int = KEPT_ROWS) -> None:
    """Keep the newest ``rows`` only.

    They are copied to a folder of their own, then the older folders go. A run that stops in
    between leaves copies, which reading counts once and the next compaction removes. Folders that
    are added meanwhile stay.
    """
    store = spark._jvm.org.apache.hadoop.fs.Path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{_FOLDER}*"))
    old = sorted(status.getPath().toString() for status in folders or ())
    if not old:
        return
    every = spark.read.schema(f"{HISTORY_DDL}, scan_id STRING").parquet(*old).dropDuplicates(["scan_id", "project"])
    number = 1 + max((int(m[1]) for m in (re.search(r"append-compact-(\d+)$", name) for name in old) if m), default=0)
    newest(every, rows).coalesce(1).write.mode("overwrite").parquet(f"{table}/{_FOLDER}compact-{number}")
    for folder in old:
        remove(spark, folder)


def newest(history: DataFrame, rows: int = KEPT_ROWS) -> DataFrame:
    """The newest scans; planned as a top-k, never as a full sort."""
    return history.orderBy(F.desc("scanned_at"), "project").limit(rows)


def history_view(history: DataFrame, rows: int = KEPT_ROWS) -> DataFrame:
    """Newest first, as text; a missing score is shown as a dash."""
    return newest(history, rows).select(
        "scanned_at",
        "project",
        F.concat(F.coalesce(F.col("overall").cast("string"), F.lit("—")), F.lit("/100")).alias("score"),
        F.concat(
            F.col("total").cast("string"),
            F.when(F.col("total") == 1, " issue (").otherwise(" issues ("),
            F.col("security").cast("string"), F.lit(" security, "),
            F.col("quality").cast("string"), F.lit(" quality)"),
        ).alias("counts"),
    )
