"""Duplicate function bodies of a project: the one rule that needs all files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylint.functions.facts import bodies
from quarrylint.functions.staging import join_groups, stage

_GROUP = ["project", "digest"]


def function_bodies(facts: DataFrame, min_lines: int = 5) -> DataFrame:
    """Where each comparable body stands: digests and places only, never the bodies."""
    return bodies(facts).filter(F.col("n_lines") >= min_lines).select(*_GROUP, "path", "bfs", "lineno", "name")


def duplicate_groups(facts: DataFrame, min_lines: int = 5) -> DataFrame:
    """One row per body that occurs more than once, with its first place by path and tree order.

    A plain aggregate: a body that makes up much of the table is folded map side.
    """
    first = F.min(F.struct("path", "bfs", "lineno", "name")).alias("first")
    return (
        function_bodies(facts, min_lines)
        .groupBy(*_GROUP)
        .agg(F.count("*").cast("int").alias("occurrences"), first)
        .filter("occurrences > 1")
    )


def duplicate_places(facts: DataFrame, min_lines: int = 5, folder: str | None = None) -> DataFrame:
    """Every place of every duplicated body, one row each, with the first place of its body.

    ``first_path`` and ``first_line`` are those of the issue that ``duplicate_code`` gives for the body.
    The groups are staged, since the join below reads them more than once.
    """
    groups = stage(duplicate_groups(facts, min_lines), "duplicate_groups", folder)
    return join_groups(function_bodies(facts, min_lines), groups, _GROUP, "occurrences").select(
        "project",
        F.lower(F.hex("digest")).alias("digest"),
        "occurrences", "path", "bfs", "lineno", "name",
        F.col("first.path").alias("first_path"), F.col("first.lineno").alias("first_line"),
        (F.struct("path", "bfs") == F.struct("first.path", "first.bfs")).alias("is_first"),
    )


def duplicate_code(facts: DataFrame, min_lines: int = 5) -> DataFrame:
    """One finding per duplicated body, at its first place, with the number of places.

    All places, however many, are the rows of ``duplicate_places``: no list of them is gathered in a
    message, so a body that stands everywhere costs no more than one that stands twice.
    """
    return duplicate_groups(facts, min_lines).select(
        "project",
        F.col("first.path").alias("path"),
        F.lit("warning").alias("severity"),
        F.col("first.lineno").alias("line"),
        F.lit(0).alias("column"),
        F.col("first.name").alias("symbol"),
        F.col("occurrences").alias("measure"),
        F.lit(min_lines).alias("threshold"),
        F.format_string("One body, %d functions; this is the first of them", "occurrences").alias("message"),
        F.lit("").alias("snippet"),
        F.col("first.bfs").alias("bfs"),
        F.lit(0).alias("ord"),
    )
