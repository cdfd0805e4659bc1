"""Text functions: decoding, line splitting, entropy. Catalyst expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line boundaries of str.splitlines other than \n; \r\n counts as one.
_BREAKS = ("\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


def plain_breaks(text: Column) -> Column:
    """Every line boundary as ``\\n``. Plain replacing is far quicker than a regular expression,
    and costs one scan without a copy for each boundary that does not occur."""
    for boundary in _BREAKS:
        text = F.replace(text, F.lit(boundary), F.lit("\n"))
    return text


def decode(content: Column) -> Column:
    """Bytes to text: UTF-8 with U+FFFD for bad bytes, CR and CRLF become LF, a BOM stays."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def n_lines(text: Column) -> Column:
    """Number of lines as ``len(text.splitlines())`` counts them, without building the lines."""
    plain = plain_breaks(text)
    breaks = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    open_end = (F.length(plain) > 0) & ~plain.endswith("\n")
    return (breaks + open_end.cast("int")).cast("int")


def split_lines(text: Column) -> Column:
    """The lines of ``text.splitlines()`` as an array."""
    return plain_lines(plain_breaks(text))


def plain_lines(plain: Column) -> Column:
    """The lines of a text with ``\n`` as its only boundary."""
    parts = F.split(plain, "\n", -1)
    closed = (F.length(plain) == 0) | plain.endswith("\n")
    return F.when(closed, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: inside lambdas Spark does so at each mention of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(files: DataFrame) -> DataFrame:
    """One row per line: project, path, line_no (from 1), text."""
    return files.select(
        "project", "path", F.posexplode(split_lines(F.col("content"))).alias("pos", "text")
    ).select("project", "path", (F.col("pos") + 1).alias("line_no"), "text")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character, to six decimals so that summing order is no matter."""
    bits = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    state = lambda char, run, total: F.struct(char.alias("char"), run.alias("run"), total.alias("total"))
    # Equal characters stand together, so one pass over the runs is enough.
    told = F.aggregate(
        F.array_sort(F.split(value, "")),
        state(F.lit(""), F.lit(0.0), F.lit(0.0)),
        lambda acc, char: F.when(acc["char"] == char, state(char, acc["run"] + 1, acc["total"])).otherwise(
            state(char, F.lit(1.0), acc["total"] + bits(acc["run"]))
        ),
        lambda acc: acc["total"] + bits(acc["run"]),
    )
    size = F.length(value).cast("double")
    return F.round(F.when(size > 0, F.log2(size) - told / size).otherwise(0.0), 6)
