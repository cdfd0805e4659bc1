"""Hardcoded secrets: text patterns and entropy, as one row-level Catalyst expression."""

from __future__ import annotations

import os.path
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylint.functions.text import bound, entropy, plain_breaks, plain_lines

# Public token formats, as (kind, literals of which one must occur, pattern).
SIGNATURES = (
    ("aws-access-key", ("AKIA",), r"AKIA[0-9A-Z]{16}"),
    ("github-token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("slack-token", ("xox",), r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("json-web-token", ("eyJ",), r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("private-key", ("PRIVATE KEY-----",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
# Names that make a quoted value suspicious, and the limits for such a value.
NAME_WORDS = ("token", "secret", "password", "api_key")
MIN_LENGTH = 16
MIN_ENTROPY = 3.0

# name, rest of the name, closing quote of a key, optional annotation, = or :, quoted value
ASSIGNMENT = (
    r"(?i)(?:" + "|".join(NAME_WORDS) + r")\w*[\"']?\s*(?::\s*[a-z_][a-z0-9_.\[\]]*\s*=|=|:)"
    r"\s*[rbuf]{0,2}[\"']([^\"'\s]{" + str(MIN_LENGTH) + r",})[\"']"
)

HIT_DDL = "array<struct<line:int,column:int,kind:string,shown:string,bits:double>>"


def _may_hold_secret(text: Column, signatures) -> Column:
    """Plain substring tests, cheap enough for every file and line, before any pattern runs.

    Each test reads the whole text, so literals that begin alike are sought by their beginning first, and names only
    where there is a quote.
    """
    def any_of(text: Column, some) -> Column:
        return reduce(Column.__or__, [F.contains(text, F.lit(literal)) for literal in some])

    def known(some) -> Column:
        start = os.path.commonprefix(some)
        return F.contains(text, F.lit(start)) & any_of(text, some) if start and len(some) > 1 else any_of(text, some)

    quoted = any_of(text, ('"', "'")) & bound(F.lower(text), lambda low: any_of(low, NAME_WORDS))
    return reduce(Column.__or__, [*(known(some) for _, some, _ in signatures), quoted])


def _line_hits(line: Column, number: Column, signatures, min_entropy: float) -> Column:
    def hit(value: Column, kind: str, bits: Column) -> Column:
        return F.struct(
            number.alias("line"),
            F.instr(line, value).alias("column"),
            F.lit(kind).alias("kind"),
            masked(value).alias("shown"),
            bits.cast("double").alias("bits"),
        )

    def matches(pattern: str, group: int, kind: str, bits) -> Column:
        values = F.regexp_extract_all(line, F.lit(pattern), F.lit(group))
        return F.transform(F.array_distinct(values), lambda v: hit(v, kind, bits(v)))

    known = F.concat(*[matches(pattern, 0, kind, lambda v: F.lit(None)) for kind, _, pattern in signatures])
    random = F.filter(
        matches(ASSIGNMENT, 1, "high-entropy", entropy), lambda found: found["bits"] >= min_entropy
    )
    return bound(known, lambda found: F.when(F.size(found) > 0, found).otherwise(random))


def secret_hits(text: Column, signatures=SIGNATURES, min_entropy: float = MIN_ENTROPY) -> Column:
    """All secrets of a text as array<struct<line, column, kind, shown, bits>>; no value leaves in full.

    On a line with a token of a known format only such tokens count; otherwise quoted values of
    suspicious names count if they are random enough. Equal values on one line count once.
    """
    numbered = F.transform(
        bound(plain_breaks(text), plain_lines), lambda line, i: F.struct((i + 1).alias("no"), line.alias("text"))
    )
    worth_a_look = F.filter(numbered, lambda l: _may_hold_secret(l["text"], signatures))
    hits = F.flatten(
        F.transform(worth_a_look, lambda l: _line_hits(l["text"], l["no"], signatures, min_entropy))
    )
    return F.when(_may_hold_secret(text, signatures), hits).otherwise(F.array().cast(HIT_DDL))


def masked(value: Column) -> Column:
    """A value that may be shown: the first four characters only."""
    return F.concat(F.substring(value, 1, 4), F.lit("****"))
