"""Quality rules by robust multivariate outliers.

Each text becomes a vector of transformed statistics (word length, symbols, capitals, repeated lines,
repeated words). Per language and source, per language, and over all languages, a
minimum-covariance-determinant estimate is made: two deterministic starts, then concentration steps, each of which keeps the
``SUBSET`` share of rows that lie nearest to the last estimate, until the determinant falls no more;
the smallest determinant of both starts is taken and reweighted once. Rows beyond ``CUTOFF`` of the chi-square distribution of
the squared Mahalanobis distance are rejected. Sources with fewer than ``LEAST_ROWS`` rows in a
language are judged by the estimate of the language, languages with fewer by the estimate over all
languages, however few rows that has: every text with words gets a distance.

All steps are aggregates with a map-side part over a narrow staged table, so a source or language of
any size is folded where it lies; only estimates, one row per group, are brought together.

A null text has no words. Null languages and sources are groups of their own. Texts without words
and those that the base rule rejects take no part in estimates. Repeated rows count as often as they stand. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylint.functions.staging import stage
from quarrylint.llm.text_stats import COUNTS, text_counts

#: Per statistic, the standard deviation that is added to every estimate: texts differ by that much
#: without being odd, also where nearly all have the same value.
FLOORS = {"word_length": 0.04, "symbols": 0.04, "capitals": 0.05, "same_lines": 0.15, "same_words": 0.15}
NAMES = tuple(FLOORS)
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
SUBSET = 0.75
#: So many steps are taken in any case; further ones while the log of a group's determinant falls by SETTLED or more.
STEPS = 4
SETTLED = 1e-3
REWEIGHT = 0.975
CUTOFF = 0.9999
LEAST_ROWS = 100
#: Estimates of up to so many groups (some 250 bytes each) are sent to every task; more are joined by shuffle.
BROADCAST_GROUPS = 20_000
#: Beyond that, the estimates of so many of the largest groups are still broadcast, so that no task gets all their rows.
HEAVY_GROUPS = 1000
BINS_PER_OCTAVE = 32
NOTHING = "\u0000"
ALL = NOTHING + "all"
STATS = T.StructType([T.StructField(name, T.LongType()) for name in (*COUNTS, "n_lines", "n_capitals")])


def chi_square_cdf(x: float, df: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, half = df / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= half / (a + n)
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a))


def chi_square_quantile(q: float, df: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, df) < q else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows has to be multiplied by."""
    return share / chi_square_cdf(chi_square_quantile(share, P), P + 2)


@F.arrow_udf(STATS)
def text_stats(contents: pa.Array) -> pa.Array:
    rows = []
    for content in contents:
        content = content.as_py()
        capitals = sum(map(content.count, map(bytes, zip(range(65, 91)))))
        rows.append((*text_counts(content), content.count(b"\n") + 1, capitals))
    columns = np.array(rows, dtype=np.int64).reshape(-1, len(COUNTS) + 2).T
    return pa.StructArray.from_arrays(list(map(pa.array, columns)), STATS.names)


# Else Spark would evaluate it once more for each filter and expression that reads its result.
text_stats = text_stats.asNondeterministic()


def with_stats(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Each row as ``doc``, with lang, source, stats and the vector x0, x1, …"""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce(F.col(lang).cast("string"), F.lit(NOTHING)).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit(NOTHING)).alias("source"),
        text_stats(content).alias("s"),
    )
    chars, words = F.greatest("s.word_chars", F.lit(1)), F.greatest("s.n_words", F.lit(1))
    vector = {
        "word_length": F.log(chars / words),
        "symbols": F.sqrt(F.col("s.n_symbols") / chars),
        "capitals": F.sqrt(F.col("s.n_capitals") / chars),
        "same_lines": F.sqrt(F.col("s.n_dup_lines") / F.col("s.n_lines")),
        "same_words": F.sqrt(F.col("s.n_repeat_words") / words),
    }
    return rows.select("*", *(vector[name].alias(f"x{k}") for k, name in enumerate(NAMES)))


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Join to the rows of ``groups``, without their ``n``; ``few``: there are at most BROADCAST_GROUPS groups.

    Else the HEAVY_GROUPS with the largest ``n`` are broadcast and the others joined by shuffle.
    """
    plain = groups.drop("n")
    if few:
        return rows.join(F.broadcast(plain), keys)
    sizes = groups.groupBy(*keys).agg(F.max("n").alias("n"))
    heavy = F.broadcast(sizes.orderBy(F.desc("n"), *keys).limit(HEAVY_GROUPS).select(*keys))
    large = rows.join(F.broadcast(plain.join(heavy, keys, "left_semi")), keys)
    small = rows.join(heavy, keys, "left_anti").join(plain.join(heavy, keys, "left_anti"), keys)
    return large.unionByName(small)


def distance(x: list[Column]) -> Column:
    """Squared length of whiten · (x - mean); ``whiten`` is a lower triangle, row by row."""
    centred = [x[k] - F.col("mean")[k] for k in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + F.col("whiten")[i * (i + 1) // 2 + j] * centred[j]
        total = total + row * row
    return total


def moments(rows: DataFrame, x: list[Column]) -> DataFrame:
    """lang, source, start, n, sums, products: sums over the rows of a group, folded map side."""
    return rows.groupBy("lang", "source", "start").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.sum(c) for c in x)).alias("sums"),
        F.array(*(F.sum(x[i] * x[j]) for i, j in PAIRS)).alias("products"),
    )


ESTIMATE = "lang string, source string, start int, n bigint, mean array<double>, whiten array<double>, logdet double"


def _estimated(factor: float, correlation: bool = False):
    """mapInPandas function from moments to estimates; ``correlation``: of standardised rows, see ``starts``."""
    floors = np.diag(np.square(list(FLOORS.values())))
    lower = np.tril_indices(P)

    def estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            means, whitens, dets = [], [], []
            for row in batch.itertuples():
                mean = np.array(row.sums) / row.n
                square = np.zeros((P, P))
                square[lower] = np.array(row.products) / row.n
                square = square + np.tril(square, -1).T
                covariance = square - np.outer(mean, mean)
                if correlation:
                    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
                    scale = np.array(row.scale)
                    covariance = covariance / np.outer(spread, spread) * np.outer(scale, scale)
                    np.fill_diagonal(covariance, scale**2)
                    mean = np.array(row.middle)
                root = np.linalg.cholesky(covariance * factor + floors)
                means.append(mean)
                whitens.append(np.linalg.inv(root)[lower])
                dets.append(2 * np.log(np.diag(root)).sum())
            yield pd.DataFrame({
                "lang": batch.lang, "source": batch.source, "start": batch.start, "n": batch.n,
                "mean": means, "whiten": whitens, "logdet": dets,
            })

    return estimates


def starts(rows: DataFrame, folder: str | None) -> tuple[DataFrame, bool]:
    """Two first estimates per group: medians and quartile ranges, without and with a correlation.

    The correlation is that of tanh of the standardised rows, which no outlier moves far.
    Also returned: whether groups are few.
    """
    quartiles = rows.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.percentile_approx(f"x{k}", [0.25, 0.5, 0.75], 10000).alias(f"q{k}") for k in range(P)),
    )
    floor = list(FLOORS.values())
    robust = stage(quartiles.select(
        "lang", "source", "n",
        F.array(*(F.col(f"q{k}")[1] for k in range(P))).alias("middle"),
        F.array(*(
            F.greatest((F.col(f"q{k}")[2] - F.col(f"q{k}")[0]) / 1.349, F.lit(floor[k])) for k in range(P)
        )).alias("scale"),
    ), "mcd-quartiles", folder)
    few = robust.count() <= BROADCAST_GROUPS
    plain = robust.select(
        "lang", "source", F.lit(0).alias("start"), "n", F.col("middle").alias("mean"),
        F.flatten(F.array(*(
            F.array(*([F.lit(0.0)] * k), 1 / F.col("scale")[k]) for k in range(P)
        ))).alias("whiten"),
        F.lit(0.0).alias("logdet"),
    )
    standard = [F.tanh((F.col(f"x{k}") - F.col("middle")[k]) / F.col("scale")[k]) for k in range(P)]
    joined = with_groups(rows, robust, ["lang", "source"], few).withColumn("start", F.lit(1))
    correlated = (
        moments(joined, standard).join(robust.drop("n"), ["lang", "source"]).mapInPandas(_estimated(1.0, True), ESTIMATE)
    )
    return plain.unionByName(correlated), few


def _concentrated(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Moments of the SUBSET share of each group's rows nearest to its estimate.

    The share is cut at the edge of a bin of distances, 1/BINS_PER_OCTAVE of an octave wide.
    """
    x = [F.col(f"x{k}") for k in range(P)]
    near = with_groups(rows, estimates.drop("logdet"), ["lang", "source"], few).withColumn(
        "bin", F.floor(F.log2(distance(x) + F.lit(1e-9)) * BINS_PER_OCTAVE).cast("int")
    )
    group = ["lang", "source", "start"]
    counts = near.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*group).orderBy("bin")
    whole = Window.partitionBy(*group)
    edge = (
        counts.select(*group, "bin", F.sum("n").over(upto).alias("reached"), F.sum("n").over(whole).alias("all"))
        .where(F.col("reached") >= F.col("all") * SUBSET)
        .groupBy(*group).agg(F.min("bin").alias("edge"), F.max("all").alias("n"))
    )
    return moments(with_groups(near, edge, group, few).where("bin <= edge"), x)


def base_failed() -> Column:
    return (F.col("s.n_words") < 50) | (100 * F.col("s.n_repeat_words") > 50 * F.col("s.n_words"))


def settled_estimates(rows: DataFrame, first: DataFrame, few: bool, folder: str | None) -> DataFrame:
    """Per group, the estimate of the smallest determinant that the steps from ``first`` came to.

    A group takes steps as long as its determinant falls; only such groups take part in a step.
    """
    group = ["lang", "source", "start"]
    falling, steps, before = first, [], None
    while len(steps) < STEPS or falling.take(1):
        now = stage(
            _concentrated(rows, falling, few).mapInPandas(_estimated(consistency(SUBSET)), ESTIMATE), "mcd-step", folder
        )
        steps.append(now)
        falling = now
        if before is not None and len(steps) >= STEPS:
            falls = now.join(before, group).where(F.col("logdet") <= F.col("before") - SETTLED)
            falling = stage(falls.drop("before"), "mcd-falling", folder)
        before = now.select(*group, F.col("logdet").alias("before"))
    every = functools.reduce(DataFrame.unionByName, steps)
    best = F.min_by(F.struct("n", "mean", "whiten"), F.struct("logdet", "start"))
    return every.groupBy("lang", "source").agg(best.alias("e")).select("lang", "source", "e.*")


def mcd_estimates(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """lang, source, rows, mean, whiten; ``source`` is ALL for a whole language, both are for all languages.

    ``rows`` is a staged table of lang, source, s and x0, x1, … with all texts that have words. Groups of
    which the base rule rejects all have 0 rows and no mean.
    """
    x = [F.col(f"x{k}") for k in range(P)]
    every = F.lit(ALL)
    levels = F.array(
        F.struct(F.col("lang").alias("lang"), F.col("source").alias("source")),
        F.struct(F.col("lang").alias("lang"), every.alias("source")),
        F.struct(every.alias("lang"), every.alias("source")),
    )
    leveled = rows.select(F.explode(levels).alias("level"), base_failed().alias("failed"), *x)
    leveled = leveled.select("level.*", "failed", *x)
    spread = leveled.where("NOT failed").drop("failed")
    first, few = starts(spread, folder)
    raw = stage(settled_estimates(spread, stage(first, "mcd-start", folder), few, folder), "mcd-settled", folder)
    near = with_groups(spread, raw, ["lang", "source"], few).where(distance(x) <= F.lit(chi_square_quantile(REWEIGHT, P)))
    final = moments(near.withColumn("start", F.lit(0)), x).mapInPandas(_estimated(consistency(REWEIGHT)), ESTIMATE)
    sizes = leveled.groupBy("lang", "source").agg(F.count_if(~F.col("failed")).alias("rows"))
    return stage(final.join(sizes, ["lang", "source"], "right").select("lang", "source", "rows", "mean", "whiten"), "mcd", folder)


def judged(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` (lang, source, x0, …, s and more) with ``distance``, ``base_failed`` and ``kept``."""
    of_language, of_source = F.col("lang") != ALL, F.col("source") != ALL
    own = F.when(F.col("rows") >= LEAST_ROWS, F.struct("mean", "whiten"))
    wide = estimates.where(of_language & ~of_source).select("lang", own.alias("wide"))
    every = estimates.where(~of_language).select(F.struct("mean", "whiten").alias("every"))
    groups = (
        estimates.where(of_source).select("lang", "source", own.alias("own"))
        .join(wide, "lang", "left").join(F.broadcast(every), how="left")
        .select("lang", "source", F.coalesce("own", "wide", "every").alias("e"))
        .select("lang", "source", "e.*")
    )
    away = distance([F.col(f"x{k}") for k in range(P)])
    few = estimates.count() <= BROADCAST_GROUPS
    return (
        rows.join(F.broadcast(groups) if few else groups, ["lang", "source"], "left")
        .withColumn("distance", F.when(F.col("s.n_words") > 0, F.sqrt(away)))
        .withColumn("base_failed", base_failed())
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (F.coalesce(F.col("distance"), F.lit(0.0)) <= F.lit(math.sqrt(chi_square_quantile(CUTOFF, P)))),
        )
        .drop("mean", "whiten")
    )


def quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    folder: str | None = None,
) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance per document."""
    rows = with_stats(docs.select(doc_id, text, lang, source), text, lang, source)
    rows = stage(rows.select(F.col(f"doc.{doc_id}").alias("doc_id"), *rows.columns[1:]), "quality", folder)
    estimates = mcd_estimates(rows.where("s.n_words > 0"), folder)
    return judged(rows, estimates).select("doc_id", *(f"s.{name}" for name in COUNTS), "base_failed", "kept", "distance")


def kept_documents(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", folder: str | None = None
) -> DataFrame:
    """``docs`` without rejected rows. The statistics are made again in the last pass: no text is moved."""
    rows = with_stats(docs, text, lang, source)
    used = F.struct("s.n_words", "s.n_repeat_words").alias("s")
    narrow = rows.select("lang", "source", used, *(f"x{k}" for k in range(P)))
    narrow = stage(narrow, "quality", folder).where("s.n_words > 0")
    return judged(rows, mcd_estimates(narrow, folder)).where("kept").select("doc.*")
