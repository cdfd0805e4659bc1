"""Temperature mixing of sources and its realisation by block permutations.

A source with share s gets the weight s**exponent, normalised. The exponent is found by bisection:
the largest one in [0, 1] whose weights reach ``target_entropy`` (a share of the largest possible
entropy), but never one that repeats a source more than ``repetition_limit`` times, which goes first.
Without a ``budget`` the mix has as many tokens as it takes for every document to be in it once.

Documents of a source are dealt into blocks by hash. Each pass over a source visits its blocks in a
new permutation; the last pass ends when the tokens of the source's budget are used up, inside a block
by hash order. ``at`` places a block in the whole mix: sorted by it, every stretch of the mix holds the
sources at their weights.

Tokens are words ``[^\\x20\\x09-\\x0D]+``; a null text has none. A null source is a source of its own. A
source without tokens is passed over once. Repeated rows are dealt alike: all or none of them enter a
pass. Empty tables give empty results; other columns are
kept inside ``doc``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylint.functions.staging import running_total, stage

POINTS = 64
PASSES = 7
BLOCK_DOCS = 1024
NO_SOURCE = "\u0000"


def measured(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """Each row as ``doc``, with _source, _tokens and _order, all from the row itself."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.struct("*").alias("doc"),
        F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("_source"),
        F.regexp_count(content, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("_tokens"),
        F.xxhash64(F.lit(seed), F.col(doc_id), content).alias("_order"),
    )


def _moments(totals: DataFrame, exponents: list[float], largest: float) -> list:
    x = F.log(F.col("tokens") / F.lit(largest))
    return (
        totals.where("tokens > 0")
        .select("tokens", x.alias("x"), F.explode(F.array(*map(F.lit, exponents))).alias("exponent"))
        .withColumn("w", F.exp(F.col("exponent") * F.col("x")))
        .groupBy("exponent")
        .agg(
            F.sum("w").alias("z"),
            F.sum(F.col("w") * F.col("exponent") * F.col("x")).alias("wx"),
            F.max(F.col("w") / F.col("tokens")).alias("most"),
            F.max(F.col("tokens") / F.col("w")).alias("least"),
        )
        .orderBy("exponent")
        .collect()
    )


def _bisected(totals: DataFrame, largest: float, holds) -> tuple[float, float]:
    """Neighbouring exponents (low, high) of which ``holds`` is true for low only, or equal ends.

    Six halvings go into one Spark job: the job evaluates all points that they could ask for.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        points = [low + (high - low) * k / POINTS for k in range(POINTS + 1)]
        answers = [holds(row) for row in _moments(totals, points, largest)]
        if answers[-1]:
            return points[-1], points[-1]
        if not answers[0]:
            return points[0], points[0]
        cut = next(k for k, answer in enumerate(answers) if not answer)
        low, high = points[cut - 1], points[cut]
    return low, high


def mixing_exponent(
    totals: DataFrame, target_entropy: float, repetition_limit: float, budget: float | None
) -> tuple[float, float, float]:
    """(exponent, budget in tokens, normaliser). ``totals``: tokens per source."""
    head = totals.where("tokens > 0").agg(F.max("tokens"), F.count(F.lit(1))).first()
    largest, sources = float(head[0] or 1.0), head[1]
    if not sources:
        return 1.0, 0.0, 1.0

    def mixed(row) -> float:
        return budget if budget is not None else row["least"] * row["z"]

    def entropy_reached(row) -> bool:
        return math.log(row["z"]) - row["wx"] / row["z"] >= target_entropy * math.log(sources)

    def repeats_too_often(row) -> bool:
        return mixed(row) / row["z"] * row["most"] > repetition_limit

    exponent = max(_bisected(totals, largest, entropy_reached)[0], _bisected(totals, largest, repeats_too_often)[1])
    row = _moments(totals, [exponent], largest)[0]
    allowed = repetition_limit * row["z"] / row["most"]
    return exponent, min(mixed(row), allowed), row["z"]


def mixing_plan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    target_entropy: float = 0.98, repetition_limit: float = 1.5, budget: float | None = None,
    block_docs: int = BLOCK_DOCS, seed: int = 0, folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The measured rows, and the plan: one row per source, block and pass.

    Of a plan row, ``cut`` is the last hash order that enters the pass; null stands for the whole block.
    """
    rows = measured(docs, doc_id, text, source, seed)
    narrow = stage(rows.select("_source", "_tokens", "_order"), "mixing-rows", folder)
    totals = stage(
        narrow.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")),
        "mixing-sources", folder,
    )
    exponent, mixed, z = mixing_exponent(totals, target_entropy, repetition_limit, budget)
    largest = float(totals.agg(F.max("tokens")).first()[0] or 1.0)
    weight = F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(largest))) / F.lit(z)
    sources = totals.select(
        "_source", "tokens",
        F.ceil(F.col("n") / F.lit(block_docs)).alias("blocks"),
        F.when(F.col("tokens") > 0, weight).otherwise(0.0).alias("weight"),
        # Rounded, as the budget of a source passed over k times can miss k passes by a rounding error.
        F.when(F.col("tokens") > 0, F.round(weight * F.lit(mixed))).otherwise(0.0).cast("bigint").alias("share"),
    )
    rows = rows.join(sources.select("_source", "blocks"), "_source")
    rows = rows.withColumn("_block", F.pmod("_order", "blocks")).drop("blocks")
    narrow = narrow.join(sources, "_source").withColumn("_block", F.pmod("_order", "blocks"))
    blocks = narrow.groupBy("_source", "_block", "tokens", "weight", "share").agg(F.sum("_tokens").alias("held"))
    passes = F.when(F.col("tokens") > 0, F.ceil(F.col("share") / F.col("tokens"))).otherwise(1)
    visits = (
        blocks.withColumn("passes", passes.cast("bigint"))
        .where("passes > 0")
        .withColumn("epoch", F.explode(F.expr("sequence(0L, passes - 1)")))
    )
    visits = visits.withColumn("_turn", F.xxhash64(F.lit(seed), "_source", "epoch", "_block"))
    visits = running_total(visits, ["_source", "epoch"], ["_turn", "_block"], "held", "start", folder).withColumn(
        "left", F.col("share") - F.col("epoch") * F.col("tokens") - F.col("start")
    )
    visits = visits.where("left > 0 OR held = 0 AND left >= 0 OR tokens = 0").select(
        "_source", "_block", "epoch", "weight", "held", "left",
        F.when(F.col("tokens") > 0, (F.col("epoch") * F.col("tokens") + F.col("start")) / F.col("share"))
        .otherwise(0.0).alias("at"),
    )
    within = Window.partitionBy("_source", "_block", "epoch").orderBy("_order")
    cuts = (
        narrow.select("_source", "_block", "_tokens", "_order")
        .join(visits.where("left < held").select("_source", "_block", "epoch", "left"), ["_source", "_block"])
        .withColumn("used", F.sum("_tokens").over(within))
        .where("used <= left")
        .groupBy("_source", "_block", "epoch").agg(F.max("_order").alias("cut"))
    )
    visits = visits.join(cuts, ["_source", "_block", "epoch"], "left").where("left >= held OR cut IS NOT NULL")
    return rows, stage(visits.select("_source", "_block", "epoch", "weight", "at", "cut"), "mixing-plan", folder)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc (the whole row), tokens, block, epoch, weight, at: a row for each time a document is in the mix."""
    rows, plan = mixing_plan(docs, doc_id, text, source, **options)
    return (
        rows.join(plan, ["_source", "_block"])
        .where("cut IS NULL OR _order <= cut")
        .select("doc", F.col("_tokens").alias("tokens"), F.col("_block").alias("block"), "epoch", "weight", "at")
    )
