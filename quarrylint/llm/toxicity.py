"""Toxicity by maximum-scoring segments of token log-odds.

1. Document frequencies of words and of stems (their first letters) are counted by label. A word's
   log-odds have Dirichlet pseudo-counts at the odds of its stem, a stem's at the odds of all; words
   that no labelled text has are scored by their stem.
2. Every token scores its log-odds less ``MARGIN``. One linear scan of a text (Ruzzo and Tompa) finds
   all maximal segments of positive score.
3. Segment scores follow an extreme-value law in texts that are not toxic: lambda solves
   E[exp(lambda * score)] = 1 over their tokens, K is fitted to their best segments. A segment of score
   S in a text of n tokens counts lambda * S - ln(K n) if positive, and the sum over segments becomes a
   probability by a logistic curve.

The classifier is fitted on at most ``max_labels`` labelled documents (those with the smallest hash of their
identifier); all their terms in ``LEAST_DOCS`` documents or more count, so that parameter bounds what is sent to
tasks and to the driver. Every text is scored whole.

A null text is empty; empty texts have no segment and get the lowest score. Rows with a null label teach
nothing; if rows label a document both ways, it counts as toxic. Without toxic or without other
examples, every token is neutral. Repeated rows get the same answer. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylint.functions.staging import stage

WORD = re.compile(r"\w+")
STEM_LETTERS = 4
WORD_PRIOR = 10.0
STEM_PRIOR = 10.0
MARGIN = 1.0
LEAST_DOCS = 3
REMEMBERED = 1_000_000


def word_key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)


def stem_key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(b"\0" + word[:STEM_LETTERS].encode()) - (1 << 63)


def words_of(content: bytes) -> list[str]:
    return WORD.findall(content.decode("utf-8", "replace").lower())


def document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (toxic, content) to (term, stem, toxic, plain): documents of a batch with a term.

    The stem of a word's row is its stem's term; a stem's row has itself.
    """
    keys: dict[str, tuple[int, int]] = {}
    for batch in batches:
        counts: dict[tuple[int, int], list[int]] = {}
        for toxic, content in zip(batch["toxic"].to_pylist(), batch["content"]):
            terms = set()
            for word in set(words_of(content.as_py())):
                if word not in keys:
                    keys[word] = (word_key(word), stem_key(word))
                terms.add(keys[word])
                terms.add((keys[word][1],) * 2)
            for term in terms:
                counts.setdefault(term, [0, 0])[not toxic] += 1
        if len(keys) > REMEMBERED:
            keys.clear()
        if counts:
            terms, found = np.array(list(counts)), np.array(list(counts.values()))
            columns = [terms[:, 0], terms[:, 1], found[:, 0], found[:, 1]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["term", "stem", "toxic", "plain"])


@dataclass(frozen=True)
class Weights:
    """Scores of terms, by sorted key; ``rate`` is the lambda of the extreme-value law."""

    keys: np.ndarray
    scores: np.ndarray
    rate: float

    def of(self, word: str) -> float:
        for key in (word_key(word), stem_key(word)):
            place = np.searchsorted(self.keys, key)
            if place < len(self.keys) and self.keys[place] == key:
                return float(self.scores[place])
        return -MARGIN


def log_odds(toxic: np.ndarray, plain: np.ndarray, prior: np.ndarray, strength: float, base: float) -> np.ndarray:
    """Log-odds of documents with a term against the ``base`` share, pseudo-counts by ``prior`` share."""
    share = (toxic + strength * prior) / (toxic + plain + strength)
    return np.log(share / (1 - share)) - math.log(base / (1 - base))


def weights_of(terms: np.ndarray, base: float) -> Weights:
    """``terms``: columns term, stem, toxic, plain; ``base``: share of toxic documents."""
    if not 0 < base < 1 or not len(terms):
        return Weights(np.empty(0, np.int64), np.empty(0), 1.0)
    terms = terms[np.argsort(terms[:, 0], kind="stable")]
    key, stem, toxic, plain = terms.T
    is_stem = key == stem
    stem_share = (toxic + STEM_PRIOR * base) / (toxic + plain + STEM_PRIOR)
    at = np.minimum(np.searchsorted(key, stem), len(key) - 1)
    prior = np.where(is_stem | (key[at] != stem), base, stem_share[at])
    scores = log_odds(toxic, plain, prior, np.where(is_stem, STEM_PRIOR, WORD_PRIOR), base) - MARGIN
    rest = plain[is_stem].astype(float)
    stems = key[is_stem]
    own = np.searchsorted(stems, stem[~is_stem])
    inside = (own < len(stems)) & (stems[np.minimum(own, max(len(stems) - 1, 0))] == stem[~is_stem])
    np.subtract.at(rest, own[inside], plain[~is_stem][inside])
    often = np.concatenate([plain[~is_stem], np.maximum(rest, 0)])
    rate = extreme_value_rate(np.concatenate([scores[~is_stem], scores[is_stem]]), often)
    return Weights(key, scores, rate)


def extreme_value_rate(scores: np.ndarray, often: np.ndarray) -> float:
    """The positive lambda with sum(often * exp(lambda * score)) = sum(often)."""
    if not (often[scores > 0] > 0).any():
        return 1.0
    share, low, high = often / often.sum(), 0.0, 1.0

    def above(rate: float) -> bool:
        return float(share @ np.exp(np.minimum(rate * scores, 700))) > 1

    while not above(high) and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if above(middle) else (middle, high)
    return max(low, 1e-3)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa, in one scan.

    Only positive scores can open or extend a segment, so the scan visits those alone; the sums
    between them come from the running total.
    """
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, total before, total after, link to the last one with a smaller total before
    for place in np.flatnonzero(scores > 0):
        now = [int(place), int(place) + 1, upto[place], upto[place + 1]]
        link = len(found) - 1
        while True:
            while link >= 0 and found[link][2] >= now[2]:
                link = found[link][4]
            if link < 0 or found[link][3] >= now[3]:
                found.append([*now, link])
                break
            now[0], now[2] = found[link][0], found[link][2]
            below = found[link][4]
            del found[link:]
            link = below
    return [(start, end, after - before) for start, end, before, after, _ in found]


SEGMENTS = "array<struct<start: int, stop: int, score: double>>"


def scan_texts(weights: Weights, carried: list[str]):
    """mapInArrow function: adds n_tokens and segments to the carried columns."""
    fields = [("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Scores(dict):
            def __missing__(self, word: str) -> float:
                value = self[word] = weights.of(word)
                return value

        known = Scores()
        for batch in batches:
            sizes, found = [], []
            for content in batch["content"]:
                words = words_of(content.as_py())
                scores = np.fromiter(map(known.__getitem__, words), dtype=float, count=len(words))
                sizes.append(len(words))
                found.append([dict(zip(("start", "stop", "score"), s)) for s in segments(scores)])
            if len(known) > REMEMBERED:
                known.clear()
            yield pa.RecordBatch.from_arrays(
                [batch[name] for name in carried]
                + [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.struct(fields)))],
                names=[*carried, "n_tokens", "segments"],
            )

    return scan


def evidence(rate: float, log_k: float) -> Column:
    """Sum over segments of how far they exceed what chance gives in a text of that length."""
    level = F.log("n_tokens") + F.lit(log_k)
    return F.aggregate(
        "segments", F.lit(0.0), lambda total, s: total + F.greatest(F.lit(rate) * s["score"] - level, F.lit(0.0))
    )


def logistic_fit(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) by Newton steps, with a weak prior that keeps separable data finite."""
    beta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        total = positive + negative
        gradient = design.T @ (positive - total * p) - 0.1 * beta
        hessian = (design * (total * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


@dataclass(frozen=True)
class ToxicityModel:
    weights: Weights
    log_k: float
    slope: float
    intercept: float

    def scored(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, n_tokens, segments (word ranges with scores) and score, per document."""
        rows = docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"),
            F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"),
        )
        found = rows.mapInArrow(scan_texts(self.weights, ["doc_id"]), f"doc_id bigint, n_tokens bigint, segments {SEGMENTS}")
        x = F.log1p(evidence(self.weights.rate, self.log_k))
        chance = 1 / (1 + F.exp(-(F.lit(self.slope) * x + F.lit(self.intercept))))
        return found.select("*", chance.alias("score"))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_labels: int = 200_000, folder: str | None = None,
) -> ToxicityModel:
    """Learn from the labelled rows of ``docs``; pass only rows that may be learned from.

    At most ``max_labels`` labelled documents are learned from, chosen by a hash of their identifiers among
    those that ``docs`` has. All their terms count, so this bound is that of the model, too.
    """
    own = docs.select(F.col(doc_id).alias("own"))
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("own")).agg(F.max(label).alias("toxic"))
        .join(own, "own", "left_semi").orderBy(F.xxhash64("own"), "own").limit(max_labels)
    )
    texts = docs.select(
        F.col(doc_id).alias("own"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content")
    ).join(F.broadcast(chosen), "own").select(F.col("toxic").cast("int").alias("toxic"), "content")
    terms = (
        texts.mapInArrow(document_terms, "term bigint, stem bigint, toxic bigint, plain bigint")
        .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
        .where(F.col("toxic") + F.col("plain") >= LEAST_DOCS)
    )
    table = terms.toArrow()
    shares = texts.agg(F.avg("toxic")).first()[0]
    weights = weights_of(np.array([column.to_numpy() for column in table.columns]).T, float(shares or 0.0))
    scans = stage(
        texts.mapInArrow(scan_texts(weights, ["toxic"]), f"toxic int, n_tokens bigint, segments {SEGMENTS}").where("n_tokens > 0"),
        "toxicity-scans", folder,
    )
    best = F.array_max(F.transform("segments", lambda s: s["score"]))
    log_k = scans.where("toxic = 0").agg(
        F.avg(F.lit(weights.rate) * F.coalesce(best, F.lit(0.0)) - F.log("n_tokens"))
    ).first()[0]
    log_k = float(log_k or 0.0) - float(np.euler_gamma)
    counts = (
        scans.select("toxic", F.round(F.log1p(evidence(weights.rate, log_k)), 2).alias("x"))
        .groupBy("x").agg(F.sum("toxic").alias("positive"), F.count(F.lit(1)).alias("n")).collect()
    )
    x, positive, n = (np.array([row[k] for row in counts], dtype=float) for k in range(3))
    slope, intercept = logistic_fit(x, positive, n - positive)
    return ToxicityModel(weights, log_k, slope, intercept)
