"""Language-model scoring: n-grams with Katz backoff, learned from all texts that may be learned from.

Texts are kept as *parts*: one row holds about a million tokens as numbers into the part's own word list.
Counts are gathered and looked up in one exchange per order: each part sends its distinct n-grams with
their counts to the buckets of their histories, which add them up and send the totals back to the parts.
So an n-gram crosses the network once per part, however often it occurs, and no table is broadcast.

- Words: P(w) = d(c) c / N. What discounting leaves is the chance of an unknown word.
- Longer n-grams, pairs first, up to ``order`` words: P(w|h) = d(c) c / c(h) for those seen in training, else
  alpha(h) P(w|h'), where h' is h without its first word and alpha(h) is what the n-grams of h leave, divided by
  what P(.|h') leaves for words not seen after h. Both sums are exact, over all n-grams of the history. A
  history never seen has P(w|h) = P(w|h'). Each order adds one exchange; what it says is staged for the next.
- d is the Good-Turing discount after Katz for counts up to ``TOP``. If the counts of counts give no
  discount between 0 and 1, half a count is taken off instead; a history whose counts are all above ``TOP``
  lends the weight of one count. Every distribution sums to 1 over the words known and the unknown word.

A frequent history is spread over several buckets by the following word: as many as its share of all
tokens asks for. Totals of its pieces are added up by each part.

Words are told apart by hashes of 64 bits, and so are histories of two words and more.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end; the first word follows starts. A
null text is empty and has its end only. Repeated rows count as often as they stand; null identifiers are
kept and are not held out. Empty tables give empty results; other columns are ignored. Without training
texts every token is unknown and has probability 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylint.functions.staging import stage

TOP = 5
PART_TOKENS = 1_000_000
REMEMBERED = 300_000
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
START = np.uint64(xxhash.xxh3_64_intdigest(b"\n\n"))
PARTS = "part bigint, ids array<bigint>, learned binary, sizes binary, words binary, tokens binary"
ASKED = "bucket int, part bigint, histories binary, followers binary, words binary, shorter binary, counts binary"
TOLD = "part bigint, bucket int, totals binary, seen binary, ones binary, mass binary"
_CODEC = "zstd"


def _pack(values: np.ndarray) -> bytes:
    """Compressed byte by byte of all values: the high bytes of small numbers cost next to nothing."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec=_CODEC, asbytes=True)


def _unpack(content: bytes, kind) -> np.ndarray:
    size, width = int.from_bytes(content[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(content[8:], size, codec=_CODEC, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


class _WordKeys(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_keys = _WordKeys()


def token_keys(content: bytes) -> np.ndarray:
    if len(_keys) > REMEMBERED:
        _keys.clear()
    words = content.lower().split()
    keys = np.empty(len(words) + 1, dtype=np.uint64)
    keys[:-1] = np.fromiter(map(_keys.__getitem__, words), dtype=np.uint64, count=len(words))
    keys[-1] = END
    return keys


def make_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (doc_id, learned, content) to parts."""
    task, number = TaskContext.get().partitionId(), 0
    ids, learned, texts, total = [], [], [], 0

    def part() -> pa.RecordBatch:
        sizes = np.array([len(text) for text in texts], dtype=np.int64)
        words, tokens = np.unique(np.concatenate(texts), return_inverse=True)
        return pa.RecordBatch.from_pylist(
            [{
                "part": (task << 24) + number, "ids": ids, "learned": _pack(np.array(learned, dtype=np.uint8)),
                "sizes": _pack(sizes), "words": words.tobytes(), "tokens": _pack(tokens.astype(np.uint32)),
            }],
            schema=pa.schema([
                ("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("learned", pa.binary()), ("sizes", pa.binary()),
                ("words", pa.binary()), ("tokens", pa.binary()),
            ]),
        )

    for batch in batches:
        for doc_id, learn, content in zip(batch["doc_id"].to_pylist(), batch["learned"].to_pylist(), batch["content"]):
            ids.append(doc_id)
            learned.append(learn)
            texts.append(token_keys(content.as_py()))
            total += len(texts[-1])
            if total >= PART_TOKENS:
                yield part()
                number += 1
                ids, learned, texts, total = [], [], [], 0
    if texts:
        yield part()


@dataclass(frozen=True)
class Part:
    ids: list
    learned: np.ndarray  # per document
    sizes: np.ndarray  # tokens per document
    words: np.ndarray  # sorted keys
    tokens: np.ndarray  # places in words
    doc: np.ndarray  # document of each token

    @staticmethod
    def of(row: dict) -> Part:
        sizes = _unpack(row["sizes"], np.int64)
        return Part(
            row["ids"], _unpack(row["learned"], np.uint8).astype(bool), sizes,
            np.frombuffer(row["words"], dtype=np.uint64), _unpack(row["tokens"], np.uint32).astype(np.int64),
            np.repeat(np.arange(len(sizes)), sizes),
        )

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.learned[self.doc]], minlength=len(self.words))


def _high(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a key: ranges of equal width, so buckets of sorted keys are slices."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _longer(histories: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their histories and words."""
    keys = (histories ^ (histories >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


@dataclass(frozen=True)
class Histories:
    """What the tokens of a part follow; the last history is that of a text's first token."""

    of_token: np.ndarray  # the history that each token ends, for the token after it
    keys: np.ndarray
    often: np.ndarray  # training count over all parts

    @staticmethod
    def words(part: Part, known: np.ndarray) -> Histories:
        texts = known[np.searchsorted(part.words, END)]
        return Histories(part.tokens, np.append(part.words, START), np.append(known, texts))


@dataclass(frozen=True)
class Grams:
    """Distinct n-grams of a part, in the order in which they are sent, and histories by bucket."""

    token_gram: np.ndarray  # n-gram of each token
    history: np.ndarray  # per n-gram: place among histories
    word: np.ndarray
    counts: np.ndarray  # training count in this part
    shorter: np.ndarray  # chance of the n-gram without its first word
    group: np.ndarray  # per n-gram: its (bucket, history)
    group_bucket: np.ndarray
    group_history: np.ndarray
    histories: Histories

    @staticmethod
    def of(part: Part, histories: Histories, chance: np.ndarray, total: int, buckets: int) -> Grams:
        """``chance``: of each token by shorter n-grams; ``total``: training tokens of all parts."""
        size, keys = len(histories.keys), histories.keys
        before = np.empty_like(part.tokens)
        before[1:] = histories.of_token[:-1]
        before[np.cumsum(part.sizes) - part.sizes] = size - 1
        codes, token_gram = np.unique(before * len(part.words) + part.tokens, return_inverse=True)
        counts = np.bincount(token_gram, weights=part.learned[part.doc], minlength=len(codes)).astype(np.int64)
        history, word = codes // len(part.words), codes % len(part.words)
        pieces = np.clip(-(-histories.often * buckets // max(total, 1)), 1, buckets)
        home = _high(keys, buckets)
        piece = (part.words[word] & np.uint64(0xFFFFFFFF)).astype(np.int64) % pieces[history]
        bucket = (home[history] + piece) % buckets
        order = np.lexsort((word, history, bucket))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        shorter = np.empty(len(order))
        shorter[place[token_gram]] = chance
        used = np.unique(history)
        all_history = np.repeat(used, pieces[used])
        first = np.cumsum(pieces[used]) - pieces[used]
        all_bucket = (home[all_history] + np.arange(len(all_history)) - np.repeat(first, pieces[used])) % buckets
        groups = np.unique(all_bucket * size + all_history)
        return Grams(
            place[token_gram], history[order], word[order], counts[order], shorter,
            np.searchsorted(groups, bucket[order] * size + history[order]), groups // size, groups % size, histories,
        )

    def told(self, part: Part, told: list[dict], discounts: Discounts) -> tuple[np.ndarray, Histories]:
        """From what all parts have: the chance of each token, and these n-grams as histories of longer ones."""
        factor, size = discounts.factor, len(self.histories.keys)
        counts = np.concatenate([_unpack(t["totals"], np.int64) for t in told])

        def sums(values: np.ndarray) -> np.ndarray:
            return np.bincount(self.group_history, weights=values, minlength=size)

        seen = sums(np.concatenate([_unpack(t["seen"], np.int64) for t in told]))
        ones_told = np.concatenate([_unpack(t["ones"], np.int64).reshape(-1, TOP) for t in told]).astype(float)
        mass = sums(np.concatenate([_unpack(t["mass"], np.float64) for t in told]))
        lent = np.stack([sums(ones_told[:, r]) for r in range(TOP)], axis=1) @ ((1 - factor[1:]) * np.arange(1, TOP + 1))
        scale = np.where(lent > 0, seen, seen + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(seen > 0, np.where(lent > 0, lent, 1.0) / scale / (1 - mass), 1.0)
            chance = np.where(
                counts > 0, discounts.discounted(counts) / scale[self.history], alpha[self.history] * self.shorter
            )
        keys, starts = self.histories.keys, self.histories.keys[-1:]
        longer = Histories(
            self.token_gram, np.append(_longer(keys[self.history], part.words[self.word]), _longer(starts, starts)),
            np.append(counts, self.histories.often[-1]),
        )
        return chance[self.token_gram], longer


def _rows(table: list[dict], names: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in names.split(", "))])
    return pa.RecordBatch.from_pylist(table, schema=schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as each of them is large."""
    for batch in batches:
        for place in range(batch.num_rows):
            yield batch.slice(place, 1).to_pylist()[0]


def ask_words(buckets: int):
    """mapInArrow function: parts to what they ask of each bucket about single words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            part = Part.of(row)
            counts, edges = part.word_counts(), np.searchsorted(_high(part.words, buckets), np.arange(buckets + 1))
            yield _rows([
                {"bucket": b, "part": row["part"], "histories": part.words[low:high].tobytes(), "counts": _pack(counts[low:high])}
                for b, (low, high) in enumerate(zip(edges[:-1], edges[1:])) if high > low
            ], ASKED)

    return ask


def _counts_of_counts(totals: np.ndarray) -> bytes:
    """[sum, distinct, number with count 1, 2, … TOP + 1]"""
    small = np.bincount(totals[totals <= TOP + 1], minlength=TOP + 2)[1:]
    return np.concatenate([[totals.sum(), np.count_nonzero(totals)], small]).astype(np.int64).tobytes()


def total_words(table: pa.Table) -> pa.Table:
    """applyInArrow function of a bucket: to each part the training counts of its words and their places.

    ``seen`` has the places among the bucket's distinct words; part -1 has statistics and the number of these.
    """
    rows = table.to_pylist()
    keys = [np.frombuffer(row["histories"], dtype=np.uint64) for row in rows]
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unpack(row["counts"], np.int64) for row in rows])
    totals = np.zeros(len(unique), dtype=np.int64)
    np.add.at(totals, inverse, counts)
    number = _pack(np.array([len(unique)], dtype=np.int64))
    told, at = [{"part": -1, "bucket": rows[0]["bucket"], "totals": _counts_of_counts(totals), "seen": number}], 0
    for row, own in zip(rows, keys):
        places = inverse[at : at + len(own)].astype(np.int64)
        told.append({
            "part": row["part"], "bucket": row["bucket"], "totals": _pack(totals[places]), "seen": _pack(places),
        })
        at += len(own)
    return pa.Table.from_batches([_rows(told, TOLD)])


@dataclass(frozen=True)
class Discounts:
    """``factor[c]`` for counts 1 … TOP; index 0 is unused."""

    total: int
    distinct: int
    factor: np.ndarray

    @staticmethod
    def of(statistics: np.ndarray) -> Discounts:
        n = np.concatenate([[0], statistics[2:]]).astype(float)
        r = np.arange(1, TOP + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = (TOP + 1) * n[TOP + 1] / n[1]
            factor = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
        if not np.all((factor > 0) & (factor < 1)):
            factor = (r - 0.5) / r
        return Discounts(int(statistics[0]), int(statistics[1]), np.concatenate([[0.0], factor]))

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= TOP, self.factor[np.minimum(counts, TOP)], 1.0)


@dataclass(frozen=True)
class Words:
    discounts: Discounts
    scale: float
    unknown: float

    @staticmethod
    def of(statistics: np.ndarray) -> Words:
        discounts = Discounts.of(statistics)
        small = statistics[2 : 2 + TOP]
        lent = float(((1 - discounts.factor[1:]) * np.arange(1, TOP + 1) * small).sum())
        scale = discounts.total if lent else discounts.total + 1
        return Words(discounts, float(max(scale, 1)), (lent or 1.0) / max(scale, 1))

    def chance(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.discounted(counts) / self.scale, self.unknown)


@dataclass(frozen=True)
class Model:
    """What is known of all parts; ``discounts`` are those of pairs and longer n-grams, as far as they are counted."""

    words: Words
    first_codes: dict[int, int]
    buckets: int
    discounts: tuple[Discounts, ...] = ()

    def climb(self, part: Part, row: dict) -> tuple[np.ndarray, Histories]:
        """Order by order: the chance of each token by what was told, and the histories of the next order."""
        known = _known(row)
        chance, histories = self.words.chance(known)[part.tokens], Histories.words(part, known)
        for number, discounts in enumerate(self.discounts, 2):
            chance, histories = self.grams(part, histories, chance).told(part, row[f"totals_{number}"], discounts)
        return chance, histories

    def grams(self, part: Part, histories: Histories, chance: np.ndarray) -> Grams:
        return Grams.of(part, histories, chance, self.words.discounts.total, self.buckets)


def ask_grams(model: Model):
    """mapInArrow function: parts with what they were told to what they ask of each bucket about the next order.

    Words go by code: their number among all distinct words, of which ``first_codes`` has the first of each bucket
    (and, as -1, the number of all, the code of the start). Codes are small numbers, in order here. So do
    histories of one word; longer ones go by key. Of shorter n-grams, words go by count, others by chance.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            part, known, buckets = Part.of(row), _known(row), model.buckets
            chance, histories = model.climb(part, row)
            grams = model.grams(part, histories, chance)
            codes = np.concatenate([
                model.first_codes[told["bucket"]] + _unpack(told["seen"], np.int64) for told in row["word_totals"]
            ])
            if model.discounts:
                history_codes, shorter = histories.keys.view(np.int64), grams.shorter
            else:
                history_codes, shorter = np.append(codes, model.first_codes[-1]), known[grams.word]
            group_edges = np.searchsorted(grams.group_bucket, np.arange(buckets + 1))
            edges = np.searchsorted(grams.group, group_edges)
            followers = np.bincount(grams.group, minlength=len(grams.group_bucket))
            for b in range(buckets):
                groups, own = slice(*group_edges[b : b + 2]), slice(*edges[b : b + 2])
                if groups.start == groups.stop:
                    continue
                yield _rows([{
                    "bucket": b, "part": row["part"], "histories": _pack(history_codes[grams.group_history[groups]]),
                    "followers": _pack(followers[groups]), "words": _pack(codes[grams.word[own]]),
                    "shorter": _pack(shorter[own]), "counts": _pack(grams.counts[own]),
                }], ASKED)

    return ask


def total_grams(words: Words | None):
    """applyInArrow function of a bucket: to each part the counts of its n-grams and sums over its histories.

    ``words`` turns counts of words into chances; without it, parts have sent chances.
    """

    def totals_of(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        histories = [_unpack(row["histories"], np.int64) for row in rows]
        unique, group = np.unique(np.concatenate(histories), return_inverse=True)
        followers = np.concatenate([_unpack(row["followers"], np.int64) for row in rows])
        history = np.repeat(group, followers)
        word = np.concatenate([_unpack(row["words"], np.int64) for row in rows])
        shorter = np.concatenate([_unpack(row["shorter"], np.int64 if words else np.float64) for row in rows])
        counts = np.concatenate([_unpack(row["counts"], np.int64) for row in rows])
        order = np.lexsort((word, history))
        opens = np.ones(len(order), dtype=bool)
        opens[1:] = (history[order[1:]] != history[order[:-1]]) | (word[order[1:]] != word[order[:-1]])
        gram = np.empty(len(order), dtype=np.int64)
        gram[order] = np.cumsum(opens) - 1
        heads = order[opens]
        totals = np.zeros(len(heads), dtype=np.int64)
        np.add.at(totals, gram, counts)
        of, size = history[heads], len(unique)
        seen = np.zeros(size, dtype=np.int64)
        np.add.at(seen, of, totals)
        ones = np.stack([np.bincount(of[totals == r], minlength=size) for r in range(1, TOP + 1)], axis=1)
        chance = np.where(totals > 0, words.chance(shorter[heads]) if words else shorter[heads], 0.0)
        mass = np.bincount(of, weights=chance, minlength=size)
        told = [{"part": -1, "bucket": rows[0]["bucket"], "totals": _counts_of_counts(totals)}]
        at_group = at_gram = 0
        for row, own in zip(rows, histories):
            groups = group[at_group : at_group + len(own)]
            number = int(followers[at_group : at_group + len(own)].sum())
            told.append({
                "part": row["part"], "bucket": row["bucket"],
                "totals": _pack(totals[gram[at_gram : at_gram + number]]),
                "seen": _pack(seen[groups]), "ones": _pack(ones[groups]), "mass": _pack(mass[groups]),
            })
            at_group += len(own)
            at_gram += number
        return pa.Table.from_batches([_rows(told, TOLD)])

    return totals_of


def _known(row: dict) -> np.ndarray:
    return np.concatenate([_unpack(told["totals"], np.int64) for told in row["word_totals"]])


SCORES = (
    "doc_id bigint, learned boolean, n_tokens bigint, n_known bigint, base_score double, score double"
)


def score_parts(model: Model):
    """mapInArrow function: parts with all that was told to one row per document."""
    total, distinct = model.words.discounts.total, model.words.discounts.distinct

    def score(row: dict) -> pa.RecordBatch:
        part, known = Part.of(row), _known(row)
        chance, _ = model.climb(part, row)
        number = len(part.ids)
        base = np.log10((known + 0.1) / (total + 0.1 * (distinct + 1)))
        return _rows(
            [
                dict(zip(("doc_id", "learned", "n_tokens", "n_known", "base_score", "score"), values))
                for values in zip(
                    part.ids, part.learned.tolist(), part.sizes.tolist(),
                    np.bincount(part.doc, weights=(known > 0)[part.tokens], minlength=number).astype(int).tolist(),
                    np.bincount(part.doc, weights=base[part.tokens], minlength=number).tolist(),
                    np.bincount(part.doc, weights=np.log10(chance), minlength=number).tolist(),
                )
            ],
            SCORES,
        )

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield score(row)

    return scores


def _statistics(told: DataFrame) -> np.ndarray:
    """Statistics of all buckets, added up; they are one short row each."""
    rows = told.where("part = -1").select("totals").toArrow()["totals"].to_pylist()
    return sum((np.frombuffer(row, dtype=np.int64) for row in rows), np.zeros(TOP + 3, dtype=np.int64))


def _first_codes(told: DataFrame) -> dict[int, int]:
    """The code of each bucket's first word; as -1 the number of all words."""
    first, codes = 0, {}
    for bucket, seen in sorted(map(tuple, told.where("part = -1").select("bucket", "seen").collect())):
        codes[bucket] = first
        first += int(_unpack(bytes(seen), np.int64)[0])
    return {**codes, -1: first}


def _by_part(told: DataFrame, name: str) -> DataFrame:
    fields = F.struct(*(c for c in told.columns if c != "part"))
    return told.where("part >= 0").groupBy("part").agg(F.sort_array(F.collect_list(fields)).alias(name))


def katz_scores(
    docs: DataFrame, learned: Column, doc_id: str = "doc_id", text: str = "text", folder: str | None = None,
    order: int = 2,
) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score (log10) per document.

    ``learned`` is true for rows that the model is learned from, ``order`` the most words of an n-gram (1: words
    alone).
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Parts stay where they are: their table is bucketed, so that only answers move to them.
    name = f"katz_parts_{uuid.uuid4().hex}"
    (
        docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"), learned.alias("learned"),
            F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"),
        )
        .mapInArrow(make_parts, PARTS)
        .write.bucketBy(buckets // 2, "part").sortBy("part").saveAsTable(name)
    )
    parts = spark.table(name)
    told_words = stage(
        parts.mapInArrow(ask_words(buckets), ASKED).groupBy("bucket").applyInArrow(total_words, TOLD), "katz-words", folder
    )
    model = Model(Words.of(_statistics(told_words)), _first_codes(told_words), buckets)
    with_told = parts.join(_by_part(told_words.select("part", "bucket", "totals", "seen"), "word_totals"), "part")
    for number in range(2, order + 1):
        told = stage(
            with_told.mapInArrow(ask_grams(model), ASKED).groupBy("bucket")
            .applyInArrow(total_grams(model.words if number == 2 else None), TOLD),
            f"katz-{number}", folder,
        )
        model = replace(model, discounts=(*model.discounts, Discounts.of(_statistics(told))))
        with_told = with_told.join(_by_part(told, f"totals_{number}"), "part")
    scored = with_told.mapInArrow(score_parts(model), SCORES)
    return scored.withColumn("train_tokens", F.lit(model.words.discounts.total).cast("bigint"))
