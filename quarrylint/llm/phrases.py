"""Mining phrases by best-first branch-and-bound growth.

A phrase is 2 to ``MOST`` neighbouring words of one piece of a text; pieces end at ``[.,;:!?]`` and line ends,
words at blanks and tabs, and A-Z are in lower case. Counts are per language, over all texts.

1. **Frontier**: words found ``least`` times or more. A phrase of count a, cut into parts of counts l and r,
   scores floor(1000 a n / (l r)), and the lowest cut counts. As a <= r and l <= f(first word), no
   phrase that a word starts (or, by a <= l, ends) scores above floor(1000 n / f(word)): an admissible
   bound from prefix counts.
2. **Growth**: the words of the highest bounds are expanded first: pairs, then longer phrases of which all
   neighbouring pairs are frequent. A phrase is counted if its first or its last word is expanded, so
   all parts and one-word extensions of a candidate are counted, too.
3. **Settling**: the ``top``-th surviving score of a language is a lower limit of the final one. All words whose
   bound reaches it (ties included, all words if there are fewer survivors) are expanded in a second round;
   whatever is left then scores below the limit that the second round finds, which cannot be lower.
4. A candidate is dropped if a longer phrase that holds it has ``percent`` of its count. Counts fall as
   phrases grow, so extensions by one word on either side decide it.

Sets of words and pairs reach the tasks as bit maps of fixed size: a false hit is counted for
nothing, and no phrase is lost. Counts and scores are exact (decimals of 38 digits).

A null text has no words, a null language is ``und``. Repeated rows count each; equal scores go by
count, then by phrase in byte order. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylint.functions.staging import stage

MOST = 5
SEED_SHARE = 0.125
MAP_BITS = 26
HELD = 200_000
REMEMBERED = 200_000
LANGS_HELD = 8
CHUNK_WORDS = 100_000
BREAK = b"."
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
FACTOR = np.uint64(0x9E3779B97F4A7C15)

PHRASES = "lang string, phrase binary, f bigint"


def words_of(content: bytes) -> list[bytes]:
    """Words of a text, with a BREAK between pieces."""
    return content.lower().translate(_ENDS).replace(BREAK, b" . ").split()


class Hashes(dict):
    """Numbers of words of one language, and those of neighbouring pairs."""

    def __init__(self, lang: str):
        super().__init__()
        self.seed = xxhash.xxh3_64_intdigest(lang.encode()) & 0xFFFFFFFF
        self.pause = np.uint64(xxhash.xxh3_64_intdigest(BREAK, seed=self.seed))

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, seed=self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    return (hashes[:-1] * FACTOR) ^ (hashes[1:] + (hashes[:-1] >> np.uint64(7)))


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes * FACTOR) >> np.uint64(64 - MAP_BITS)


class BitMap:
    """A set of hashes as a map of fixed size; may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        places = _places(hashes)
        return (self.bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _map_places(pairs: bool):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist()):
                hashes = Hashes(lang).of(phrase.split(b" "))
                found.append(int(_places(pair_hashes(hashes) if pairs else hashes)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["place"])

    return places


def bit_map(phrases: DataFrame, pairs: bool = False) -> Broadcast:
    """The map of (lang, phrase) rows, put together by aggregates; 2^MAP_BITS bits, however many rows."""
    placed = phrases.select("lang", "phrase").mapInArrow(_map_places(pairs), "place bigint")
    parts = (
        placed.select(F.expr("place + 1").alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << MAP_BITS - 3, dtype=np.uint8)
    for bucket, part in zip(parts["bucket"].to_pylist(), parts["bits"].to_pylist()):
        low = (bucket - 1) * len(part)
        stretch = bits[low : low + len(part)]
        stretch[:] = np.frombuffer(part, dtype=np.uint8)[: len(stretch)]
    return phrases.sparkSession.sparkContext.broadcast(bits)


def _counted(found) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, phrases) lists, added up as far as memory allows."""
    counts, held = {}, 0

    def rows() -> pa.RecordBatch:
        langs = pa.array([lang for lang, counter in counts.items() for _ in range(len(counter))], pa.string())
        phrases = pa.array([phrase for counter in counts.values() for phrase in counter], pa.binary())
        numbers = pa.array([n for counter in counts.values() for n in counter.values()], pa.int64())
        return pa.RecordBatch.from_arrays([langs, phrases, numbers], names=["lang", "phrase", "f"])

    for lang, phrases in found:
        counter = counts.setdefault(lang, Counter())
        held -= len(counter)
        counter.update(phrases)
        counter.pop(BREAK, None)
        held += len(counter)
        if held > HELD:
            yield rows()
            counts, held = {}, 0
    if held:
        yield rows()


def _chunks(words: list[bytes], overlap: int) -> Iterator[tuple[list[bytes], int]]:
    """Stretches of a long text that share ``overlap`` words, with the place up to which phrases start in each."""
    for low in range(0, len(words), CHUNK_WORDS):
        stretch = words[low : low + CHUNK_WORDS + overlap]
        if low + len(stretch) == len(words):
            yield stretch, len(stretch)
            return
        yield stretch, CHUNK_WORDS


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (lang, content) to counts of words."""

    def found():
        for batch in batches:
            for lang, content in zip(batch["lang"], batch["content"]):
                for words, _ in _chunks(words_of(content.as_py()), 0):
                    yield lang.as_py(), words

    yield from _counted(found())


def count_phrases(sizes: range, frequent: Broadcast, expanded: Broadcast, pairs: Broadcast | None):
    """mapInArrow function: (lang, content) to counts of phrases whose first or last word is expanded.

    All words have to be frequent, and so have all pairs of neighbours that have been counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, live = BitMap(frequent.value), BitMap(expanded.value)
        often_pairs = BitMap(pairs.value) if pairs is not None else None
        hashes_of = {}

        def found():
            for batch in batches:
                for lang, content in zip(batch["lang"].to_pylist(), batch["content"]):
                    if lang not in hashes_of:
                        if len(hashes_of) >= LANGS_HELD:
                            hashes_of.clear()
                        hashes_of[lang] = Hashes(lang)
                    for words, last in _chunks(words_of(content.as_py()), sizes[-1] - 1):
                        yield lang, list(phrases(hashes_of[lang], words, last))

        def phrases(numbers: Hashes, words: list[bytes], last: int) -> Iterator[bytes]:
            if len(words) < 2:
                return
            hashes = numbers.of(words)
            known = often.has(hashes) & (hashes != numbers.pause)
            at_end = live.has(hashes) & known
            linked = known[:-1] & known[1:]
            if often_pairs is not None:
                linked &= often_pairs.has(pair_hashes(hashes)) | ~(at_end[:-1] | at_end[1:])
            run = linked
            for size in range(2, sizes[-1] + 1):
                if size > 2:
                    run = run[:-1] & linked[size - 2 :]
                if size in sizes:
                    starts = np.flatnonzero(run & (at_end[: len(run)] | at_end[size - 1 :]))
                    for start in starts[starts < last].tolist():
                        yield b" ".join(words[start : start + size])

        yield from _counted(found())

    return count


def _added_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


class Growth:
    """Counts of one corpus, grown from the words of the highest bounds."""

    def __init__(self, docs: DataFrame, text: str, lang: str, least: int, top: int, percent: int, folder: str | None):
        self.texts = docs.select(
            F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
            F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"),
        )
        self.least, self.top, self.percent, self.folder = least, top, percent, folder
        counted = stage(_added_up(self.texts.mapInArrow(count_words, PHRASES)), "phrase-words", folder)
        self.totals = stage(counted.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals", folder)
        self.words = counted.where(F.col("f") >= least)
        self.frequent = bit_map(self.words)

    def seed(self) -> DataFrame:
        """Per language the lowest bound of the first words to expand: the rarest, up to a share of all words.

        Counts are taken by powers of two, so a language is a few rows.
        """
        steps = self.words.groupBy("lang", F.floor(F.log2("f")).alias("step")).agg(F.sum("f").alias("f"))
        upto = F.sum("f").over(Window.partitionBy("lang").orderBy("step"))
        first = F.min("step").over(Window.partitionBy("lang"))
        return (
            steps.select("lang", "step", upto.alias("upto"), first.alias("first")).join(self.totals, "lang")
            .where((F.col("upto") <= SEED_SHARE * F.col("n")) | (F.col("step") == F.col("first")))
            .groupBy("lang", "n").agg(F.max("step").alias("step"))
            .select("lang", F.expr("1000 * n div cast(power(2, step + 1) AS bigint) + 1").alias("least_bound"))
        )

    def expand(self, limits: DataFrame) -> DataFrame:
        """Counts of phrases of the languages of ``limits`` (lang, least_bound) from words that reach them."""
        bounded = self.words.join(self.totals, "lang").join(limits, "lang")
        live = bounded.where(F.expr("1000 * n div f") >= F.col("least_bound"))
        expanded, wanted = bit_map(live), self.texts.join(limits.select("lang"), "lang", "left_semi")
        often = F.col("f") >= self.least

        def counted(sizes: range, pairs: Broadcast | None) -> DataFrame:
            found = wanted.mapInArrow(count_phrases(sizes, self.frequent, expanded, pairs), PHRASES)
            return stage(_added_up(found).where(often), "phrase-counts", self.folder)

        two = counted(range(2, 3), None)
        more = counted(range(3, MOST + 1), bit_map(two, pairs=True))
        return two.unionByName(more).unionByName(self.words.join(limits.select("lang"), "lang", "left_semi"))

    def scored(self, counts: DataFrame, limits: DataFrame) -> DataFrame:
        """a, l, r, n, score of the surviving candidates among ``counts`` of which both ends are expanded."""
        size = F.size("words")
        known = counts.select("lang", F.col("phrase").cast("string").alias("phrase"), "f")
        split = known.withColumn("words", F.split("phrase", " ", -1)).where(size > 1)
        longer = split.where(size > 2).select(
            "lang", F.explode(F.array(
                F.array_join(F.slice("words", 1, size - 1), " "), F.array_join(F.slice("words", 2, size - 1), " ")
            )).alias("phrase"), F.col("f").alias("longer"),
        ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        kept = split.join(longer, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (100 * F.col("longer") < self.percent * F.col("f"))
        )
        cuts = kept.select(
            "lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
        ).select(
            "lang", "phrase", "a", "k", (size - 1).alias("cuts"), F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
            F.array_join(F.slice("words", F.col("k") + 1, size), " ").alias("tail"),
        )
        part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
        met = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
        wide = {name: f"cast({name} AS decimal(19,0))" for name in ("a", "n", "l", "r")}
        score = F.expr("1000 * ({a} * {n}) div ({l} * {r})".format(**wide))
        lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
        more = F.greatest(
            F.max(F.when(F.col("k") == 1, F.col("l"))), F.max(F.when(F.col("k") == F.col("cuts"), F.col("r")))
        ).alias("ends")
        scored = met.join(self.totals, "lang").groupBy("lang", "phrase", "a", "n", "cuts").agg(
            lowest, more, F.count(F.lit(1)).alias("known")
        )
        expanded = F.expr("1000 * n div ends") >= F.col("least_bound")
        return (
            scored.where("known = cuts").join(limits.select("lang", "least_bound"), "lang").where(expanded)
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        )

    def ranked(self, scored: DataFrame) -> DataFrame:
        """The first ``top`` of each language; a language is cut in parts first, so no task ranks it whole."""
        order = [F.desc("score"), F.desc("a"), F.col("phrase")]
        salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        few = salted.withColumn("place", place).where(F.col("place") <= self.top)
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
        return few.withColumn("rank", rank).where(F.col("rank") <= self.top).select(
            "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
        )


def phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, top: int = 2000, percent: int = 100,
    folder: str | None = None,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` surviving phrases of each language."""
    growth = Growth(docs, text, lang, least, top, percent, folder)
    seed = stage(growth.seed(), "phrase-limits", folder)
    first = stage(growth.ranked(growth.scored(growth.expand(seed), seed)), "phrase-ranked", folder)
    settled = first.where(F.col("rank") == top).select("lang", F.col("score").alias("reached"))
    limits = stage(
        seed.join(settled, "lang", "left").select(
            "lang", F.col("least_bound").alias("expanded"), F.coalesce("reached", F.lit(0)).alias("least_bound")
        ),
        "phrase-limits", folder,
    )
    open_ = limits.where("least_bound < expanded").select("lang", "least_bound")
    done = first.join(limits.where("least_bound >= expanded").select("lang"), "lang", "left_semi")
    if open_.isEmpty():
        return done
    return done.unionByName(growth.ranked(growth.scored(growth.expand(open_), open_)))
