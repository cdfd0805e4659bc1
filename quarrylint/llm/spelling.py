"""Grouping spelling variants by an index of variable-length grams.

1. **Words**: maximal runs of letters ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case. With ``mutate_every``, a
   run of a document whose crc32 of ``<doc_id>:<run>`` it divides loses one code point (planted slips).
2. **Dictionary**: grams of ``LEAST`` to ``MOST`` code points of the words between ``^`` and ``$``. Only grams
   found more than total / ``INNER`` times are made longer, so the dictionary is a trie of bounded size
   whatever the vocabulary, and lists stay short. All words are counted.
3. **Decomposition**: at each place the longest gram of the dictionary, unless an earlier one covers it.
4. **Bounds**: an edit at a place can change a gram only if the edited stretch could take part in a longer
   gram. What is safe is a run of first grams and a run of last ones. A word reads, for replacing,
   deleting and inserting, the lists of one gram of each side: the rarest ones of which every edit that
   leaves any gram safe leaves one. Places at which an edit may change all grams of a word
   (in short words) get a key of their own, the word without that place.
5. **Merging**: lists are kept by gram, length of word and place; words of one list are candidates, which
   are verified by edit distance, counted once, whichever lists they come from.

Every pair is met from both sides, so it is found unless an edit may change all grams of both words;
then both make the same key of the place. The result is exact.

Null texts have no words; a null identifier counts as an empty one. Repeated rows count each. Equal
counts of near words go to the smallest in code-point order. Empty tables give empty results, other
columns are ignored, and texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylint.functions.staging import stage, work_partitions

LEAST = 2
MOST = 8
INNER = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3,
    mutate_every: int | None = None,
) -> DataFrame:
    """word, n of all words long and frequent enough."""
    runs = F.split(F.translate(F.col(text), UPPER, LOWER), "[^a-zÀ-ÿ]+")
    words = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")
    ).where("run <> ''")
    if mutate_every:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = F.expr("cast(h % length(run) AS int)")
        slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        words = words.select(F.when(F.col("h") % mutate_every == 0, slip).otherwise(F.col("run")).alias("word"))
    else:
        words = words.select(F.col("run").alias("word"))
    counted = words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


class Grams:
    """The dictionary as a trie: counts of its grams, those that were made longer, and their ends."""

    def __init__(self, counts: dict[str, int], inner: set[str]):
        self.counts, self.inner = counts, inner
        self.ends = {gram[k:] for gram in counts for k in range(1, len(gram) - 1)}

    def decomposed(self, text: str) -> list[tuple[int, int]]:
        """(start, stop) of the grams of a word between its marks; starts and stops both grow."""
        counts, kept, last = self.counts, [], 0
        for start in range(len(text) - LEAST + 1):
            stop = start + LEAST
            while stop < len(text) and stop - start < MOST and text[start : stop + 1] in counts:
                stop += 1
            if stop > last:
                kept.append((start, stop))
                last = stop
        return kept

    def safe_ahead(self, text: str, kept: list[tuple[int, int]], place: int) -> int:
        """How many first grams stay as they are, whatever is at ``place`` and after it."""
        for start in range(max(0, place - MOST + 1), place - LEAST + 1):
            if text[start:place] in self.inner:
                break
        else:
            start = max(0, place - LEAST + 1)
        return sum(1 for at, _ in kept if at < start)

    def safe_behind(self, text: str, kept: list[tuple[int, int]], place: int) -> int:
        """The first of the last grams that stay as they are, whatever is ahead of ``place``."""
        first = len(kept)
        while first:
            at, stop = kept[first - 1]
            if at < place or (stop - place < MOST and text[place:stop] in self.ends):
                break
            first -= 1
        return first

    def rarest(self, text: str, kept: list[tuple[int, int]], edits: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(gram, side) of the lists to read: an edit given as (safe ahead, safe behind) leaves one of them."""

        def count(number: int) -> int:
            start, stop = kept[number]
            return self.counts.get(text[start:stop], 0)

        chosen, left = [], None
        ahead_only = [ahead for ahead, behind in edits if behind == len(kept) and ahead]
        if ahead_only:
            left = min(range(min(ahead_only)), key=count)
            chosen.append((left, 0))
        others = [behind for ahead, behind in edits if behind < len(kept) and not (left is not None and left < ahead)]
        if others:
            chosen.append((min(range(max(others), len(kept)), key=count), 1))
        return chosen

    def keys(self, word: str) -> tuple[set[int], set[int]]:
        """Keys of the lists that hold ``word``, and of those that it reads."""
        text, size = f"^{word}$", len(word)
        kept = self.decomposed(text)
        grams = [text[start:stop] for start, stop in kept]
        held = {_key(gram, size, start) for gram, (start, _) in zip(grams, kept)}
        ahead = [0, *(self.safe_ahead(text, kept, place) for place in range(1, size + 2))]
        behind = [0, *(self.safe_behind(text, kept, place) for place in range(1, size + 3))]
        changes = [(ahead[place], behind[place + 1]) for place in range(1, size + 1)]
        gaps = [(ahead[place], behind[place]) for place in range(1, size + 2)]
        read = set()
        for number, side in self.rarest(text, kept, changes):
            read.add(_key(grams[number], size, kept[number][0]))
            read.add(_key(grams[number], size - 1, kept[number][0] - side))
        for number, side in self.rarest(text, kept, gaps):
            read.add(_key(grams[number], size + 1, kept[number][0] + side))
        for place, (first, last) in enumerate(changes):
            if not first and last == len(kept):
                shorter = word[:place] + word[place + 1 :]
                own = {_key(shorter, size, place, "longer"), _key(shorter, size, place, "equal")}
                held |= own
                read |= own
        for place, (first, last) in enumerate(gaps):
            if not first and last == len(kept):
                own = _key(word, size + 1, place, "longer")
                held.add(own)
                read.add(own)
        return held, read


def _key(gram: str, size: int, place: int, kind: str = "gram") -> int:
    value = xxhash.xxh3_64_intdigest(f"{kind} {size} {place} {gram}".encode())
    return value - (1 << 64) if value >> 63 else value


def gram_dictionary(words: DataFrame, inner: int = INNER) -> tuple[dict[str, int], set[str]]:
    """Grams with counts, and those found often enough to be made longer, over all ``words``.

    Length by length: at most ``inner`` grams of each length are made longer, so what is counted next
    and what comes to the driver is bounded, however many words there are.
    """
    spark = words.sparkSession
    marked = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("text"))
    total = marked.agg(F.sum(F.length("text") - LEAST + 1)).first()[0] or 0
    counts, longer, often = {}, set(), None
    for size in range(LEAST, MOST + 1):
        places = F.expr(f"transform(sequence(1, length(text) - {size - 1}), i -> substring(text, i, {size}))")
        grams = marked.where(F.length("text") >= size).select(F.explode(places).alias("gram"))
        if often is not None:
            ahead = spark.createDataFrame([(gram,) for gram in often] or [("",)], "ahead string")
            grams = grams.join(F.broadcast(ahead), F.substring("gram", 1, size - 1) == F.col("ahead"), "left_semi")
        found = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).toArrow()
        level = dict(zip(found["gram"].to_pylist(), found["n"].to_pylist()))
        counts.update(level)
        often = [gram for gram, n in level.items() if n * inner > total] if size < MOST else []
        longer.update(often)
        if not often:
            break
    return counts, longer


#: The dictionary this worker used last, as built for look-ups.
_latest: dict = {}


def keys_of_words(dictionary: Broadcast):
    """mapInArrow function: (word, n) with the keys of the lists that hold the word and that it reads."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if _latest.get("of") is not dictionary.value:
                _latest.update(of=dictionary.value, grams=Grams(*dictionary.value))
            grams, held, read = _latest["grams"], [], []
            for word in batch["word"].to_pylist():
                holds, reads = grams.keys(word)
                held.append(list(holds))
                read.append(list(reads))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["word"], batch["n"], pa.array(held, kind), pa.array(read, kind)], names=["word", "n", "held", "read"]
            )

    return keyed


def near_pairs(words: DataFrame, folder: str | None = None, inner: int = INNER) -> DataFrame:
    """word, n, near, near_n: both directions of all pairs of ``words`` (word, n) one edit apart."""
    dictionary = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, inner))
    spread = words.repartition(work_partitions(words.sparkSession), "word")
    keyed = stage(
        spread.mapInArrow(keys_of_words(dictionary), "word string, n bigint, held array<bigint>, read array<bigint>"),
        "spelling-keys", folder,
    )
    held = keyed.select(F.explode("held").alias("key"), "word", "n")
    read = keyed.select(F.explode("read").alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    apart = F.levenshtein("word", "near", 1) == 1
    met = held.join(read, "key").where(apart).select("word", "n", "near", "near_n")
    turned = met.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")
    )
    return met.unionByName(turned).distinct()


def roots(forms: DataFrame, folder: str | None = None) -> DataFrame:
    """word, root of ``forms`` (word, form): where following forms ends.

    Each round doubles the steps taken, so rounds grow with the logarithm of the longest chain.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots", folder)
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = now.join(after, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        stepped = stage(stepped, "spelling-roots", folder)
        now = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return now


def variants(
    words: DataFrame, times: int = 2, folder: str | None = None, inner: int = INNER
) -> DataFrame:
    """word, form, root, n, n_near, form_n per row of ``words`` (word, n).

    ``form`` is the near word of the largest count, if that is ``times`` the word's own or more.
    """
    words = stage(words, "spelling-words", folder)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    counted = near_pairs(words, folder, inner).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    found = stage(
        counted.select(
            "word", "n_near", F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms", folder,
    )
    ends = roots(found.where("form IS NOT NULL").select("word", "form"), folder)
    return words.join(found, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n",
    )
