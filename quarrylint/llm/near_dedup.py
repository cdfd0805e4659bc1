"""Near-duplicate detection by one-permutation hashing with optimal densification.

1. A text's set of word shingles is hashed once; the hashes are dealt into ``SLOTS`` bins by their first
   bits and the smallest of each bin is kept. An empty bin takes the value of the first filled one in
   an order of bins that is fixed for it (optimal densification). ``BAND`` neighbouring slots make a key.
2. Documents with equal sets are one node. Nodes with an equal key share a bucket.
3. Candidates form stars: in every bucket each node is paired with the smallest one only, so there are
   no more pairs than rows. Pairs are confirmed on the full sets, and links joined to components.
4. Where a star leaves nodes of a bucket outside the component of its centre, the sets of these nodes meet
   all sets of the bucket in units: a block of the ones and a block of the others, of bounded size
   each. A unit compares full sets inside its task and returns the links that join components, fewer than
   it has nodes, so no pair is ever a row. Links between components contract them.

A shingle is ``SIZE`` words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text with fewer words has its
whole word sequence as the only one. Null or wordless texts have no shingle and no link. A null
identifier counts as the largest and stays null in results. Repeated rows are linked as equal. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylint.functions.staging import stage
from quarrylint.llm.components import components

SIZE = 5
SLOTS = 128
BAND = 4
BANDS = SLOTS // BAND
BLOCK = 200_000
REMEMBERED = 200_000
LAST = (1 << 63) - 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)
CHUNK_ROWS = 256

#: Per slot an order of all slots, in which an empty one looks for a filled one.
ORDER = np.argsort(np.random.default_rng(5).random((SLOTS, SLOTS)), axis=1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def shingle_set(content: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    words = content.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    count = max(len(words) - size + 1, 1)
    total = np.full(count, len(words) if len(words) < size else size, dtype=np.uint64)
    for place in range(min(size, len(words))):
        total = total * FACTOR + hashes[place : place + count]
        total ^= total >> np.uint64(29)
    return np.unique(mixed(total))


def slots(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a set that is not empty."""
    bins = (shingles >> SHIFT).astype(np.int64)
    first = np.searchsorted(bins, np.arange(SLOTS))
    filled = np.zeros(SLOTS, dtype=bool)
    filled[bins] = True
    values = shingles[np.minimum(first, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = ORDER[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, BAND)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for place in range(BAND):
        keys = mixed(keys * FACTOR + rows[:, place])
    return keys.view(np.int64)


def _let_go() -> None:
    """At the end of a task: words, and buffers that Arrow keeps for the next batch, go."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()


SKETCH = "id bigint, body bigint, n_shingles bigint, hi bigint, lo bigint, keys array<bigint>"


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (id, body, content) to set size, fingerprint of the set and band keys."""
    gc.collect()  # what earlier tasks of the worker have left
    for batch in batches:
        sizes, prints, keys = [], [], []
        for content in batch["content"]:
            shingles = shingle_set(content.as_py())
            sizes.append(len(shingles))
            prints.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            keys.append(band_keys(slots(shingles)) if len(shingles) else [])
        halves = np.frombuffer(b"".join(prints), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [
                batch["id"], batch["body"], pa.array(sizes, pa.int64()),
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["id", "body", "n_shingles", "hi", "lo", "keys"],
        )
        batch = content = None  # else they would lie there while the next batch is read
    _let_go()


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (node, content) to the set as one binary."""
    gc.collect()  # what earlier tasks of the worker have left
    for whole in batches:
        for low in range(0, whole.num_rows, CHUNK_ROWS):
            batch = whole.slice(low, CHUNK_ROWS)
            sets = [shingle_set(content.as_py()).tobytes() for content in batch["content"]]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "shingles"])
        whole = batch = None
    _let_go()


def compared(percent: int):
    """mapInArrow function: (u, v, left, right) to the pairs that are links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for left, right in zip(batch["left"], batch["right"]):
                a, b = (np.frombuffer(side.as_buffer(), dtype=np.uint64) for side in (left, right))
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared = int(np.count_nonzero(b[at] == a))
                links.append(100 * shared >= percent * (len(a) + len(b) - shared))
            taken = pa.array(np.flatnonzero(links))
            yield pa.RecordBatch.from_arrays([batch["u"].take(taken), batch["v"].take(taken)], names=["u", "v"])
            batch = left = right = a = b = None
        _let_go()

    return compare


class Labels(dict):
    """Components of labels within a unit."""

    def of(self, label: int) -> int:
        while self.setdefault(label, label) != label:
            label = self[label]
        return label


def links_of_unit(left: tuple, right: tuple, percent: int) -> list[tuple[int, int]]:
    """Pairs of labels of a unit that links join; sides are (labels, sets), one pair for each joining."""
    (u_labels, u_sets), (v_labels, v_sets) = left, right
    u_sizes, v_sizes = (np.array([len(each) for each in sets]) for sets in (u_sets, v_sets))
    _, places = np.unique(np.concatenate([*u_sets, *v_sets]), return_inverse=True)
    edges = np.cumsum(u_sizes)
    others, marks = places[edges[-1] :], np.zeros(places.max() + 1, dtype=bool)
    starts = np.cumsum(v_sizes) - v_sizes
    joined, found = Labels(), []
    for u, label in enumerate(u_labels.tolist()):
        own = places[edges[u] - u_sizes[u] : edges[u]]
        marks[own] = True
        shared = np.add.reduceat(marks[others], starts, dtype=np.int64)
        marks[own] = False
        linked = (100 * shared >= percent * (u_sizes[u] + v_sizes - shared)) & (v_labels != label)
        for other in np.unique(v_labels[linked]).tolist():
            one, two = joined.of(label), joined.of(other)
            if one != two:
                joined[one] = two
                found.append((label, other))
    return found


def unit_links(percent: int):
    """mapInArrow function over rows (key, a, b, side, label, shingles) sorted by unit and side: links of labels."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides = None, ([], [])

        def found() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1]:
                left, right = (
                    (np.array([label for label, _ in side]), [each for _, each in side]) for side in sides
                )
                pairs = links_of_unit(left, right, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pair[k] for pair in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"]
                )

        for batch in batches:
            columns = [batch[name].to_numpy(zero_copy_only=False) for name in ("key", "a", "b", "side", "label")]
            for row, (key, a, b, side, label) in enumerate(zip(*(column.tolist() for column in columns))):
                if (key, a, b) != unit:
                    yield from found()
                    unit, sides = (key, a, b), ([], [])
                sides[side].append((label, np.frombuffer(batch["shingles"][row].as_py(), dtype=np.uint64)))
        yield from found()

    return links


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    content = F.coalesce(F.col(text), F.lit(""))
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("id"),
        F.xxhash64(content).alias("body"),
        content.cast("binary").alias("content"),
    ]


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs``, each pair's sets brought to the place of its first node."""
    right = pairs.join(sets.withColumnsRenamed({"node": "v", "shingles": "right"}), "v")
    both = right.join(sets.withColumnsRenamed({"node": "u", "shingles": "left"}), "u")
    return both.select("u", "v", "left", "right").mapInArrow(compared(percent), "u bigint, v bigint")


def _of_like_size(percent: int) -> Column:
    """Whether two set sizes allow the similarity at all."""
    return 100 * F.least("u_size", "v_size") >= percent * F.greatest("u_size", "v_size")


def _classes(docs: DataFrame, doc_id: str, text: str, percent: int, folder: str | None) -> DataFrame:
    """id, body, n_shingles, component_id, kept per document, null identifiers as LAST."""
    sketched = docs.select(*_keyed(docs, doc_id, text)).mapInArrow(sketches, SKETCH)
    rows = stage(sketched.withColumn("row", F.monotonically_increasing_id()), "near-rows", folder)
    worded = rows.where("n_shingles > 0")
    sets_of = worded.groupBy("hi", "lo").agg(F.min("row").alias("node"))
    noded = stage(worded.select("row", "id", "hi", "lo").join(sets_of, ["hi", "lo"]).select("row", "id", "node"), "near-nodes", folder)
    nodes = rows.join(noded.where("row = node").select("row"), "row", "left_semi")

    members = nodes.select(F.col("row").alias("node"), F.col("n_shingles").alias("size"), F.explode("keys").alias("key"))
    centres = members.groupBy("key").agg(
        F.min(F.struct("node", "size")).alias("c"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("key", F.col("c.node").alias("centre"), F.col("c.size").alias("centre_size"))
    buckets = stage(members.join(centres, "key"), "near-buckets", folder)

    inside = buckets.select("node").distinct()
    wanted = rows.select("id", "body", F.col("row").alias("node")).join(inside, "node")
    texts = docs.select(*_keyed(docs, doc_id, text))
    sets = stage(
        texts.join(wanted, ["id", "body"]).dropDuplicates(["node"]).select("node", "content")
        .mapInArrow(full_sets, "node bigint, shingles binary"), "near-sets", folder,
    )
    star = (
        buckets.where("node <> centre")
        .select(F.col("centre").alias("u"), F.col("centre_size").alias("u_size"),
                F.col("node").alias("v"), F.col("size").alias("v_size"))
        .where(_of_like_size(percent)).select("u", "v").distinct()
    )
    joined = components(stage(_linked(star, sets, percent), "near-stars", folder), folder)
    more = stage(_left_open(buckets, joined, sets, percent, folder), "near-links", folder)
    placed = noded.join(joined, "node", "left").select("row", "id", F.coalesce("component", "node").alias("label"))
    if not more.isEmpty():
        contracted = components(more, folder).withColumnsRenamed({"node": "label"})
        placed = placed.join(contracted, "label", "left").select("row", "id", F.coalesce("component", "label").alias("label"))
    smallest = placed.groupBy("label").agg(F.min("id").alias("component_id"))
    named = placed.join(smallest, "label").select("row", "component_id")
    own = F.coalesce("component_id", "id")
    return rows.join(named, "row", "left").select(
        "id", "body", "n_shingles", own.alias("component_id"), (own == F.col("id")).alias("kept")
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, folder: str | None = None
) -> DataFrame:
    """id, body, n_shingles, component_id, kept per document.

    ``body`` is the hash of the text, with which a row can be found again if identifiers repeat.
    """
    known = lambda name: F.when(F.col(name) != LAST, F.col(name)).alias(name)
    found = _classes(docs, doc_id, text, percent, folder)
    return found.select(known("id"), "body", "n_shingles", known("component_id"), "kept")


def _labelled(rows: DataFrame, joined: DataFrame, node: str, label: str) -> DataFrame:
    labels = joined.select(F.col("node").alias(node), F.col("component").alias(label))
    return rows.join(labels, node, "left").withColumn(label, F.coalesce(label, node))


def _left_open(buckets: DataFrame, joined: DataFrame, sets: DataFrame, percent: int, folder: str | None) -> DataFrame:
    """Links (u, v) of labels that the stars have not found.

    Both sides of a bucket are cut into blocks of about ``BLOCK`` shingles by a hash of the node, so
    a unit is bounded; a node is sent once for each block of the other side.
    """
    told = _labelled(_labelled(buckets.where("node <> centre"), joined, "node", "label"), joined, "centre", "centre_label")
    told = stage(
        told.select("key", "node", "size", "label", (F.col("label") != F.col("centre_label")).alias("outside")),
        "near-labels", folder,
    )
    blocks = lambda size: F.ceil(size / BLOCK).cast("int")
    sizes = told.groupBy("key").agg(
        blocks(F.sum(F.when(F.col("outside"), F.col("size")))).alias("a_blocks"), blocks(F.sum("size")).alias("b_blocks"),
        F.min("label").alias("low"), F.max("label").alias("high"),
    ).where("a_blocks IS NOT NULL AND low <> high").drop("low", "high")
    rows = told.join(sizes, "key")
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = rows.where("outside").select(
        "key", own("a_blocks").alias("a"), each("b_blocks").alias("b"), F.lit(0).alias("side"), "node", "label"
    )
    right = rows.select("key", each("a_blocks").alias("a"), own("b_blocks").alias("b"), F.lit(1).alias("side"), "node", "label")
    units = left.unionByName(right).join(sets, "node").drop("node")
    return (
        units.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side")
        .mapInArrow(unit_links(percent), "u bigint, v bigint").distinct()
    )


def kept_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, folder: str | None = None
) -> DataFrame:
    """``docs`` with one document of each component, all columns as they were."""
    kept = _classes(docs, doc_id, text, percent, folder).where("kept").select("id", "body")
    id_, body, _ = _keyed(docs, doc_id, text)
    return docs.select(F.struct("*").alias("doc"), id_, body).join(kept, ["id", "body"], "left_semi").select("doc.*")
