"""Packing documents into sequences: dominance reduction, then best fit.

Documents become token ids and are cut into pieces no longer than a sequence. As pieces have at most
``capacity`` different lengths, the packing is worked out on the number of pieces of each length, a table
of that many rows at most, and is the same for any number of documents:

1. Reduction after Martello and Toth: a set of up to three pieces that dominates every other set with
   its first piece is fixed as a sequence, as often as its lengths are there; what is left is tried
   again until nothing more can be fixed.
2. The remainder is packed by best fit, longest pieces first.

The plan says which ranks of each length go where. The rank of a piece among all of its length is its
rank in its partition plus the pieces of the partitions before, so no group is brought together.

A null text is empty and becomes the end token alone. Repeated rows are packed as often as they stand;
null identifiers are kept. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylint.functions.staging import stage
from quarrylint.llm.word_ids import WordIds

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint"
PLACES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
CHUNK_ROWS = 512


def cut_pieces(file: str, capacity: int, end_id: int, with_ids: bool):
    """mapInArrow function: (doc_id, content) to pieces, ranked by length within the partition."""
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # what earlier tasks of the worker have left, their words above all
        words = WordIds(file)
        try:
            yield from cut(batches, words.of)
        finally:
            words.forget()
            pa.default_memory_pool().release_unused()

    def cut(batches: Iterator[pa.RecordBatch], ids_of) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for whole in batches:
            for low in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(low, CHUNK_ROWS)
                rows, table = [], []
                for row, content in enumerate(batch["content"]):
                    ids = ids_of(content.as_py()) + end
                    for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        length = len(piece) // 4
                        local = seen.get(length, 0)
                        seen[length] = local + 1
                        rows.append(row)
                        table.append((number, at // 4, length, zlib.crc32(piece), local, piece if with_ids else None))
                number, start, length, crc, local, ids = zip(*table) if table else [()] * 6
                columns = [
                    batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([part] * len(rows), pa.int32()), pa.array(local, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
            whole = batch = content = None  # else they would lie there while the next batch is read

    return pieces


Pattern = tuple[tuple[int, int], ...]


@dataclass
class Lengths:
    """Numbers of pieces by length; ``sizes`` are the lengths that are left, in order."""

    counts: dict[int, int]
    sizes: list[int] = field(init=False)

    def __post_init__(self):
        self.sizes = sorted(size for size, count in self.counts.items() if count)

    def take(self, size: int, count: int) -> None:
        self.counts[size] -= count
        if not self.counts[size]:
            self.sizes.remove(size)

    def smallest(self, number: int, without: int, above: int = 0, below: int | None = None) -> list[int]:
        """Up to ``number`` smallest pieces with above < length < below, one of length ``without`` left out."""
        found: list[int] = []
        place = bisect.bisect_right(self.sizes, above)
        while len(found) < number and place < len(self.sizes):
            size = self.sizes[place]
            if below is not None and size >= below:
                break
            found += [size] * min(number - len(found), self.counts[size] - (size == without))
            place += 1
        return found

    def largest(self, limit: int, without: int) -> int | None:
        place = bisect.bisect_right(self.sizes, limit) - 1
        while place >= 0:
            size = self.sizes[place]
            if self.counts[size] > (size == without):
                return size
            place -= 1
        return None

    def best_pair(self, limit: int, without: int) -> tuple[int, int] | None:
        """(a, b), a >= b, of the largest sum up to ``limit``; of equal sums that with the largest a."""
        sizes = self.sizes
        if self.counts[without] == 1:
            sizes = [size for size in sizes if size != without]
        best, low, high = None, 0, bisect.bisect_right(sizes, limit) - 1
        while high >= low:
            a, b = sizes[high], sizes[low]
            if a + b > limit:
                high -= 1
                continue
            two = a != b or self.counts[a] >= 2 + (a == without)
            if two and (best is None or a + b > sum(best)):
                best = (a, b)
            low += 1
        return best


def dominating(lengths: Lengths, first: int, capacity: int) -> tuple[int, ...] | None:
    """The set with a piece of length ``first`` that dominates all sets with one, if it can be told."""
    room = capacity - first
    largest = lengths.largest(room, first)
    if largest is None:
        return (first,)
    if largest == room:
        return (first, largest)
    small = lengths.smallest(3, first)
    if sum(small[:2]) > room or len(small) < 2:
        return (first, largest)
    if sum(small) > room or len(small) < 3:
        pair = lengths.best_pair(room, first)
        if largest >= sum(pair):
            return (first, largest)
        between = lengths.smallest(2, first, above=pair[1], below=pair[0])
        if pair[0] == largest and (len(between) < 2 or sum(between) > room):
            return (first, *pair)
    return None


def as_pattern(pieces: tuple[int, ...]) -> Pattern:
    return tuple((size, pieces.count(size)) for size in sorted(set(pieces), reverse=True))


def reduced(lengths: Lengths, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets, as often as they can be had, until none is left; ``lengths`` shrinks."""
    fixed, changed = [], True
    while changed:
        changed = False
        for first in reversed(lengths.sizes.copy()):
            while lengths.counts[first]:
                pieces = dominating(lengths, first, capacity)
                if pieces is None:
                    break
                pattern = as_pattern(pieces)
                times = min(lengths.counts[size] // number for size, number in pattern)
                for size, number in pattern:
                    lengths.take(size, number * times)
                fixed.append((pattern, times))
                changed = True
    return fixed


def best_fit(lengths: Lengths, capacity: int) -> list[tuple[Pattern, int]]:
    """Longest pieces first, each into the fullest sequence that has room; equal steps are taken together."""
    open_at: dict[int, list[tuple[Pattern, int]]] = {capacity: []}
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, room: int, times: int) -> None:
        if not room:
            done.append((pattern, times))
            return
        if not open_at.setdefault(room, []):
            bisect.insort(rooms, room)
        open_at[room].append((pattern, times))

    for size in reversed(lengths.sizes):
        left = lengths.counts[size]
        while left:
            place = bisect.bisect_left(rooms, size)
            if place < len(rooms):
                room = rooms[place]
                pattern, times = open_at[room].pop()
                if not open_at[room]:
                    rooms.pop(place)
            else:
                room, pattern, times = capacity, (), left
            each = min(room // size, left)
            filled = min(times, left // each)
            put((*pattern, (size, each)), room - each * size, filled)
            left -= filled * each
            if pattern and times > filled:
                put(pattern, room, times - filled)
    return done + [group for room in rooms for group in open_at[room]]


def packing_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, number per sequence, offset, first sequence), by length and rank."""
    lengths = Lengths(dict(counts))
    groups = reduced(lengths, capacity) + best_fit(lengths, capacity)
    rank, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for pattern, times in groups:
        offset = 0
        for size, number in pattern:
            rows.append((size, rank[size], number, offset, sequence))
            rank[size] += number * times
            offset += size * number
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place_pieces(plan: np.ndarray):
    """mapInArrow function: adds sequence_id and offset by length and rank."""
    starts = (plan[:, 0] << 50) + plan[:, 1]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[name].to_numpy(zero_copy_only=False) for name in ("length", "rank"))
            found = plan[np.searchsorted(starts, (length << 50) + rank, side="right") - 1]
            step = rank - found[:, 1]
            kept = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch[name] for name in kept]
                + [pa.array(found[:, 4] + step // found[:, 2]), pa.array(found[:, 3] + step % found[:, 2] * length)],
                names=[*kept, "sequence_id", "offset"],
            )

    return places


def pack(
    docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096,
    end_id: int = 1, with_ids: bool = False, folder: str | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece; ``ids`` (binary) if asked for."""
    more = ", ids binary" if with_ids else ""
    source = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content")
    )
    pieces = stage(
        source.mapInArrow(cut_pieces(tokenizer_file, capacity, end_id, with_ids), PIECES + more), "pieces", folder
    )
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {row.length: row.n for row in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        (F.col("before") + F.col("local")).alias("rank"),
    )
    return ranked.mapInArrow(
        place_pieces(packing_plan(counts, capacity)),
        PLACES.replace("ids_crc32 bigint", "ids_crc32 bigint" + more),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, one binary of unsigned 32-bit little-endian numbers; needs ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
