"""Removing repeated byte strings by depth-limited radix passes over suffixes.

Suffixes are ordered only as far as ``length`` bytes, by most-significant-digit passes, and a group that
has one suffix left takes no further part; groups of equal suffixes at full depth are the repeats.

1. First digit: ``GRAM`` bytes. Of any ``length`` bytes in a row, those that start with the smallest hash
   stand for all (the same ones wherever the string stands), so one suffix in about forty is dealt by its
   digit, together with the run of strings it stands for. A digit with one suffix has no repeat.
2. Whole run: of suffixes with equal runs the first stands for all, the others are repeats.
3. Full depth: where several different runs share a digit, each string of the run is ordered to its end.
   Digits with more than ``LARGE`` runs are dealt once more, by the string, to all partitions.

Order is (doc_id, start). Strings never reach beyond their document, and all judgement is on the input.
Long texts are hashed in overlapping segments of bounded size. Equality is that of 128-bit hashes (digit
and run, or two hashes of the string).

A null text is empty. A null identifier counts as the largest; rows that share one are ordered by a hash
of their text, and repeated rows are one document. Empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylint.functions.staging import stage
from quarrylint.llm.windows import Rolling, sliding_argmin

LENGTH = 100
GRAM = 24
SEGMENT = 1 << 20
LARGE = 4096
LAST = (1 << 63) - 1
RUNS = "digit bigint, run bigint, id bigint, tag bigint, start int, n int, first boolean"
KINDS = "digit bigint, id bigint, tag bigint, start int, n int, repeat boolean"


def segments(contents: list[pa.Scalar], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, row, start of the row's text in data) of stretches of up to SEGMENT bytes in all.

    A longer text comes in several stretches that overlap by length - 1 bytes.
    """
    parts: list[tuple[bytes, int, int]] = []
    total = 0
    for row, content in enumerate(contents):
        content = memoryview(content.as_buffer())
        for at in range(0, max(len(content) - length + 1, 0), SEGMENT - length + 1):
            part = content[at : at + SEGMENT]
            if total + len(part) > SEGMENT:
                yield _joined(parts)
                parts, total = [], 0
            parts.append((part, row, at))
            total += len(part)
    if parts:
        yield _joined(parts)


def _joined(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(part) for part, _, _ in parts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(part for part, _, _ in parts), dtype=np.uint8)
    rows = np.array([row for _, row, _ in parts])
    origins = ends - sizes - np.array([at for _, _, at in parts])
    piece = np.repeat(np.arange(len(parts)), sizes)
    return data, piece, np.stack([rows, origins])


def find_runs(length: int, gram: int):
    """mapInArrow function: (id, tag, content) to the runs of its strings, repeats within a batch marked."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((5, 0), dtype=np.int64)]
            for data, piece, origin in segments(list(batch["content"]), length):
                rolling = Rolling(data)
                hashes = rolling.all(gram)
                least = sliding_argmin(hashes, length - gram + 1)
                count = len(least)
                inside = piece[:count] == piece[length - 1 : length - 1 + count]
                changes = np.flatnonzero((least[1:] != least[:-1]) | (inside[1:] != inside[:-1])) + 1
                low = np.concatenate([[0], changes])
                high = np.concatenate([changes, [count]])
                low, high = low[inside[low]], high[inside[low]]
                row, begin = origin[:, piece[low]]
                found.append(np.stack([
                    hashes[least[low]].view(np.int64), rolling.of(low, high - 1 + length).view(np.int64),
                    row, low - begin, high - low,
                ]))
            digit, run, row, start, n = np.concatenate(found, axis=1)
            ids, tags = (batch[k].to_numpy(zero_copy_only=False) for k in ("id", "tag"))
            order = np.lexsort((start, tags[row], ids[row], run, digit))
            digit, run, row, start, n = (a[order] for a in (digit, run, row, start, n))
            first = np.ones(len(digit), dtype=bool)
            first[1:] = (digit[1:] != digit[:-1]) | (run[1:] != run[:-1])
            # A row given twice is one document: its second copy is no repeat.
            again = np.zeros(len(digit), dtype=bool)
            again[1:] = (ids[row[1:]] == ids[row[:-1]]) & (tags[row[1:]] == tags[row[:-1]]) & (start[1:] == start[:-1])
            keep = first | ~again
            columns = [digit, run, ids[row], tags[row], start.astype(np.int32), n.astype(np.int32), first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column[keep]) for column in columns],
                names=["digit", "run", "id", "tag", "start", "n", "first"],
            )

    return runs


def order_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over runs sorted by digit, run, id, tag, start: repeats, and runs to order further.

    Runs that were no first ones in their batch are repeats and pass through. Of the others only the
    first run of the digit at hand is held back, until another one turns up.
    """
    digit = run = place = None  # of the last row
    held: tuple | None = None
    names = ["digit", "id", "tag", "start", "n"]
    for whole in batches:
        known = whole.filter(pc.invert(whole["first"])).select(names)
        yield known.append_column("repeat", pa.array(np.ones(known.num_rows, dtype=bool)))
        batch = whole.filter(whole["first"])
        if not batch.num_rows:
            continue
        d, r, i, t, s, n = (batch[k].to_numpy(zero_copy_only=False) for k in ("digit", "run", "id", "tag", "start", "n"))
        same_digit = np.concatenate([[d[0] == digit], d[1:] == d[:-1]])
        same_run = same_digit & np.concatenate([[r[0] == run], r[1:] == r[:-1]])
        at = np.stack([i, t, s])
        same_place = np.concatenate([[place == tuple(at[:, 0])], (at[:, 1:] == at[:, :-1]).all(axis=0)])
        repeat = same_run & ~same_place
        heads = np.flatnonzero(~same_run)
        # A head is ordered further if the head before or after it has its digit.
        opens = ~same_digit[heads]
        follows = ~opens
        wanted = follows.copy()
        wanted[:-1] |= follows[1:]
        extra = [held] if held is not None and len(heads) and follows[0] else []
        if len(heads):
            last = heads[-1]
            held = (d[last], i[last], t[last], s[last], n[last]) if opens[-1] else None
            if held is not None:
                wanted[-1] = False
        picked = np.concatenate([np.flatnonzero(repeat), heads[wanted]])
        columns = [a[picked] for a in (d, i, t, s, n)]
        if extra:
            columns = [np.append(a, value) for a, value in zip(columns, extra[0])]
        flags = np.zeros(len(columns[0]), dtype=bool)
        flags[: int(repeat.sum())] = True
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, kind) for a, kind in zip(columns, types)] + [pa.array(flags)],
            names=[*names, "repeat"],
        )
        digit, run, place = d[-1], r[-1], tuple(at[:, -1])


STRETCHES = "digit bigint, id bigint, tag bigint, start int, stretch binary"


def cut_stretches(length: int):
    """mapInArrow function: (id, tag, content, runs of digit, start, n) to the bytes of each run."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, table = [], []
            for row, (content, runs) in enumerate(zip(batch["content"], batch["runs"])):
                content = memoryview(content.as_buffer())
                for run in runs.as_py():
                    rows.append(row)
                    table.append((run["digit"], run["start"], bytes(content[run["start"] : run["start"] + run["n"] + length - 1])))
            digit, start, stretch = zip(*table) if table else [()] * 3
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digit, pa.int64()), batch["id"].take(taken), batch["tag"].take(taken),
                    pa.array(start, pa.int32()), pa.array(stretch, pa.binary()),
                ],
                names=["digit", "id", "tag", "start", "stretch"],
            )

    return stretches


def _strings(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the run, two hashes) of all strings of a batch of stretches."""
    stretches = [stretch.as_py() for stretch in batch["stretch"]]
    sizes = np.array([len(stretch) for stretch in stretches], dtype=np.int64)
    counts = sizes - length + 1
    rows = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    rolling = Rolling(np.frombuffer(b"".join(stretches), dtype=np.uint8))
    begin = (np.cumsum(sizes) - sizes)[rows] + inside
    middle = begin + length // 2
    return rows, inside, rolling.of(begin, begin + length).view(np.int64), rolling.of(middle, begin + length).view(np.int64)


def _spans(rows: np.ndarray, inside: np.ndarray, batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """id, tag, start, stop of what the strings (row, place in the run) cover, neighbours joined."""
    order = np.lexsort((inside, rows))
    rows, inside = rows[order], inside[order]
    opens = np.ones(len(rows), dtype=bool)
    opens[1:] = (rows[1:] != rows[:-1]) | (inside[1:] != inside[:-1] + 1)
    heads = np.flatnonzero(opens)
    tails = np.append(heads[1:], len(rows)) - 1 if len(heads) else heads
    taken = pa.array(rows[heads])
    start = batch["start"].to_numpy(zero_copy_only=False)[rows[heads]]
    return pa.RecordBatch.from_arrays(
        [
            batch["id"].take(taken), batch["tag"].take(taken), pa.array((start + inside[heads]).astype(np.int32)),
            pa.array((start + inside[tails] + length).astype(np.int32)),
        ],
        names=["id", "tag", "start", "stop"],
    )


SPANS = "id bigint, tag bigint, start int, stop int"
PARTS = 4_000
CHUNK_ROWS = 1_000


def order_strings(length: int):
    """mapInArrow function over stretches sorted by digit, id, tag, start: repeated strings as spans.

    Takes whole digits at a time; none has more than LARGE stretches.
    """

    def spans_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, inside, one, two = _strings(batch, length)
        order = np.lexsort((inside, rows, two, one))
        repeat = np.zeros(len(order), dtype=bool)
        repeat[1:] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        picked = order[repeat]
        return _spans(rows[picked], inside[picked], batch, length)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for whole in batches:
            for low in range(0, whole.num_rows, PARTS):
                part = whole.slice(low, PARTS)
                digits = part["digit"].to_numpy(zero_copy_only=False)
                cut = int(np.searchsorted(digits, digits[-1]))
                if cut == 0 and waiting and waiting[-1]["digit"][-1].as_py() == digits[0]:
                    waiting.append(part)
                    continue
                waiting.append(part.slice(0, cut))
                yield spans_of(_together(waiting))
                waiting = [part.slice(cut)]
        if waiting:
            yield spans_of(_together(waiting))

    return spans


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches([batch for batch in batches if batch.num_rows] or batches[:1])


def hash_strings(length: int):
    """mapInArrow function: stretches to one row per string."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, PARTS):
                batch = whole.slice(low, PARTS)
                rows, inside, one, two = _strings(batch, length)
                taken = pa.array(rows)
                start = batch["start"].to_numpy(zero_copy_only=False)[rows] + inside
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), batch["id"].take(taken), batch["tag"].take(taken),
                     pa.array(start.astype(np.int32))],
                    names=["one", "two", "id", "tag", "start"],
                )

    return strings


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (doc_id, content, spans) to counts, removed spans and the bytes that are left."""
    for batch in (whole.slice(low, CHUNK_ROWS) for whole in batches for low in range(0, whole.num_rows, CHUNK_ROWS)):
        table = []
        for content, spans in zip(batch["content"], batch["spans"]):
            content = content.as_py()
            merged: list[list[int]] = []
            for span in sorted((s["start"], s["stop"]) for s in spans.as_py() or ()):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append(list(span))
            edges = [0, *(edge for span in merged for edge in span), len(content)]
            kept = b"".join(content[a:b] for a, b in zip(edges[::2], edges[1::2]))
            table.append((len(content), len(content) - len(kept), len(merged), kept))
        sizes, removed, spans, kept = zip(*table) if table else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _covered(runs: DataFrame, length: int) -> DataFrame:
    return runs.select("id", "tag", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))


def _hot_spans(stretches: DataFrame, length: int) -> DataFrame:
    """Repeated strings of large digits, each string a row, first ones found map side first."""
    strings = stretches.mapInArrow(hash_strings(length), "one bigint, two bigint, id bigint, tag bigint, start int")
    first = strings.groupBy("one", "two").agg(F.min(F.struct("id", "tag", "start")).alias("first"))
    place = F.struct("id", "tag", "start")
    later = strings.join(first, ["one", "two"]).where(place != F.col("first"))
    return later.select("id", "tag", "start", (F.col("start") + length).alias("stop"))


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
    folder: str | None = None,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes left, ``kept``, per document."""
    content: Column = F.coalesce(F.col(text), F.lit(""))
    # Rows without an identifier come last; id and tag tell them apart by 112 bits of their text.
    no_id = F.lit(LAST) - F.xxhash64(content, F.lit(1)).bitwiseAND(F.lit((1 << 48) - 1))
    texts = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("bigint"), no_id).alias("id"),
        F.xxhash64(content).alias("tag"),
        content.cast("binary").alias("content"),
    )
    runs = texts.drop("doc_id").mapInArrow(find_runs(length, gram), RUNS)
    # What is known to be a repeat needs no company: such runs are dealt evenly.
    dealt = F.when(F.col("first"), F.col("digit")).otherwise(F.xxhash64("id", "start"))
    ordered = stage(
        runs.repartition(dealt)
        .sortWithinPartitions("digit", "run", "id", "tag", "start").mapInArrow(order_runs, KINDS), "runs", folder,
    )
    open_runs = ordered.where("NOT repeat").drop("repeat")
    large = stage(open_runs.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("digit"), "large-digits", folder)
    per_text = open_runs.groupBy("id", "tag").agg(F.collect_list(F.struct("digit", "start", "n")).alias("runs"))
    stretches = texts.join(per_text, ["id", "tag"]).select("id", "tag", "content", "runs").mapInArrow(
        cut_stretches(length), STRETCHES
    )
    stretches = stage(stretches, "stretches", folder)
    small = stretches.join(large, "digit", "left_anti").repartition("digit").sortWithinPartitions("digit", "id", "tag", "start")
    spans = (
        _covered(ordered.where("repeat"), length)
        .unionByName(small.mapInArrow(order_strings(length), SPANS))
        .unionByName(_hot_spans(stretches.join(large, "digit", "left_semi"), length))
    )
    per_text = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(per_text, ["id", "tag"], "left").select("doc_id", "content", "spans").mapInArrow(
        cut_texts, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
