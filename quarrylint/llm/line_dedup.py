"""Dropping lines that many documents share.

Every text is exploded into its lines; a line's key is the line without ``[\\x20\\x09-\\x0D]`` at
both ends and with A-Z in lower case. Keys are hashed to 128 bits, distinct documents are counted
per hash (map side first), and the lines of keys found in ``min_docs`` documents or more go, but for
those in the document with the smallest identifier. What is left is put together by position.

A row is a document. A null text is one empty line, as is an empty one. A null identifier counts as
the largest; rows that share the smallest identifier of a key all keep its lines. Repeated rows get
the same answer each. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylint.functions.staging import stage

LAST = (1 << 63) - 1
LINES = "id bigint, body bigint, pos int, first int, hi bigint, lo bigint"


def line_keys(min_chars: int):
    """mapInArrow function: (id, body, content) to one row per line whose key is long enough."""

    def long_enough(key: bytes) -> bool:
        size = len(key)
        if size < min_chars:
            return False
        return size >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, firsts, digests = [], [], [], []
            for row, content in enumerate(batch["content"]):
                seen = set()
                for place, line in enumerate(content.as_py().split(b"\n")):
                    key = line.strip().lower()
                    if not long_enough(key):
                        continue
                    rows.append(row)
                    places.append(place)
                    firsts.append(key not in seen)
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
                    seen.add(key)
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(taken), batch["body"].take(taken), pa.array(places, pa.int32()),
                    pa.array(np.array(firsts, dtype=np.int32)), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                ],
                names=["id", "body", "pos", "first", "hi", "lo"],
            )

    return lines


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2,
    folder: str | None = None,
) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, ``kept_text``, per document."""
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id), F.lit(LAST)).cast("bigint").alias("id"),
        F.xxhash64(content).alias("body"),
        content.alias("content"),
    )
    lines = stage(
        keyed.select("id", "body", F.col("content").cast("binary").alias("content")).mapInArrow(
            line_keys(min_chars), LINES
        ),
        "lines", folder,
    )
    shared = (
        lines.groupBy("hi", "lo")
        .agg(F.sum("first").alias("n_docs"), F.min("id").alias("holder"))
        .where(F.col("n_docs") >= min_docs)
    )
    drops = (
        lines.select("hi", "lo", "id", "body", "pos").join(shared.drop("n_docs"), ["hi", "lo"])
        .where("id <> holder").groupBy("id", "body").agg(F.collect_set("pos").alias("drops"))
    )
    joined = (
        keyed.join(drops, ["id", "body"], "left")
        .withColumn("lines", F.split("content", "\n", -1))
        .withColumn("n_lines", F.size("lines"))
    )
    places = F.array_except(F.expr("sequence(0, n_lines - 1)"), F.col("drops"))
    kept = F.array_join(F.transform(places, lambda place: F.get(F.col("lines"), place)), "\n")
    return joined.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("content")).otherwise(kept).alias("kept_text"),
    )
