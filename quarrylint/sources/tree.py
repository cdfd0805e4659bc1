"""Loading directory trees.

Folders are listed in tasks, round by round: a task opens its folders and some of those it finds, and
hands the rest on as rows of the next round. No list of folders or files goes through the
driver. The listed files are then cut into tasks of equal bytes and read. Spark's own ``binaryFile`` source is no
choice here: it silently drops names that start with ``_`` or ``.``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylint.functions.staging import cut_by_weight, stage, work_partitions
from quarrylint.functions.text import decode
from quarrylint.sources import stores
from quarrylint.sources.paths import DEFAULT_EXCLUDES

LISTING_DDL = "path STRING, location BINARY, length BIGINT, read_error STRING"
_LISTED = {"path": pa.string(), "location": pa.binary(), "length": pa.int64(), "read_error": pa.string(), "folder": pa.bool_()}
_BATCH_BYTES = 32 * 1024 * 1024
_BATCH_ROWS = 4096
#: Folders that a task opens beyond those it was given, and holds at once, before it hands the rest on.
FOLDERS_AHEAD = 1000
#: What opening a file costs, in bytes read.
OPEN_BYTES = 64 * 1024


def _clean(name: str) -> str:
    """Bytes of a name that are no UTF-8 are spelled out, so different names stay different."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_LISTED)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(columns, _LISTED.values())], names=list(_LISTED)
    )


class Lister:
    """mapInArrow function: folders (path, location) to rows of their files and of folders left to open."""

    def __init__(self, suffix: str, excludes: Iterable[str], hidden: bool):
        self.suffix, self.excludes, self.hidden, self.ahead = suffix, frozenset(excludes), hidden, FOLDERS_AHEAD

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in self._listed(batches):
            rows.append(row)
            if len(rows) == _BATCH_ROWS:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    def _wanted(self, name: str) -> bool:
        return name not in self.excludes and (self.hidden or not name.startswith("."))

    def _listed(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        ahead = self.ahead
        for batch in batches:
            for given in zip(batch["path"].to_pylist(), batch["location"].to_pylist()):
                todo = [given]
                while todo:
                    path, location = todo.pop()
                    try:
                        if not path and not stores.is_folder(location):
                            yield from self._single(location)
                            continue
                        for entry in stores.entries(location):
                            below = f"{path}/{_clean(entry.name)}" if path else _clean(entry.name)
                            if entry.folder and self._wanted(entry.name):
                                if ahead and len(todo) < self.ahead:
                                    ahead -= 1
                                    todo.append((below, entry.location))
                                else:
                                    yield below, entry.location, None, None, True
                            elif entry.folder is False and entry.name.endswith(self.suffix):
                                yield below, entry.location, entry.length, entry.error, False
                    except OSError as error:
                        yield path or ".", location, None, stores.reason(error), False

    def _single(self, location: bytes) -> Iterator[tuple]:
        """A root that is a file is its own tree."""
        name = os.path.basename(os.fsdecode(location))
        if name.endswith(self.suffix):
            yield _clean(name), location, stores.length(location), None, False


def list_tree(
    spark: SparkSession, root: str, suffix: str = ".py", excludes: Iterable[str] = DEFAULT_EXCLUDES,
    hidden: bool = False, folder: str | None = None,
) -> DataFrame:
    """Paths below ``root`` (or ``root`` itself, if it is a file) with their sizes.

    Each round is a job that writes what it lists; the driver learns only whether folders are left. A
    round opens every folder it is given and up to ``FOLDERS_AHEAD`` more in each task, so small
    trees take one round and deep ones no more rounds than they have levels.
    """
    lister = Lister(suffix, excludes, hidden)
    todo = spark.createDataFrame(stores.resolved(spark, root), "path STRING, location BINARY").coalesce(1)
    listing = None
    while True:
        listed = stage(todo.mapInArrow(lister, LISTING_DDL + ", folder BOOLEAN"), "listing", folder)
        files = listed.where("NOT folder").drop("folder")
        listing = files if listing is None else listing.unionByName(files)
        todo = listed.where("folder").select("path", "location")
        if todo.isEmpty():
            return listing
        todo = todo.repartition(work_partitions(spark))


def in_equal_tasks(listing: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of a listing in partitions of about equal bytes, the cost of opening a file included."""
    weight = F.coalesce("length", F.lit(0)) + OPEN_BYTES
    return cut_by_weight(listing, weight, ["location"], folder=folder)


def _read_bytes(max_bytes: int | None, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        rows, held = [], 0
        for row in batch.to_pylist():
            content = None
            if row["read_error"] is None:
                if max_bytes is not None and row["length"] > max_bytes:
                    row["read_error"] = f"Not read: larger than {max_bytes} bytes"
                else:
                    try:
                        with stores.opened(row["location"]) as handle:
                            content = handle.read()
                    except OSError as error:
                        row["read_error"] = stores.reason(error)
            rows.append({**row, "content": content})
            held += len(content or b"")
            if held >= _BATCH_BYTES:
                yield _bytes_batch(rows, names)
                rows, held = [], 0
        if rows:
            yield _bytes_batch(rows, names)


def _bytes_batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"location": pa.binary(), "length": pa.int64(), "content": pa.binary()}
    columns = [*names, "content"]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], type=kinds.get(c, pa.string())) for c in columns],
        names=columns,
    )


def read_bytes(listing: DataFrame, max_bytes: int | None = None, folder: str | None = None) -> DataFrame:
    """Add the bytes of each listed file; no task reads more than its share of bytes and one file."""
    return in_equal_tasks(listing, folder).mapInArrow(
        lambda batches: _read_bytes(max_bytes, batches),
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema) + ", content BINARY",
    )


def load_tree(
    spark: SparkSession,
    root: str,
    excludes: Iterable[str] | None = None,
    extra_excludes: Iterable[str] = (),
    project: str | None = None,
    max_bytes: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """``files`` (project, path, content, read_error) of one tree; paths are relative to its root.

    A folder that cannot be listed, the root among them, is a row with a read error. Files of any size
    are read unless ``max_bytes`` is given. ``root`` may be an address in any store (see ``stores``). The
    listing is made at once and staged; contents are read with the result.
    """
    names = [*(excludes or DEFAULT_EXCLUDES), *extra_excludes]
    listing = list_tree(spark, root, ".py", names, folder=folder)
    name = project or os.path.basename(os.path.abspath(root))
    return read_bytes(listing, max_bytes, folder).select(
        F.lit(name).alias("project"), "path", decode(F.col("content")).alias("content"), "read_error"
    )
