"""Projects that come as zip archives: entry table first, guards on it, contents last."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylint.functions.staging import cut_by_weight, numbered, semi_join_spread, stage
from quarrylint.functions.text import decode
from quarrylint.sources import stores
from quarrylint.sources.paths import exclude_dirs
from quarrylint.sources.tree import OPEN_BYTES, in_equal_tasks, list_tree

# The guard limits.
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
MAX_ENTRIES = 2000
MAX_UNPACKED_BYTES = 200 * 1024 * 1024

ENTRIES_DDL = (
    "archive STRING, is_zip BOOLEAN, idx INT, name STRING, file_size BIGINT, "
    "is_dir BOOLEAN, encrypted BOOLEAN"
)
_ENTRY_TYPES = {
    "archive": pa.string(), "is_zip": pa.bool_(), "idx": pa.int32(), "name": pa.string(),
    "file_size": pa.int64(), "is_dir": pa.bool_(), "encrypted": pa.bool_(),
}
_FILE_TYPES = {
    "project": pa.string(), "path": pa.string(), "content": pa.binary(), "read_error": pa.string(),
}
_BATCH_BYTES = 32 * 1024 * 1024
_CHUNK_BYTES = 1024 * 1024


def list_archives(spark: SparkSession, root: str, folder: str | None = None) -> DataFrame:
    """Every file below ``root`` as (archive, location, length, read_error), none of them opened.

    Too large files and files with another suffix are listed, so that they can be rejected with
    a reason. Contents stay on disk until the guards have passed and never go through a shuffle.
    """
    listing = list_tree(spark, root, suffix="", excludes=(), hidden=True, folder=folder)
    return listing.withColumnRenamed("path", "archive")


def _batch(rows: list[dict], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], type=t) for c, t in types.items()], names=list(types)
    )


def _plain(name: str) -> str:
    return name.encode("utf-8", "replace").decode("utf-8")


def _list_entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, location in zip(*(batch.column(c).to_pylist() for c in ("archive", "location"))):
            row = dict.fromkeys(_ENTRY_TYPES)
            row.update(archive=archive, is_zip=True)
            try:
                with stores.opened(location) as handle, zipfile.ZipFile(handle) as packed:
                    members = packed.infolist()
            except Exception:
                yield _batch([{**row, "is_zip": False}], _ENTRY_TYPES)
                continue
            rows = [
                {
                    **row,
                    "idx": idx,
                    "name": _plain(m.filename),
                    "file_size": m.file_size,
                    "is_dir": m.is_dir(),
                    "encrypted": bool(m.flag_bits & 0x1),
                }
                for idx, m in enumerate(members)
            ]
            yield _batch(rows or [row], _ENTRY_TYPES)


def _size(limit: int) -> str:
    return f"{limit >> 20} MB" if limit >> 20 else f"{limit} bytes"


def turned_away(max_upload: int = MAX_UPLOAD_BYTES) -> Column:
    """Reason to turn an archive away before it is opened, or null."""
    return (
        F.when(~F.lower("archive").endswith(".zip"), F.lit("Not a .zip file."))
        .when(F.col("length") > max_upload, F.lit(f"Archive is over {_size(max_upload)}"))
        .when(F.col("read_error").isNotNull(), F.col("read_error"))
    )


def archive_entries(archives: DataFrame, max_upload: int = MAX_UPLOAD_BYTES, folder: str | None = None) -> DataFrame:
    """Directory of each archive, one row per entry; one row without idx if there is none.

    Only the end of an archive is read, so tasks get equal numbers of archives.
    """
    opened = archives.filter(turned_away(max_upload).isNull()).select("archive", "location")
    return cut_by_weight(opened, F.lit(OPEN_BYTES), ["location"], folder=folder).mapInArrow(_list_entries, ENTRIES_DDL)


def leaves_root(name: Column) -> Column:
    """True if a path is absolute or steps above its root at any point on the way."""
    step = lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)
    lowest = F.aggregate(
        F.split(name, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, s: F.struct(
            (acc["depth"] + step(s)).alias("depth"),
            F.least(acc["lowest"], acc["depth"] + step(s)).alias("lowest"),
        ),
        lambda acc: acc["lowest"],
    )
    return name.startswith("/") | (lowest < 0)


def entry_rejects(
    entries: DataFrame, max_entries: int = MAX_ENTRIES, max_unpacked: int = MAX_UNPACKED_BYTES
) -> DataFrame:
    """(archive, reason) for each archive whose entry table breaks a guard.

    Too many entries beats the rest; else the first entry in order that leaves the root, is
    encrypted, or takes the running declared size over the limit gives the reason.
    """
    counts = entries.groupBy("archive").agg(F.count("*").alias("n"))
    crowded = counts.filter(F.col("n") > max_entries).select(
        "archive", F.lit(f"Archive has more than {max_entries} entries").alias("reason")
    )
    # What is left per archive is at most max_entries rows, so a window per archive is small.
    bounded = entries.join(crowded.select("archive"), "archive", "left_anti")
    so_far = Window.partitionBy("archive").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    limit = f"Archive unpacks to over {_size(max_unpacked)}"
    reason = (
        F.when(leaves_root(F.col("name")), F.concat(F.lit("Entry leaves the archive root: "), "name"))
        .when(F.sum("file_size").over(so_far) > max_unpacked, F.lit(limit))
        .when(F.col("encrypted"), F.concat(F.lit("Encrypted entry in zip: "), "name"))
    )
    first = (
        bounded.filter(F.col("idx").isNotNull())
        .select("archive", "idx", reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
        .groupBy("archive")
        .agg(F.min_by("reason", "idx").alias("reason"))
    )
    return crowded.unionByName(first)


def archive_rejects(
    archives: DataFrame,
    entries: DataFrame,
    max_upload: int = MAX_UPLOAD_BYTES,
    max_entries: int = MAX_ENTRIES,
    max_unpacked: int = MAX_UNPACKED_BYTES,
) -> DataFrame:
    """(archive, reason) for every archive that must not be unpacked; one reason each."""
    outside = archives.select(
        "archive", turned_away(max_upload).alias("reason")
    ).filter(F.col("reason").isNotNull())
    broken = entries.filter(~F.col("is_zip")).select(
        "archive", F.lit("Archive cannot be opened as zip").alias("reason")
    )
    inside = entry_rejects(entries.filter("is_zip"), max_entries, max_unpacked)
    return outside.unionByName(broken).unionByName(inside)


def _damaged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for archive, location in zip(*(batch.column(c).to_pylist() for c in ("archive", "location"))):
            name = None
            try:
                with stores.opened(location) as handle, zipfile.ZipFile(handle) as packed:
                    for member in packed.infolist():
                        name = _plain(member.filename)
                        with packed.open(member) as content:
                            while content.read(_CHUNK_BYTES):
                                pass
            except Exception:
                found.append((archive, f"Damaged entry in zip: {name}" if name else "Archive cannot be opened as zip"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[k] for row in found], pa.string()) for k in (0, 1)], names=["archive", "reason"]
        )


def damaged_archives(archives: DataFrame, rejects: DataFrame, folder: str | None = None) -> DataFrame:
    """(archive, reason) of archives that passed the guards but have an entry that cannot be unpacked.

    Every entry is unpacked in chunks and thrown away: an archive is taken as a whole or not at all.
    """
    good = archives.join(rejects.select("archive"), "archive", "left_anti")
    return in_equal_tasks(good, folder).select("archive", "location").mapInArrow(_damaged, "archive STRING, reason STRING")


def _paths_in(entries: DataFrame) -> DataFrame:
    """(archive, path) of the Python files that entries unpack to, without steps that lead nowhere."""
    steps = F.filter(F.split("name", "/", -1), lambda step: ~step.isin("", ".", ".."))
    files = entries.filter(F.col("idx").isNotNull() & ~F.col("is_dir") & F.col("name").endswith(".py"))
    return files.select("archive", F.array_join(steps, "/").alias("path")).distinct()


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, location in zip(*(batch.column(c).to_pylist() for c in ("archive", "location"))):
            rows, held = [], 0
            with stores.opened(location) as handle, zipfile.ZipFile(handle) as packed:
                members = {}
                for member in packed.infolist():
                    if not member.is_dir() and member.filename.endswith(".py"):
                        steps = _plain(member.filename).split("/")
                        members["/".join(s for s in steps if s not in ("", ".", ".."))] = member
                for path, member in members.items():
                    row = {"project": archive, "path": path, "content": None, "read_error": None}
                    try:
                        row["content"] = packed.read(member)
                    except Exception as error:
                        row["read_error"] = f"Not readable: {error}"
                    rows.append(row)
                    held += len(row["content"] or b"")
                    if held >= _BATCH_BYTES:
                        yield _batch(rows, _FILE_TYPES)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, _FILE_TYPES)


def unpack(
    archives: DataFrame, rejects: DataFrame, excludes: Iterable[str] | None = None, folder: str | None = None
) -> DataFrame:
    """``files`` of all archives that passed the guards; of entries with one path the last counts."""
    good = archives.join(rejects.select("archive"), "archive", "left_anti")
    unpacked = in_equal_tasks(good, folder).select("archive", "location").mapInArrow(
        _unpack, "project STRING, path STRING, content BINARY, read_error STRING"
    )
    return exclude_dirs(unpacked, excludes).select(
        "project", "path", decode(F.col("content")).alias("content"), "read_error"
    )


class Uploads(NamedTuple):
    """Staged tables of all archives below a root: the listing, entries, and the reasons to turn some away."""

    listed: DataFrame
    entries: DataFrame
    rejects: DataFrame
    excludes: tuple[str, ...] | None
    folder: str | None

    def files(self) -> DataFrame:
        """``files`` of the archives that are taken, unpacked as they are read."""
        return unpack(self.listed, self.rejects, self.excludes, self.folder)

    def found(self) -> DataFrame:
        """(project, path) of all files of the archives that are taken; nothing is unpacked for it."""
        taken = self.entries.join(self.rejects.select("archive"), "archive", "left_anti")
        return exclude_dirs(_paths_in(taken), self.excludes).withColumnRenamed("archive", "project")


def open_archives(
    spark: SparkSession,
    root: str,
    excludes: Iterable[str] | None = None,
    max_upload: int = MAX_UPLOAD_BYTES,
    max_entries: int = MAX_ENTRIES,
    max_unpacked: int = MAX_UNPACKED_BYTES,
    folder: str | None = None,
) -> Uploads:
    """List all archives below ``root``, read their directories, apply the guards, then test what passed them.

    ``root`` may be an address in any store (see ``stores``). An archive is opened for its directory, and if it
    passes the guards, once to test its entries; ``files`` opens it once more.
    """
    listed = stage(list_archives(spark, root, folder), "archives", folder)
    entries = stage(archive_entries(listed, max_upload, folder), "archive_entries", folder)
    guarded = stage(archive_rejects(listed, entries, max_upload, max_entries, max_unpacked), "archive_rejects", folder)
    damaged = stage(damaged_archives(listed, guarded, folder), "archive_damages", folder)
    return Uploads(listed, entries, guarded.unionByName(damaged), tuple(excludes) if excludes else None, folder)


def load_archives(
    spark: SparkSession,
    root: str,
    excludes: Iterable[str] | None = None,
    max_upload: int = MAX_UPLOAD_BYTES,
    max_entries: int = MAX_ENTRIES,
    max_unpacked: int = MAX_UNPACKED_BYTES,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(files, rejects) of all archives below ``root``; the archive's path is the project."""
    uploads = open_archives(spark, root, excludes, max_upload, max_entries, max_unpacked, folder)
    return uploads.files(), uploads.rejects


def scan_states(uploads: Uploads, crashes: DataFrame | None = None) -> DataFrame:
    """(project, status, error, files_scanned) of every archive, from its tables alone.

    ``rejected`` archives were turned away and have no files; ``failed`` ones are those of
    ``crashes`` (project, error) and keep what was found; ``empty`` ones have no Python file; the rest is ``ok``.
    """
    found = uploads.found().groupBy("project").agg(F.count(F.lit(1)).cast("int").alias("n"))
    none = F.lit(None).cast("string")
    rows = (
        uploads.listed.select(F.col("archive").alias("project"), none.alias("reason"), none.alias("crash"), F.lit(0).alias("n"))
        .unionByName(uploads.rejects.select(F.col("archive").alias("project"), "reason", none.alias("crash"), F.lit(0).alias("n")))
        .unionByName(found.select("project", none.alias("reason"), none.alias("crash"), "n"))
    )
    if crashes is not None:
        rows = rows.unionByName(
            crashes.select("project", none.alias("reason"), F.col("error").alias("crash"), F.lit(0).alias("n"))
        )
    told = rows.groupBy("project").agg(
        F.min("reason").alias("reason"), F.min("crash").alias("crash"), F.sum("n").cast("int").alias("files_scanned")
    )
    status = (
        F.when(F.col("reason").isNotNull(), "rejected").when(F.col("crash").isNotNull(), "failed")
        .when(F.col("files_scanned") == 0, "empty").otherwise("ok")
    )
    return told.select("project", status.alias("status"), F.coalesce("reason", "crash").alias("error"), "files_scanned")


def failed_scans(
    states: DataFrame, found: DataFrame, part_rows: int = 5000, folder: str | None = None
) -> DataFrame:
    """Report rows of projects that were not scanned: status, error, number and list of found files.

    ``states`` are those of ``scan_states``; ``found`` lists files (project, path). A list longer than
    ``part_rows`` goes on in further parts, so that no row or task holds an unbounded project.
    """
    failed = states.filter(F.col("status").isin("rejected", "failed"))
    listed = semi_join_spread(found.select("project", "path"), failed.filter("status = 'failed'"), "project", "path")
    part = F.floor((F.col("seq") - 1) / part_rows).cast("int")
    lists = (
        numbered(listed, ["project"], ["path"], folder=folder)
        .groupBy("project", part.alias("part"))
        .agg(F.array_sort(F.collect_list("path")).alias("files_list"))
    )
    last = F.floor((F.greatest("files_scanned", F.lit(1)) - 1) / part_rows).cast("int")
    heads = failed.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    return heads.join(lists, ["project", "part"], "left").select(
        "project", "part", "status", "error", "files_scanned",
        F.coalesce("files_list", F.array().cast("array<string>")).alias("files_list"),
    )
