"""Folders and files by address: local paths that all executors see, or any store Arrow has a reader for.

Spark's own file sources drop names that start with ``_`` or ``.`` and cannot list folders as rows, so
tasks list and read by themselves. An address that only Hadoop knows, such as ``viewfs://``, is
resolved on the driver to the place it stands for. Locations are bytes: a path, or an address
with a scheme. A name is bytes on a local disk, so locations are, too.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

from pyarrow import fs as arrow
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_SCHEME = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*://")
_stores: dict[bytes, tuple[arrow.FileSystem, str]] = {}


class Entry(NamedTuple):
    """A name in a folder; ``folder`` is None for a link to one, ``length`` None if it cannot be told."""

    name: str
    location: bytes
    folder: bool | None
    length: int | None
    error: str | None


def reason(error: Exception) -> str:
    return f"Not readable: {getattr(error, 'strerror', None) or error}"


def resolved(spark: SparkSession, root: str) -> list[tuple[str, bytes]]:
    """(path below the root, location) of what ``root`` stands for; several if it is a table of mounts.

    A root that cannot be resolved stays as it is, so that reading it reports the error.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getScheme() == "file":
        return [("", os.fsencode(os.path.abspath(re.sub("^file:(//)?", "", root))))]

    def real(path) -> bytes:
        try:
            uri = store.resolvePath(path).toUri()
        except Py4JJavaError:
            return path.toString().encode()
        return uri.getPath().encode() if uri.getScheme() in (None, "file") else uri.toString().encode()

    location = real(path)
    if not location.startswith(b"viewfs:"):
        return [("", location)]
    try:
        return [(status.getPath().getName(), real(status.getPath())) for status in store.listStatus(path)]
    except Py4JJavaError:
        return [("", location)]


def _remote(location: bytes) -> tuple[arrow.FileSystem, str] | None:
    """The store and the path in it, or None for a local path."""
    scheme = _SCHEME.match(location)
    if not scheme:
        return None
    end = location.find(b"/", scheme.end())
    head = location if end < 0 else location[:end]
    try:
        if head not in _stores:
            _stores[head] = arrow.FileSystem.from_uri(head.decode() + "/")
    except (ValueError, OSError, NotImplementedError) as error:
        raise OSError(f"no reader for {head.decode()} ({error})") from error
    store, base = _stores[head]
    return store, base.rstrip("/") + location[len(head) :].decode()


def is_folder(location: bytes) -> bool:
    """Whether it is a folder; raises OSError if there is nothing."""
    remote = _remote(location)
    if remote is None:
        os.stat(location)
        return os.path.isdir(location)
    kind = remote[0].get_file_info(remote[1]).type
    if kind == arrow.FileType.NotFound:
        raise FileNotFoundError(2, "No such file or directory")
    return kind == arrow.FileType.Directory


def length(location: bytes) -> int:
    remote = _remote(location)
    return os.stat(location).st_size if remote is None else remote[0].get_file_info(remote[1]).size


def entries(folder: bytes) -> Iterator[Entry]:
    """What a folder holds, one by one."""
    remote = _remote(folder)
    if remote is None:
        yield from _local_entries(folder)
        return
    store, path = remote
    for info in store.get_file_info(arrow.FileSelector(path)):
        is_dir = info.type == arrow.FileType.Directory
        yield Entry(info.base_name, folder + b"/" + info.base_name.encode(), is_dir, None if is_dir else info.size, None)


def _local_entries(folder: bytes) -> Iterator[Entry]:
    with os.scandir(folder) as found:
        for entry in found:
            name = os.fsdecode(entry.name)
            if entry.is_dir():
                yield Entry(name, entry.path, None if entry.is_symlink() else True, None, None)
                continue
            try:
                yield Entry(name, entry.path, False, entry.stat().st_size, None)
            except OSError as error:
                yield Entry(name, entry.path, False, None, reason(error))


def opened(location: bytes) -> BinaryIO:
    """The file to read, in any order of places: an archive's directory is read without its contents."""
    remote = _remote(location)
    return open(location, "rb") if remote is None else remote[0].open_input_file(remote[1])


def write(location: bytes, content: bytes) -> None:
    remote = _remote(location)
    if remote is None:
        os.makedirs(os.path.dirname(location), exist_ok=True)
        with open(location, "wb") as handle:
            handle.write(content)
        return
    store, path = remote
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as handle:
        handle.write(content)
