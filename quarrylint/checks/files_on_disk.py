"""Small trees and archives in the shared folder, written by executors, for checks of the loaders."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylint.checks.corpus import spread, table
from quarrylint.functions.staging import shared_folder
from quarrylint.sources import stores


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per part, below a folder that is kept, private, excluded or hidden."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat(p_brand, '/', element_at(array('src', '_pkg', 'venv', '.hidden'), 1 + p_size % 4), "
        "'/part_', p_partkey, '.py') AS path",
        r"concat('x = ', p_partkey, '\n') AS content",
    )


def brand_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file that tells how many parts each brand has."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    lines = F.array_sort(F.collect_list(F.format_string("%s = %d", "p_brand", "n")))
    return brands.agg(lines.alias("lines")).select(
        F.explode(F.array(F.lit("brands.py"), F.lit("brands.txt"))).alias("path"), F.array_join("lines", "\n").alias("content")
    )


def _written(rows: DataFrame, name: str, content: Callable[[dict], bytes]) -> str:
    """The folder, as Spark knows it, with a file (path) for each row."""
    spark = rows.sparkSession
    shared = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    shared.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(shared)
    name = f"{name}-{uuid.uuid4().hex}"
    base = stores.resolved(spark, shared_folder(spark))[0][1] + f"/{name}/".encode()

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stores.write(base + row["path"].encode(), content(row))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.mapInArrow(put, "n BIGINT").agg(F.sum("n")).collect()
    return f"{shared_folder(spark)}/{name}"


def write_tree(files: DataFrame) -> str:
    return _written(files, "tree", lambda row: row["content"].encode())


def _zipped(row: dict) -> bytes:
    """The archive of a row; a damaged one has other bytes than it says in the text of its notes."""
    if row.get("raw"):
        return b"no archive"
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w") as packed:
        for entry in row["entries"]:
            how = zipfile.ZIP_DEFLATED if entry["content"].startswith("\0") else zipfile.ZIP_STORED
            packed.writestr(entry["name"], entry["content"], compress_type=how)
    content = target.getvalue()
    if row["damaged"]:
        content = content.replace(b"plain text", b"Plain text", 1)
    if row.get("locked"):  # mark the first entry as encrypted, in both of its headers
        central = content.index(b"PK\x01\x02")
        content = content[:6] + b"\1" + content[7 : central + 8] + b"\1" + content[central + 9 :]
    return content


_ENTRY = "named_struct('name', {}, 'content', {})"


def write_archives(spark: SparkSession, sf_dir: str) -> str:
    """A zip per part: some have no Python file, some try to leave the root, some are damaged."""
    entries = ", ".join([
        _ENTRY.format("'src/a.py'", r"concat('x = ', p_partkey, '\n')"),
        _ENTRY.format("'src/__init__.py'", "''"),
        _ENTRY.format("'venv/lib.py'", "'y = 1'"),
        _ENTRY.format("'notes.txt'", "'plain text'"),
        _ENTRY.format("if(p_size % 5 = 0, '../evil.py', 'b/c.py')", r"concat(p_type, '\n')"),
    ])
    zips = table(spark, sf_dir, "part").selectExpr(
        "concat('part_', p_partkey, '.zip') AS path", "p_size % 7 = 3 AS damaged",
        f"if(p_size % 11 = 2, array({_ENTRY.format(repr('notes.txt'), repr('plain text'))}), array({entries})) AS entries",
    )
    return _written(spread(zips, "path"), "archives", _zipped)


#: Limits that the odd archives are made for.
ODD_LIMITS = {"max_upload": 4096, "max_entries": 4, "max_unpacked": 20_000}


def write_odd_archives(spark: SparkSession, sf_dir: str) -> str:
    """An upload per part, each of the nine kinds turned away for another reason, if any."""
    kind = "p_partkey % 9"
    plain, notes = _ENTRY.format("'a.py'", "'x = 1'"), _ENTRY.format("'notes.txt'", "'plain text'")
    more = f"""CASE {kind}
        WHEN 2 THEN array({_ENTRY.format("'b.txt'", "repeat('0123456789', 500)")})
        WHEN 4 THEN transform(sequence(1, 5), i -> {_ENTRY.format("concat('f', i, '.py')", "''")})
        WHEN 5 THEN array({_ENTRY.format("'a/../../b.py'", "''")})
        WHEN 6 THEN array({_ENTRY.format("'zeros.bin'", "repeat(char(0), 30000)")})
        ELSE array({notes}) END"""
    zips = table(spark, sf_dir, "part").selectExpr(
        f"concat('part_', p_partkey, if({kind} = 1, '.tar', '.ZIP')) AS path", f"{kind} = 3 AS raw",
        f"{kind} = 7 AS locked", f"{kind} = 8 AS damaged", f"concat(array({plain}), {more}) AS entries",
    )
    return _written(spread(zips, "path"), "odd-archives", _zipped)
