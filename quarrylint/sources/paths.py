"""Path rules shared by trees, archives and tables of files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directory names left out by default.
DEFAULT_EXCLUDES = (
    ".git", ".hg", ".svn", "__pycache__", ".venv", "venv", "env", "node_modules",
    ".tox", ".mypy_cache", ".pytest_cache", "build", "dist", ".eggs",
)


def in_excluded_dir(path: Column, excludes: Iterable[str] = DEFAULT_EXCLUDES) -> Column:
    """True if a directory above the file is excluded or hidden; the file name does not count."""
    segments = F.split(path, "/")
    directories = F.slice(segments, 1, F.size(segments) - 1)
    names = F.array(*[F.lit(name) for name in excludes]).cast("array<string>")
    return F.exists(directories, lambda d: d.startswith(".")) | F.arrays_overlap(directories, names)


def exclude_dirs(
    files: DataFrame,
    excludes: Iterable[str] | None = None,
    extra_excludes: Iterable[str] = (),
) -> DataFrame:
    """Drop files below excluded directories. Given names replace the defaults, extras add to them."""
    names = [*(excludes or DEFAULT_EXCLUDES), *extra_excludes]
    return files.filter(~in_excluded_dir(F.col("path"), names))


def python_files(files: DataFrame) -> DataFrame:
    """Keep ``*.py``; the test is case-sensitive."""
    return files.filter(F.col("path").endswith(".py"))


def files_list(files: DataFrame) -> DataFrame:
    """Every discovered path, relative to its project."""
    return files.select("project", "path")
