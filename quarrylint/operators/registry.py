"""Rules as registry entries; custom rules are more entries of the same kind."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylint.functions.staging import stage
from quarrylint.operators import tree_rules
from quarrylint.operators.catalog import CATEGORIES, NEEDS_TREE, PROFILES, RULE_IDS
from quarrylint.operators.duplicates import duplicate_code
from quarrylint.operators.findings import FINDING_DDL, finding


@dataclass(frozen=True)
class Rule:
    """One rule: ``findings`` for a rule over one file, ``query`` for one over all files.

    ``findings(**thresholds)`` returns an array of findings as a Column over file facts.
    ``query(facts, **thresholds)`` returns a DataFrame of findings with project and path.
    ``parts`` names the fact columns a rule reads; a file rule fails, as data, if one is missing. Only
    columns that some rule names are gathered; a tree rule that names none may read all of them.
    ``reads_text`` marks a rule that reads ``content``: of one file, before extraction, or, with a
    ``query``, of the files given instead of the facts.
    ``over`` names the part whose entries a file rule judges, if it finds nothing in a file without any.
    """

    checker: str
    category: str
    findings: Callable[..., Column] | None = None
    query: Callable[..., DataFrame] | None = None
    parts: Sequence[str] = ()
    needs_tree: bool = True
    reads_text: bool = False
    rule_id: str = "UNKNOWN"
    over: str | None = None


_FILE_RULES = {
    "complexity": (tree_rules.complexity, ("functions",)),
    "long-function": (tree_rules.long_function, ("functions",)),
    "unused-imports": (tree_rules.unused_imports, ("imports", "names", "exported")),
    "hardcoded-secret": (tree_rules.hardcoded_secret, ()),
    "deep-nesting": (tree_rules.deep_nesting, ("functions",)),
    "too-many-parameters": (tree_rules.too_many_parameters, ("functions",)),
    "long-file": (tree_rules.long_file, ()),
    "large-class": (tree_rules.large_class, ("classes",)),
    "mutable-default-arg": (tree_rules.mutable_default_arg, ("functions",)),
    "broad-exception": (tree_rules.broad_exception, ("handlers",)),
    "dangerous-exec": (tree_rules.dangerous_exec, ("calls",)),
    "unsafe-subprocess": (tree_rules.unsafe_subprocess, ("calls",)),
    "weak-crypto": (tree_rules.weak_crypto, ("calls", "imports")),
    "unsafe-deserialization": (tree_rules.unsafe_deserialization, ("calls", "imports")),
    "sql-injection-risk": (tree_rules.sql_injection_risk, ("calls",)),
}


def builtin_rule(checker: str) -> Rule:
    findings, parts = _FILE_RULES.get(checker, (None, ()))
    return Rule(
        checker=checker,
        category=CATEGORIES[checker],
        findings=findings,
        query=duplicate_code if checker == "duplicate-code" else None,
        parts=("bodies",) if checker == "duplicate-code" else parts,
        needs_tree=NEEDS_TREE[checker],
        rule_id=RULE_IDS[checker],
        over=parts[0] if parts else None,
    )


def choose_rules(
    profile: str | Iterable[str] = "web", only: str | None = None, extra: Sequence[Rule] = ()
) -> list[Rule]:
    """The rules of a profile (or of a list of names), restricted to one category if asked.

    Rules are chosen before a plan is built, so the facts of dropped rules are never read.
    """
    names = PROFILES[profile] if isinstance(profile, str) else tuple(profile)
    rules = [builtin_rule(name) for name in names] + list(extra)
    return [rule for rule in rules if only is None or rule.category == only]


def python_rule(
    checker: str,
    category: str,
    check: Callable[[str, str], Iterable[dict]],
    rule_id: str = "UNKNOWN",
) -> Rule:
    """A custom rule from a Python function ``(path, content) -> findings as dicts``.

    It runs as a vectorised UDF on the text of each file. A file on which it raises gives one
    warning at line 0 and the scan goes on.
    """
    schema = T._parse_datatype_string(f"array<{FINDING_DDL}>")
    fields = {f.name: None for f in schema.elementType.fields}
    fields.update(severity="warning", line=0, column=0, snippet="", bfs=0, ord=0)

    def run(paths: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for path, content in zip(paths, contents):
            if content is None:
                out.append([])
                continue
            try:
                found = [{**fields, "ord": i, **f} for i, f in enumerate(check(path, content))]
            except Exception as error:
                text = f"Rule '{checker}' failed on this file: {error}"
                found = [{**fields, "message": text}]
            out.append(found)
        return pd.Series(out)

    run_udf = F.pandas_udf(run, schema)
    return Rule(
        checker=checker,
        category=category,
        findings=lambda: run_udf("path", "content"),
        needs_tree=False,
        reads_text=True,
        rule_id=rule_id,
    )


GATHERED_DDL = "project STRING, path STRING, ord INT, note STRING, error STRING"
_ROWS_OUT = 1000


def _rows(rows: Iterable[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size, even if there are none."""
    kinds = to_arrow_schema(schema)
    rows = iter(rows)
    while True:
        part = list(itertools.islice(rows, _ROWS_OUT))
        columns = list(zip(*part)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)
        if len(part) < _ROWS_OUT:
            return


def _values(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[name].to_pylist() for name in names))


def project_rule(
    checker: str,
    category: str,
    gather: Callable[[str, str], Iterable[str]],
    finish: Callable[[Iterator[tuple[str, str]]], Iterable[dict]],
    rule_id: str = "UNKNOWN",
) -> Rule:
    """A custom rule that compares the files of a project, from two Python functions.

    ``gather(path, content)`` returns the notes of one file, as strings; ``finish(notes)`` takes (path, note)
    of all files of one project as an iterator, in the order of paths, and returns findings as dicts that
    name their ``path``. Texts stay where they are: only notes are shuffled, and a project's notes pass through
    ``finish`` as a stream. If ``gather`` raises, that file gives one warning at line 0 and no notes; if ``finish``
    does, the project gives one with an empty path, after what it has found.
    """
    found_ddl = f"project STRING, path STRING, {FINDING_DDL[len('struct<'):-1].replace(':', ' ')}"
    gathered_type, found_type = (T._parse_datatype_string(ddl) for ddl in (GATHERED_DDL, found_ddl))
    fields = dict.fromkeys(f.name for f in found_type.fields[2:])
    fields.update(severity="warning", line=0, column=0, snippet="", bfs=0, ord=0)

    def notes_of(project: str, path: str, content: str | None) -> list[tuple]:
        if content is None:
            return []
        try:
            return [(project, path, i, note, None) for i, note in enumerate(gather(path, content))]
        except Exception as error:
            return [(project, path, 0, None, f"Rule '{checker}' failed on this file: {error}")]

    def gathering(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _values(batches, ("project", "path", "content"))
        yield from _rows((row for file in files for row in notes_of(*file)), gathered_type)

    def findings_of(project: str, notes: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        try:
            for i, found in enumerate(finish(notes)):
                found = {**fields, "ord": i, **found}
                yield (project, found["path"], *(found[name] for name in fields))
        except Exception as error:
            text = f"Rule '{checker}' failed on this project: {error}"
            yield (project, "", *({**fields, "message": text}[name] for name in fields))

    def finishing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_project = itertools.groupby(_values(batches, ("project", "path", "note")), key=lambda row: row[0])
        yield from _rows(
            (row for project, rows in by_project for row in findings_of(project, (row[1:] for row in rows))), found_type
        )

    def query(files: DataFrame) -> DataFrame:
        gathered = files.select("project", "path", "content").mapInArrow(gathering, gathered_type)
        gathered = stage(gathered, "notes")
        notes = gathered.where("error IS NULL").repartition("project").sortWithinPartitions("project", "path", "ord")
        broken = gathered.where("error IS NOT NULL").select(
            "project", "path", finding("warning", 0, F.col("error")).alias("found")
        ).select("project", "path", "found.*")
        return notes.mapInArrow(finishing, found_type).unionByName(broken)

    return Rule(
        checker=checker, category=category, query=query, needs_tree=False, reads_text=True, rule_id=rule_id
    )
