"""A scan: files to facts to issues, for any number of projects in one job."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylint.functions.facts import extract_facts, parse_errors
from quarrylint.functions.staging import numbered, remove, shared_folder, stage
from quarrylint.functions.text import n_lines
from quarrylint.operators.catalog import severity_rank
from quarrylint.operators.duplicates import duplicate_places
from quarrylint.operators.findings import FINDING_DDL, ISSUE_COLUMNS, ISSUE_ORDER, finding
from quarrylint.operators.registry import Rule, choose_rules
from quarrylint.operators.secrets import HIT_DDL, secret_hits

Thresholds = Mapping[str, Mapping[str, object]]


@dataclass(frozen=True)
class Scan:
    """The tables of one scan."""

    files: DataFrame
    facts: DataFrame
    issues: DataFrame
    parse_errors: DataFrame
    rules: tuple[str, ...]
    folder: str | None = None

    def duplicate_places(self, min_lines: int = 5) -> DataFrame:
        """All places of every duplicated body; see ``duplicates.duplicate_places``."""
        return duplicate_places(self.facts, min_lines, self.folder)

    def drop(self) -> None:
        """Delete what this scan and the reports on it have staged; its tables cannot be read any more."""
        if self.folder is not None:
            remove(self.facts.sparkSession, self.folder)


def scan_facts(
    files: DataFrame, rules: Sequence[Rule], partitions: int | None = None, parse: bool = False
) -> DataFrame:
    """One row per file with all that ``rules`` read.

    Text expressions are evaluated on the way into the extractor, so the source table is read
    once. Without a tree rule there is no Python stage at all, unless ``parse`` asks for it.
    """
    text = F.col("content")
    columns = files if partitions is None else files.repartition(partitions, "project", "path")
    if any(rule.checker == "hardcoded-secret" for rule in rules):
        hits = F.when(text.isNotNull(), secret_hits(text)).otherwise(F.array().cast(HIT_DDL))
        columns = columns.withColumn("secret_hits", hits)
    for rule in rules:
        if rule.reads_text and rule.query is None:
            columns = columns.withColumn(_custom_column(rule), rule.findings())
    if parse or any(rule.needs_tree for rule in rules):
        return extract_facts(columns, parts=_parts(rules))
    return columns.withColumn("n_lines", n_lines(text)).drop("content")


def _parts(rules: Sequence[Rule]) -> set[str] | None:
    """The tree parts that ``rules`` read; None, for all, if a rule with a tree does not name its own."""
    trees = [rule for rule in rules if rule.needs_tree and not rule.reads_text]
    if any(not rule.parts for rule in trees):
        return None
    return {part for rule in trees for part in rule.parts}


def _custom_column(rule: Rule) -> str:
    return f"findings of {rule.checker}"


def _findings(rule: Rule, thresholds: Mapping[str, object]) -> Column:
    """The findings of one file rule, or one warning at line 0 if its facts could not be had."""
    if rule.reads_text:
        return F.col(f"`{_custom_column(rule)}`")
    found = rule.findings(**thresholds)
    if not rule.parts:
        return found
    broken = F.filter("failures", lambda f: f["part"].isin(*rule.parts))
    text = F.concat(F.lit(f"Rule '{rule.checker}' failed on this file: "), F.get(broken, F.lit(0))["error"])
    any_broken = (F.size("failures") > 0) & (F.size(broken) > 0)  # the first test alone settles nearly every file
    return F.when(any_broken, F.array(finding("warning", 0, text))).otherwise(found)


def _limits(rule: Rule, thresholds: Thresholds | None) -> Mapping[str, object]:
    return (thresholds or {}).get(rule.checker, {})


_MARK_DDL = "rule:struct<rule_id:string,checker:string,category:string,rule_order:int>"


def _marked(rule: Rule, order: int, found: Column) -> Column:
    mark = F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.checker).alias("checker"),
        F.lit(rule.category).alias("category"),
        F.lit(order).alias("rule_order"),
    )
    return F.transform(found, lambda f: F.struct(mark.alias("rule"), f.alias("found")))


def file_issues(facts: DataFrame, rules: Sequence[Rule], thresholds: Thresholds | None = None) -> DataFrame:
    """Issues of all rules over single files: one expression and one explode over the facts."""
    by_part: dict[str | None, list[Column]] = {}
    for order, rule in enumerate(rules):
        if rule.query is None:
            found = _marked(rule, order, _findings(rule, _limits(rule, thresholds)))
            by_part.setdefault(rule.over, []).append(found)
    found = F.concat(*(_if_any(part, F.concat(*arrays)) for part, arrays in by_part.items()))
    issues = facts.select("project", "path", F.explode(found).alias("issue")).select(
        "project", "path", "issue.rule.*", "issue.found.*"
    )
    return _issue_columns(issues, F.lit(0))


def _if_any(part: str | None, found: Column) -> Column:
    """``found`` by rules over the entries of ``part``; one test settles a file that has none."""
    if part is None:
        return found
    none = F.array().cast(f"array<struct<{_MARK_DDL},found:{FINDING_DDL}>>")
    return F.when((F.size(part) == 0) & (F.size("failures") == 0), none).otherwise(found)


def all_files_issues(
    facts: DataFrame, rules: Sequence[Rule], thresholds: Thresholds | None = None, files: DataFrame | None = None
) -> list[DataFrame]:
    """Issues of the rules that compare files; they come after all others, in rule order.

    ``files`` is needed for rules that read texts.
    """
    found = []
    for order, rule in enumerate(rules):
        if rule.query is not None:
            rows = rule.query(files if rule.reads_text else facts, **_limits(rule, thresholds)).withColumns({
                "rule_id": F.lit(rule.rule_id),
                "checker": F.lit(rule.checker),
                "category": F.lit(rule.category),
                "rule_order": F.lit(order),
            })
            found.append(_issue_columns(rows, F.lit(1 + order)))
    return found


def _issue_columns(rows: DataFrame, phase: Column) -> DataFrame:
    ranked = rows.withColumns({"severity_rank": severity_rank(F.col("severity")), "phase": phase})
    order = [c for c in ISSUE_ORDER if c not in ISSUE_COLUMNS]
    return ranked.select(*ISSUE_COLUMNS, *order)


def scan_issues(
    facts: DataFrame, rules: Sequence[Rule], thresholds: Thresholds | None = None, files: DataFrame | None = None
) -> DataFrame:
    parts = all_files_issues(facts, rules, thresholds, files)
    if any(rule.query is None for rule in rules):
        parts.insert(0, file_issues(facts, rules, thresholds))
    return reduce(DataFrame.unionByName, parts)


def scan(
    files: DataFrame,
    profile: str | Iterable[str] = "web",
    only: str | None = None,
    thresholds: Thresholds | None = None,
    extra_rules: Sequence[Rule] = (),
    folder: str | None = None,
    partitions: int | None = None,
    parse: bool = True,
) -> Scan:
    """Run the rules of ``profile`` over ``files`` (project, path, content[, read_error]).

    ``thresholds`` maps rule names to keyword arguments, as ``{"complexity": {"threshold": 15}}``.
    Facts and issues are staged as Parquet below ``folder`` (by default the folder named in
    spark.checkpoint.dir, else the warehouse) in a folder of the scan's own, so files are parsed once for rules, duplicates and reports. Give
    ``partitions`` where ``files`` has too few of them to keep the cores busy. Syntax errors are
    reported whatever the rules; with ``parse=False`` they are not, if no rule needs a tree.
    """
    rules = choose_rules(profile, only, extra_rules)
    if not rules:
        raise ValueError("no rules chosen")
    spark = files.sparkSession
    folder = f"{folder or shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    facts = stage(scan_facts(files, rules, partitions, parse), "facts", folder)
    issues = stage(scan_issues(facts, rules, thresholds, files), "issues", folder)
    errors = parse_errors(facts if "parse_error" in facts.columns else _unparsed(facts))
    return Scan(files, facts, issues, errors, tuple(rule.checker for rule in rules), folder)


def _unparsed(facts: DataFrame) -> DataFrame:
    return facts.withColumns({
        "parse_error": F.lit(None).cast("string"),
        "error_line": F.lit(None).cast("int"),
    })


def in_order(issues: DataFrame, folder: str | None = None) -> DataFrame:
    """Issues with ``seq``: by file, rule and place in the tree, rules over all files last."""
    return numbered(issues, ["project"], ISSUE_ORDER, folder=folder)
