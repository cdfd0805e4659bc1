"""Checks of the rules, each on the files made for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylint.checks import corpus as made
from quarrylint.checks import oracle
from quarrylint.checks.base import ISSUE_FIELDS, Query, check
from quarrylint.checks.fact_checks import ORDER_ITEMS, staged_order_facts
from quarrylint.functions import facts as code
from quarrylint.functions.staging import stage
from quarrylint.functions.text import entropy
from quarrylint.operators import duplicates, tree_rules
from quarrylint.operators.registry import builtin_rule, python_rule
from quarrylint.operators.secrets import secret_hits
from quarrylint.plans.scan import file_issues, scan_facts, scan_issues


def rule_query(checker: str, files: Query, **thresholds) -> Query:
    def run(spark, sf_dir):
        rule = builtin_rule(checker)
        facts = scan_facts(files(spark, sf_dir), [rule])
        if rule.query is not None:
            facts = stage(facts, "facts")
        return scan_issues(facts, [rule], {checker: thresholds}).select(*ISSUE_FIELDS)

    return run


def family_union(*names: str) -> Query:
    return lambda spark, sf_dir: made.families(spark, sf_dir, *names)


for _number, _checker, _files in (
    ("r01", "complexity", family_union("branches", "nest")),
    ("r02", "long-function", family_union("branches", "long")),
    ("r04", "unused-imports", family_union("imports")),
    ("r05", "deep-nesting", family_union("nest")),
    ("r06", "too-many-parameters", family_union("params")),
    ("r07", "long-file", family_union("long")),
    ("r08", "large-class", family_union("long")),
    ("r09", "mutable-default-arg", family_union("defaults")),
    ("r10", "broad-exception", family_union("handlers")),
    ("r11", "dangerous-exec", made.call_files),
    ("r12", "unsafe-subprocess", made.call_files),
    ("r13", "weak-crypto", made.call_files),
    ("r14", "unsafe-deserialization", made.call_files),
    ("r15", "sql-injection-risk", made.call_files),
    ("r16", "hardcoded-secret", family_union("secrets")),
):
    check(f"{_number}_{_checker.replace('-', '_')}", oracle.issues_sql([_checker]))(rule_query(_checker, _files))

check("r03_duplicate_code", oracle.issues_sql(["duplicate-code"]))(
    rule_query("duplicate-code", family_union("dups", "branches", "nest"))
)


@check("r01_complexity_of_functions", f"""WITH {oracle.PART}
    SELECT project, 'nest/part_' || k || '.py' AS path, 'g' AS name, 2 + s % 7 AS score, 1 + s % 7 AS deepest FROM part_rows
    UNION ALL SELECT project, 'branches/part_' || k || '.py', 'h', 1 + s, 1 FROM part_rows""")
def complexity_of_functions(spark, sf_dir):
    facts = code.extract_facts(family_union("nest", "branches")(spark, sf_dir))
    return code.functions(facts).select(
        "project", "path", "name",
        tree_rules.complexity_score(F.struct("decisions")).alias("score"), F.size("nesting").alias("deepest"),
    )


COPIES = f"""WITH {ORDER_ITEMS}, bodies AS (SELECT *, count(*) OVER (PARTITION BY project, q, f) AS occurrences,
    row_number() OVER (PARTITION BY project, q, f ORDER BY path, pos) AS place FROM placed WHERE q + 3 >= 5)"""


@check("r03_duplicate_groups", COPIES + """ SELECT project, occurrences::INT AS occurrences, path AS first_path,
    lineno AS first_line FROM bodies WHERE place = 1 AND occurrences > 1""")
def duplicate_groups(spark, sf_dir):
    return duplicates.duplicate_groups(staged_order_facts(spark, sf_dir)).select(
        "project", "occurrences", F.col("first.path").alias("first_path"), F.col("first.lineno").alias("first_line")
    )


@check("r03_duplicate_places", COPIES + """ SELECT project, path, lineno, 'line_' || n AS name,
    occurrences::INT AS occurrences, place = 1 AS is_first FROM bodies WHERE occurrences > 1""")
def duplicate_places(spark, sf_dir):
    return duplicates.duplicate_places(staged_order_facts(spark, sf_dir)).select(
        "project", "path", "lineno", "name", "occurrences", "is_first"
    )


@check("r03_hot_copies", COPIES + """, firsts AS (SELECT project, q, f, path, count(*) OVER (PARTITION BY project, q, f)::INT AS measure,
        place FROM bodies WHERE occurrences > 1)
    SELECT firsts.project, firsts.path, measure, 'One body, ' || measure || ' functions; this is the first of them' AS message,
        bodies.path AS other_path, bodies.lineno AS other_line
    FROM firsts JOIN bodies USING (project, q, f) WHERE firsts.place = 1 AND bodies.place > 1""")
def hot_copies(spark, sf_dir):
    """Every issue with all other places of its body, found through its first place."""
    facts = staged_order_facts(spark, sf_dir)
    places = duplicates.duplicate_places(facts).filter("NOT is_first").select(
        "project", F.col("first_path").alias("path"), F.col("first_line").alias("line"),
        F.col("path").alias("other_path"), F.col("lineno").alias("other_line"),
    )
    return duplicates.duplicate_code(facts).join(places, ["project", "path", "line"]).select(
        "project", "path", "measure", "message", "other_path", "other_line"
    )


@check("r07_long_documents", f"""SELECT source AS project, doc_id::VARCHAR AS path, n AS measure
    FROM (SELECT *, len({oracle.line_list('text')})::INT AS n FROM documents) WHERE n > 20""")
def long_documents(spark, sf_dir):
    rule = builtin_rule("long-file")
    facts = scan_facts(made.document_files(spark, sf_dir), [rule])
    return file_issues(facts, [rule], {"long-file": {"threshold": 20}}).select("project", "path", "measure")


_ASSIGNED = (
    r"""(?i)(?:token|secret|password|api_key)\w*["'']?\s*(?::\s*[a-z_][a-z0-9_.\[\]]*\s*=|=|:)"""
    r"""\s*[rbuf]{0,2}["'']([^"''\s]{16,})["'']"""
)
_SIGNED = (
    ("aws-access-key", "AKIA[0-9A-Z]{16}"), ("github-token", "gh[pousr]_[A-Za-z0-9]{36}"),
    ("slack-token", "xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("json-web-token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("private-key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


@check("r16_document_secrets", f"""WITH split AS (SELECT doc_id, {oracle.line_list('text')} AS parts FROM documents),
    all_lines AS (SELECT doc_id, unnest(range(1, len(parts) + 1))::INT AS line, unnest(parts) AS text FROM split),
    known AS (""" + " UNION ALL ".join(
        f"SELECT doc_id, line, text, '{kind}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{pattern}'))) AS value FROM all_lines"
        for kind, pattern in _SIGNED) + f"""),
    assigned AS (SELECT doc_id, line, text, 'high-entropy' AS kind,
        unnest(list_distinct(regexp_extract_all(text, '{_ASSIGNED}', 1))) AS value
        FROM all_lines ANTI JOIN known USING (doc_id, line)),
    hits AS (SELECT *, NULL AS bits FROM known UNION ALL
        SELECT * FROM (SELECT *, {oracle.entropy('value')} AS bits FROM assigned) WHERE bits >= 3.0)
    SELECT doc_id, line, instr(text, value)::INT AS "column", kind, value[1:4] || '****' AS snippet, bits::DOUBLE AS bits
    FROM hits""")
def document_secrets(spark, sf_dir):
    hits = made.document_files(spark, sf_dir).select(
        F.col("path").cast("bigint").alias("doc_id"), F.inline(secret_hits(F.col("content")))
    )
    return hits.select("doc_id", "line", "column", "kind", F.col("shown").alias("snippet"), "bits")


@check("r16_entropy", f"""SELECT item_id, {oracle.entropy('text')} AS bits FROM benchmark WHERE text <> ''
    UNION ALL SELECT doc_id + 1000000, {oracle.entropy('lang')} FROM documents""")
def text_entropy(spark, sf_dir):
    items = made.table(spark, sf_dir, "benchmark").filter("text <> ''").select("item_id", entropy(F.col("text")).alias("bits"))
    langs = made.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1000000).alias("item_id"), entropy(F.col("lang")).alias("bits")
    )
    return items.unionByName(langs)


def _fragile_check(path: str, content: str) -> list[dict]:
    """A custom rule that flags additions and breaks on subtractions: here, on files with 30 branches."""
    branches = content.count("x += 1")
    if branches == 30:
        raise ValueError("thirty")
    if branches > 40:
        return [{"severity": "info", "line": 1, "message": f"{branches} branches", "measure": branches}]
    return []


@check("r17_rule_failure", f"""WITH {oracle.PART}
    SELECT project, 'branches/part_' || k || '.py' AS path, 'UNKNOWN' AS rule_id, 'branch-count' AS checker,
        CASE WHEN s = 30 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN s = 30 THEN 0 ELSE 1 END AS line,
        CASE WHEN s = 30 THEN 'Rule ''branch-count'' failed on this file: thirty' ELSE s || ' branches' END AS message
    FROM part_rows WHERE s = 30 OR s > 40""")
def rule_failure(spark, sf_dir):
    rule = python_rule("branch-count", "quality", _fragile_check)
    facts = scan_facts(made.families(spark, sf_dir, "branches"), [rule])
    return file_issues(facts, [rule]).select("project", "path", "rule_id", "checker", "severity", "line", "message")
