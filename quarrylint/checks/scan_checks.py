"""Checks of composition and triage: whole scans, order, filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylint.checks import corpus as made
from quarrylint.checks import files_on_disk, oracle
from quarrylint.checks.base import ISSUE_FIELDS, PROJECTS, Query, check, corpus_projects, corpus_scan
from quarrylint.checks.rule_checks import family_union
from quarrylint.functions import facts as code
from quarrylint.functions.staging import numbered
from quarrylint.operators.catalog import explain_issues, rule_catalog
from quarrylint.operators.findings import finding
from quarrylint.operators.registry import Rule, choose_rules, project_rule
from quarrylint.plans import report, triage
from quarrylint.plans.scan import in_order, scan, scan_facts, scan_issues
from quarrylint.sources import tree


@check("c01_full_scan", oracle.issues_sql())
def full_scan(spark, sf_dir):
    return scan(made.corpus(spark, sf_dir)).issues.select(*ISSUE_FIELDS)


@check("c02_issue_order", oracle.issues_cte() + """SELECT project, path, checker, line, symbol,
    row_number() OVER (PARTITION BY project ORDER BY phase, path, rule_order, bfs, ord) AS seq FROM issues""")
def issue_order(spark, sf_dir):
    return in_order(corpus_scan(spark, sf_dir).issues).select("project", "path", "checker", "line", "symbol", "seq")


_SECURITY_RULES = [c for c, category in oracle.CATEGORIES.items() if category == "security"]
_CLI_RULES = ["complexity", "long-function", "duplicate-code", "unused-imports", "hardcoded-secret"]


@check("c03_only_security", oracle.issues_sql(_SECURITY_RULES))
def only_security(spark, sf_dir):
    return scan(made.corpus(spark, sf_dir), only="security").issues.select(*ISSUE_FIELDS)


@check("c04_thresholds", oracle.issues_sql(
    ["complexity", "long-function", "deep-nesting", "too-many-parameters", "long-file", "large-class"],
    **{"complexity": 20, "long-function": 30, "deep-nesting": 2, "too-many-parameters": 3, "long-file": 200,
       "large-class": 100}))
def thresholds(spark, sf_dir):
    limits = {"complexity": 20, "long-function": 30, "deep-nesting": 2, "too-many-parameters": 3,
              "long-file": 200, "large-class": 100}
    rules = choose_rules(list(limits))
    facts = scan_facts(family_union("branches", "nest", "params", "long")(spark, sf_dir), rules)
    given = {name: {"threshold": limit} for name, limit in limits.items()}
    return scan_issues(facts, rules, given).select(*ISSUE_FIELDS)


@check("c05_cli_profile", oracle.issues_sql(_CLI_RULES))
def cli_profile(spark, sf_dir):
    return scan(made.corpus(spark, sf_dir), profile="cli").issues.select(*ISSUE_FIELDS)


@check("c06_custom_rules", f"""WITH {oracle.PART}
    SELECT project, 'dups/part_' || k || '.py' AS path, 'ORG001' AS rule_id, 'short-name' AS checker,
        'd_' || k AS symbol, 'Short function name' AS message FROM part_rows WHERE len(k) <= 2
    UNION ALL SELECT project, min('dups/part_' || k || '.py'), 'UNKNOWN', 'crowded-project', NULL,
        'Project has ' || count(*) || ' functions' FROM part_rows GROUP BY project""")
def custom_rules(spark, sf_dir):
    def short_name():
        return F.transform(
            F.filter("functions", lambda f: F.length(f["name"]) <= 4),
            lambda f: finding("info", f["lineno"], "Short function name", symbol=f["name"], bfs=f["bfs"]),
        )

    def crowded(facts):
        counted = code.functions(facts).groupBy("project").agg(F.count("*").alias("n"), F.min("path").alias("path"))
        note = finding("info", 1, F.format_string("Project has %d functions", "n"))
        return counted.select("project", "path", note.alias("f")).select("project", "path", "f.*")

    rules = [
        Rule("short-name", "quality", findings=short_name, parts=("functions",), rule_id="ORG001"),
        Rule("crowded-project", "quality", query=crowded),
    ]
    facts = code.extract_facts(made.families(spark, sf_dir, "dups"))
    return scan_issues(facts, rules).select("project", "path", "rule_id", "checker", "symbol", "message")


@check("c06_project_rule", f"""WITH {oracle.PART}, noted AS (SELECT project, 'dups/part_' || k || '.py' AS path, t
        FROM part_rows WHERE k::INT % 50 <> 0), placed AS (SELECT *, first_value(path) OVER same AS first FROM noted
        WINDOW same AS (PARTITION BY project, t ORDER BY path))
    SELECT project, path, 'same-type' AS checker, 'warning' AS severity, 'Type also in ' || first AS message FROM placed WHERE path <> first
    UNION ALL SELECT project, 'dups/part_' || k || '.py', 'same-type', 'warning',
        'Rule ''same-type'' failed on this file: no part ' || k FROM part_rows WHERE k::INT % 50 = 0
    UNION ALL SELECT DISTINCT project, '', 'same-type', 'warning', 'Rule ''same-type'' failed on this project: too many files'
        FROM noted WHERE project LIKE '%3'""")
def project_rule_check(spark, sf_dir):
    """Files of a project with the type of an earlier one; some files and some projects break the rule."""

    def types(path, content):
        number = path.split("_")[1].split(".")[0]
        if int(number) % 50 == 0:
            raise ValueError(f"no part {number}")
        yield content.split('a = "')[1].split('"')[0]

    def finish(notes):
        first = {}
        for path, kind in notes:
            if first.setdefault(kind, path) != path:
                yield {"path": path, "line": 3, "message": f"Type also in {first[kind]}"}
        if path in last_paths:
            raise ValueError("too many files")

    files = made.families(spark, sf_dir, "dups")
    last = files.where("project LIKE '%3'").groupBy("project").agg(
        F.max(F.when(~F.col("path").rlike("(00|50)[.]py$"), F.col("path"))).alias("path")
    )
    last_paths = {r.path for r in last.collect()}  # a row for each of a few brands
    rule = project_rule("same-type", "quality", types, finish)
    issues = scan_issues(scan_facts(files, [rule]), [rule], files=files)
    return issues.select("project", "path", "checker", "severity", "message")


@check("c07_explained_issues", oracle.issues_cte() + f""", {oracle.CATALOG}, named AS (
    SELECT project, path, line, CASE WHEN severity = 'info' THEN 'house-rule' ELSE checker END AS checker, message FROM issues)
    SELECT project, path, line, named.checker, message, coalesce(rule_id, 'UNKNOWN') AS rule_id,
        coalesce(why, '') AS why, coalesce(fix, '') AS fix FROM named LEFT JOIN catalog USING (checker)""")
def explained_issues(spark, sf_dir):
    named = corpus_scan(spark, sf_dir).issues.withColumn(
        "checker", F.when(F.col("severity") == "info", "house-rule").otherwise(F.col("checker"))
    )
    return explain_issues(named).select("project", "path", "line", "checker", "message", "rule_id", "why", "fix")


@check("c07_rule_usage", oracle.issues_cte() + f""", {oracle.CATALOG}
    SELECT catalog.checker, catalog.rule_id, count(issues.path)::INT AS n FROM catalog LEFT JOIN issues
    ON issues.checker = catalog.checker GROUP BY ALL""")
def rule_usage(spark, sf_dir):
    counted = corpus_scan(spark, sf_dir).issues.groupBy("checker").agg(F.count("*").cast("int").alias("n"))
    return rule_catalog(spark).join(counted, "checker", "left").select(
        "checker", "rule_id", F.coalesce("n", F.lit(0)).alias("n")
    )


@check("c08_relative_paths", f"WITH {oracle.PART}, {oracle.ERRORS} SELECT 'tree' AS project, "
       "project || '/' || path AS path, 1 AS line FROM errors")
def relative_paths(spark, sf_dir):
    files = made.families(spark, sf_dir, "broken").selectExpr("concat(project, '/', path) AS path", "content")
    loaded = tree.load_tree(spark, files_on_disk.write_tree(files), project="tree")
    return code.parse_errors(code.extract_facts(loaded)).select("project", "path", "line")


@check("c09_rules_run", f"""WITH {oracle.PART}, {oracle.EVENTS}, {oracle.FILES}, {PROJECTS}
    SELECT project, CASE WHEN project IN (SELECT s_name FROM supplier) THEN '' ELSE '{",".join(oracle.PROFILES["web"])}' END
    AS checkers_run FROM projects""")
def rules_run(spark, sf_dir):
    found = report.report_heads(corpus_scan(spark, sf_dir), corpus_projects(spark, sf_dir))
    return found.select("project", F.array_join("checkers_run", ",").alias("checkers_run"))



_TRIAGE_FIELDS = ["project", "path", "line", "checker", "severity", "message"]
_TRIAGE = "SELECT project, path, line, checker, severity, message FROM issues "


def triage_query(change: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: change(corpus_scan(spark, sf_dir).issues).select(*_TRIAGE_FIELDS)


check("q01_by_category", oracle.issues_cte() + _TRIAGE + "WHERE category = 'security'")(
    triage_query(lambda issues: triage.by_category(issues, "security")))
check("q02_by_severity", oracle.issues_cte() + _TRIAGE + "WHERE severity = 'error'")(
    triage_query(lambda issues: triage.by_severity(issues, "error")))
check("q03_by_file", oracle.issues_cte() + _TRIAGE + "WHERE path = 'imports/part_11.py'")(
    triage_query(lambda issues: triage.by_file(issues, "imports/part_11.py")))
check("q04_search", oracle.issues_cte() + _TRIAGE + """WHERE contains(lower(message), 'md5')
    OR contains(lower(path), 'md5') OR contains(lower(checker), 'md5')""")(
    triage_query(lambda issues: triage.search(issues, "MD5")))
check("q04_search_plain_text", oracle.issues_cte() + _TRIAGE + """WHERE contains(lower(message), 'part_1')
    OR contains(lower(path), 'part_1') OR contains(lower(checker), 'part_1')""")(
    triage_query(lambda issues: triage.search(issues, "part_1")))


@check("q05_triage_order", oracle.issues_cte() + f"""SELECT * FROM (
    SELECT project, path, line, checker, severity, message, row_number() OVER (PARTITION BY project
        ORDER BY {oracle.RANK}, path, phase, rule_order, bfs, ord)::INT AS place FROM issues)""")
def triage_order(spark, sf_dir):
    placed = triage.triage_places(corpus_scan(spark, sf_dir).issues, ["project"])
    return placed.select(*_TRIAGE_FIELDS, F.col("place").cast("int").alias("place"))


@check("q05_locale_order", oracle.issues_cte() + f"""SELECT checker, severity, message, path, row_number() OVER (PARTITION BY checker
        ORDER BY {oracle.RANK}, path COLLATE en, phase, rule_order, bfs, ord, project, path)::INT AS place
    FROM (SELECT * REPLACE (CASE length(path) % 3 WHEN 0 THEN upper(path) WHEN 1 THEN replace(path, 'a', 'ä') ELSE path END AS path)
        FROM issues)""")
def locale_order(spark, sf_dir):
    """Paths with capitals and accents, numbered over all projects in the order of a locale."""
    size = F.length("path") % 3
    path = F.when(size == 0, F.upper("path")).when(size == 1, F.replace("path", F.lit("a"), F.lit("ä"))).otherwise(F.col("path"))
    issues = corpus_scan(spark, sf_dir).issues.withColumn("path", path)
    placed = triage.triage_places(issues, ["checker"], collation="UNICODE")
    return placed.select("checker", "severity", "message", "path", F.col("place").cast("int").alias("place"))


def _placed(issues: DataFrame, order: list) -> DataFrame:
    """Issues with their place in their project under ``order``, as the operator gives it."""
    keys = [c.alias(f"key_{i}") for i, c in enumerate(order)]
    ranked = numbered(issues.select("*", *keys), ["project"], [f"key_{i}" for i in range(len(order))], "place")
    return ranked.withColumn("place", F.col("place").cast("int"))



@check("q05_triage_top", oracle.issues_cte() + f"""SELECT project, path, line, checker, severity, message FROM issues
    WHERE category = 'security' ORDER BY {oracle.RANK}, path, phase, rule_order, bfs, ord, project LIMIT 100""")
def triage_top(spark, sf_dir):
    return triage.triage(corpus_scan(spark, sf_dir).issues, category="security", top=100).select(*_TRIAGE_FIELDS)


@check("q06_report_order", oracle.issues_cte() + """SELECT project, path, line, checker, row_number() OVER (
    PARTITION BY project ORDER BY CASE category WHEN 'security' THEN 0 ELSE 1 END, path, line, phase, rule_order, bfs, ord)::INT
    AS place FROM issues""")
def report_order(spark, sf_dir):
    return _placed(corpus_scan(spark, sf_dir).issues, report.report_order()).select(
        "project", "path", "line", "checker", "place"
    )


@check("q07_parse_error_view", f"WITH {oracle.PART}, {oracle.ERRORS} "
       "SELECT project, path, 'Cannot be parsed: invalid syntax, line 1' AS error, 1 AS line FROM errors")
def parse_error_view(spark, sf_dir):
    return corpus_scan(spark, sf_dir).parse_errors


for _level in ("critical", "error"):
    _limit = 0 if _level == "critical" else 1
    check(f"q08_gate_{_level}", oracle.issues_cte() + f""", {PROJECTS}, worst AS (
        SELECT project, min({oracle.RANK}) AS worst FROM issues GROUP BY project)
        SELECT project, coalesce(worst <= {_limit}, false) AS failed FROM projects LEFT JOIN worst USING (project)""")(
        lambda spark, sf_dir, level=_level: report.severity_gate(
            corpus_projects(spark, sf_dir), corpus_scan(spark, sf_dir).issues, level))
