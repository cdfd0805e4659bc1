"""Checks of roll-ups and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylint.checks import corpus as made
from quarrylint.checks import files_on_disk, oracle
from quarrylint.checks.base import PROJECTS, Query, check, corpus_projects, corpus_scan
from quarrylint.functions.staging import numbered, shared_folder
from quarrylint.plans import history, report
from quarrylint.plans.scan import scan
from quarrylint.sources import archives


@check("a01_summary", oracle.issues_cte() + f"SELECT project, {oracle.SUMMARY} FROM issues GROUP BY project")
def summary(spark, sf_dir):
    return report.summary(corpus_scan(spark, sf_dir).issues)


@check("a02_sub_scores", oracle.issues_cte() + f", {oracle.SCORES} SELECT project, security, quality, complexity FROM sub")
def sub_scores(spark, sf_dir):
    return report.sub_scores(corpus_scan(spark, sf_dir).issues)


@check("a03_overall_score", oracle.issues_cte() + f", {oracle.SCORES} SELECT project, {oracle.OVERALL} AS overall FROM sub")
def overall_score(spark, sf_dir):
    return report.scores(corpus_scan(spark, sf_dir).issues).select("project", "overall")


# Scores per file rather than per project, so that all bands occur.
@check("a04_health_band", oracle.issues_cte() + f""", {oracle.SCORES.replace('SELECT project,', "SELECT project || '/' || path AS project,")
    .replace('GROUP BY project', 'GROUP BY ALL')}
    SELECT project, {oracle.OVERALL} AS overall, {oracle.band(oracle.OVERALL)} AS band FROM sub""")
def health_band(spark, sf_dir):
    per_file = corpus_scan(spark, sf_dir).issues.withColumn("project", F.concat("project", F.lit("/"), "path"))
    return report.scores(per_file).select("project", "overall", "band")


@check("a05_file_breakdown", oracle.issues_cte() + """SELECT project, path, count(checker)::INT AS total,
    count(*) FILTER (category = 'security')::INT AS security, count(*) FILTER (category = 'quality')::INT AS quality,
    count(*) FILTER (severity = 'critical')::INT AS critical
    FROM files LEFT JOIN issues USING (project, path) GROUP BY project, path""")
def file_breakdown(spark, sf_dir):
    done = corpus_scan(spark, sf_dir)
    return report.file_breakdown(done.facts, done.issues)


@check("a05_breakdown_order", oracle.issues_cte() + """SELECT project, path, row_number() OVER (PARTITION BY project
        ORDER BY count(checker) DESC, path)::INT AS place
    FROM files LEFT JOIN issues USING (project, path) GROUP BY project, path""")
def breakdown_order(spark, sf_dir):
    done = corpus_scan(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("project").orderBy(*report.breakdown_order()))
    return report.file_breakdown(done.facts, done.issues).select("project", "path", place.alias("place"))


@check("a06_coverage", f"""WITH {oracle.PART}, {oracle.EVENTS}, {oracle.FILES}, {oracle.ERRORS}
    SELECT project, count(*)::INT AS files_scanned, count(errors.path)::INT AS files_with_errors,
        (count(*) - count(errors.path))::INT AS files_analyzed FROM files LEFT JOIN errors USING (project, path) GROUP BY project""")
def coverage(spark, sf_dir):
    done = corpus_scan(spark, sf_dir)
    return report.coverage(done.facts, done.parse_errors)


FLAGGED = """, flagged AS (SELECT project, path, row_number() OVER (PARTITION BY project
    ORDER BY min({phase: phase, path: path, rule_order: rule_order, bfs: bfs, ord: ord})) AS rank
    FROM issues GROUP BY project, path)"""


@check("a07_flagged_files", oracle.issues_cte() + FLAGGED + " SELECT project, path, rank::INT AS rank FROM flagged")
def flagged_files(spark, sf_dir):
    return report.flagged_files(corpus_scan(spark, sf_dir).issues)


LONG_TEXT = """'def long_one():' || chr(10) || '    x = ' || k || chr(10) || repeat('    pass' || chr(10), 3 * s)
    || '    return x' || chr(10) || 'class Big:' || chr(10) || repeat('    a = 0' || chr(10), 8 * s)"""
LONG_RULES = ["long-function", "large-class", "long-file"]
LONG_SOURCES = oracle.issues_cte(LONG_RULES) + FLAGGED.replace("FROM issues", "FROM issues WHERE path LIKE 'long/%'") + f""", texts AS (SELECT flagged.project, path, rank, {LONG_TEXT} AS text
    FROM flagged JOIN part_rows ON flagged.project = part_rows.project AND path = 'long/part_' || k || '.py')"""


def _long_scan(spark, sf_dir):
    return scan(made.families(spark, sf_dir, "long"), profile=LONG_RULES)


@check("a07_flagged_sources", oracle.issues_cte() + FLAGGED + f""", {oracle.TEXTS}
    SELECT project, path, rank::INT AS rank, md5(text) AS source_md5 FROM flagged JOIN texts USING (project, path)""")
def flagged_sources(spark, sf_dir):
    done = corpus_scan(spark, sf_dir)
    found = report.flagged_sources(done.files, done.issues)
    return found.select("project", "path", "rank", F.md5("source").alias("source_md5"))


@check("a08_annotated_source", oracle.issues_cte(["long-function", "large-class", "long-file"]) + f""", {oracle.CATALOG},
    sources AS (SELECT DISTINCT issues.project, issues.path, s FROM issues JOIN part_rows ON issues.project = part_rows.project
        AND issues.path = 'long/part_' || k || '.py'),
    all_lines AS (SELECT project, path, unnest(range(1, 11 * s + 6))::INT AS line_no FROM sources),
    marks AS (SELECT project, path, line AS line_no, checker, message, fix FROM issues JOIN catalog USING (checker))
    SELECT all_lines.project, all_lines.path, all_lines.line_no, checker, message, fix, message IS NOT NULL AS flagged
    FROM all_lines LEFT JOIN marks USING (project, path, line_no)""")
def annotated_source(spark, sf_dir):
    done = _long_scan(spark, sf_dir)
    sources = report.flagged_sources(done.files, done.issues)
    return report.annotated_source(sources, done.issues).select(
        "project", "path", "line_no", "checker", "message", "fix", "flagged"
    )


@check("a08_excerpts", f"""WITH {oracle.PART}, sources AS (SELECT *, 'nest/part_' || k || '.py' AS path, 1 + s % 7 AS n
        FROM part_rows WHERE 1 + s % 7 > 4),
    near AS (SELECT *, unnest([4, 5, 6, 7, 8]) AS line_no FROM sources)
    SELECT project, path, line_no::INT AS line_no, 'deep-nesting' AS checker, 6 AS line, line_no = 6 AS flagged,
        CASE WHEN line_no <= n + 1 THEN repeat('    ', line_no - 1) || 'if x > ' || (line_no - 1) || ':'
        WHEN line_no = n + 2 THEN repeat('    ', n + 1) || 'return x + ' || k ELSE '' END AS text
    FROM near WHERE line_no <= n + 3""")
def excerpts(spark, sf_dir):
    done = scan(made.families(spark, sf_dir, "nest"), profile=["deep-nesting"])
    sources = report.flagged_sources(done.files, done.issues)
    return report.excerpts(sources, done.issues, context=2).select(
        "project", "path", "line_no", "checker", "line", "flagged", "text"
    )


OVERVIEW = oracle.issues_cte() + f""", {PROJECTS}, {oracle.SCORES},
    counts AS (SELECT project, {oracle.SUMMARY} FROM issues GROUP BY project),
    covered AS (SELECT project, count(*)::INT AS files_scanned, count(errors.path)::INT AS files_with_errors
        FROM files LEFT JOIN errors USING (project, path) GROUP BY project),
    overview AS (SELECT project, coalesce(files_scanned, 0)::INT AS files_scanned,
        coalesce(files_with_errors, 0)::INT AS files_with_errors,
        (coalesce(files_scanned, 0) - coalesce(files_with_errors, 0))::INT AS files_analyzed,
        coalesce(total, 0) AS total, coalesce(counts.quality, 0) AS quality, coalesce(counts.security, 0) AS security,
        coalesce(critical, 0) AS critical, coalesce(error, 0) AS error, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info,
        coalesce(sub.security, 100) AS score_security, coalesce(sub.quality, 100) AS score_quality,
        coalesce(sub.complexity, 100) AS score_complexity
        FROM projects LEFT JOIN covered USING (project) LEFT JOIN counts USING (project) LEFT JOIN sub USING (project)),
    whole AS (SELECT *, round((score_security + score_quality + score_complexity) / 3.0)::INT AS score_overall FROM overview)"""


@check("a09_project_overview", OVERVIEW + f""" SELECT *, {oracle.band('score_overall')} AS band,
    CASE WHEN files_scanned = 0 THEN '{report.NO_FILES_NOTE}' END AS note FROM whole""")
def project_overview(spark, sf_dir):
    done = corpus_scan(spark, sf_dir)
    return report.project_overview(corpus_projects(spark, sf_dir), done.issues, done.facts, done.parse_errors)


@check("a10_project_report", OVERVIEW + f""", flagged AS (SELECT project, count(DISTINCT path)::INT AS n_sources
        FROM issues GROUP BY project)
    SELECT project, total, score_overall AS overall, files_scanned, files_analyzed, total AS n_issues,
        files_with_errors AS n_errors, files_scanned AS n_files, coalesce(n_sources, 0) AS n_sources,
        greatest(1, ceil(greatest(total, files_scanned) / 50.0))::INT AS parts
    FROM whole LEFT JOIN flagged USING (project)""")
def project_report(spark, sf_dir):
    done = corpus_scan(spark, sf_dir)
    parts = report.project_report(done, corpus_projects(spark, sf_dir), part_rows=50)
    lists = {"n_issues": "issues", "n_errors": "parse_errors", "n_files": "files_list"}
    return parts.groupBy("project").agg(
        F.max("summary.total").alias("total"), F.max("score.overall").alias("overall"),
        F.max("files_scanned").alias("files_scanned"), F.max("files_analyzed").alias("files_analyzed"),
        *[F.sum(F.size(c)).cast("int").alias(name) for name, c in lists.items()],
        F.sum(F.size("sources")).cast("int").alias("n_sources"),
        F.max("parts").alias("parts"),
    )


_DEALT = """ SELECT project, floor(coalesce(sum(strlen(text)) OVER (PARTITION BY project ORDER BY rank
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {bytes})::INT AS part, path, md5(text) AS source_md5
    FROM (SELECT * REPLACE ({text} AS text) FROM texts WHERE rank <= {sources})"""


def _report_sources(**limits) -> Query:
    def found(spark, sf_dir):
        whole = report.project_report(_long_scan(spark, sf_dir), **limits)
        return whole.select("project", "part", F.explode("sources").alias("path", "text")).select(
            "project", "part", "path", F.md5("text").alias("source_md5")
        )

    return found


check("a10_report_sources", LONG_SOURCES + _DEALT.format(bytes=9000, text="text", sources=1_000_000_000))(
    _report_sources(part_bytes=9000))
check("a10_limited_sources", LONG_SOURCES + _DEALT.format(bytes=1000, text="left(text, 250)", sources=6))(
    _report_sources(max_sources=6, max_chars=250, part_bytes=1000))


@check("a10_report_issues", oracle.issues_cte() + f""", {oracle.CATALOG}, ranked AS (SELECT *, row_number() OVER (
        PARTITION BY project ORDER BY phase, path, rule_order, bfs, ord) - 1 AS place FROM issues)
    SELECT project, (place // 50)::INT AS part, (place % 50)::INT AS pos, ranked.rule_id, path AS file, line, message, why, fix
    FROM ranked JOIN catalog USING (checker)""")
def report_issues(spark, sf_dir):
    parts = report.project_report(corpus_scan(spark, sf_dir), part_rows=50, with_sources=False)
    return parts.select("project", "part", F.posexplode("issues").alias("pos", "i")).select(
        "project", "part", "pos", "i.rule_id", "i.file", "i.line", "i.message", "i.why", "i.fix"
    )


STATES = f"""WITH {oracle.PART}, states AS (SELECT 'part_' || k || '.zip' AS project, k,
    CASE WHEN s % 5 = 0 AND s % 11 <> 2 OR s % 7 = 3 THEN 'rejected' WHEN s % 6 = 1 THEN 'failed' WHEN s % 11 = 2 THEN 'empty' ELSE 'ok'
        END AS status,
    CASE WHEN s % 5 = 0 AND s % 11 <> 2 THEN 'Entry leaves the archive root: ../evil.py'
        WHEN s % 7 = 3 THEN 'Damaged entry in zip: notes.txt' WHEN s % 6 = 1 THEN 'Scan stopped at part ' || k END AS error,
    CASE WHEN s % 5 = 0 OR s % 7 = 3 OR s % 11 = 2 THEN 0 ELSE 3 END AS files_scanned FROM part_rows)"""


def _uploads(spark, sf_dir):
    """Archives of parts, and a crash for some of them."""
    uploads = archives.open_archives(spark, files_on_disk.write_archives(spark, sf_dir))
    crashes = made.table(spark, sf_dir, "part").where("p_size % 6 = 1").selectExpr(
        "concat('part_', p_partkey, '.zip') AS project", "concat('Scan stopped at part ', p_partkey) AS error"
    )
    return uploads, archives.scan_states(uploads, crashes)


@check("a11_scan_states", STATES + " SELECT project, status, error, files_scanned FROM states")
def scan_states(spark, sf_dir):
    return _uploads(spark, sf_dir)[1]


@check("a11_failed_scans", STATES + """ SELECT project, status, error, files_scanned,
    CASE WHEN files_scanned = 3 THEN 'b/c.py,src/__init__.py,src/a.py' ELSE '' END AS files_list
    FROM states WHERE status IN ('rejected', 'failed')""")
def failed_scans(spark, sf_dir):
    uploads, states = _uploads(spark, sf_dir)
    rows = archives.failed_scans(states, uploads.found())
    return rows.withColumn("files_list", F.array_join("files_list", ",")).drop("part")


@check("k01_json_reports", OVERVIEW + """, firsts AS (SELECT project, min_by(path || ':' || message,
        {phase: phase, path: path, rule_order: rule_order, bfs: bfs, ord: ord}) AS first_issue FROM issues GROUP BY project)
    SELECT project, total::VARCHAR AS total, critical::VARCHAR AS critical, total AS n_issues, files_with_errors AS n_errors,
        first_issue FROM whole LEFT JOIN firsts USING (project)""")
def json_reports(spark, sf_dir):
    whole = report.project_report(
        corpus_scan(spark, sf_dir), corpus_projects(spark, sf_dir), part_rows=50, with_sources=False
    )
    documents = report.json_reports(whole)
    field = lambda path: F.get_json_object("document", path)
    first = F.concat(field("$.issues[0].file"), F.lit(":"), field("$.issues[0].message"))
    # Every part has the summary; lists go on from part to part.
    return documents.groupBy(
        "project", field("$.summary.total").alias("total"), field("$.summary.critical").alias("critical")
    ).agg(
        F.sum(F.json_array_length(field("$.issues"))).cast("int").alias("n_issues"),
        F.sum(F.json_array_length(field("$.parse_errors"))).cast("int").alias("n_errors"),
        F.max(F.when(F.col("part") == 0, first)).alias("first_issue"),
    )


@check("k02_text_report", OVERVIEW + """,
    entries AS (SELECT project, CASE category WHEN 'security' THEN 0 ELSE 1 END AS section, 1 AS kind, path, line,
        phase, rule_order, bfs, ord,
        '  ' || path || ':' || line || '  [' || upper(severity) || '] (' || checker || ') ' || message AS text FROM issues
        UNION ALL SELECT project, 2, 1, path, 0, 0, 0, 0, 0, '  ' || path || ': Cannot be parsed: invalid syntax, line 1' FROM errors),
    shown AS (SELECT project, unnest([0, 1, 2, 3]) AS section, unnest(['SECURITY', 'CODE QUALITY', 'PARSE ERRORS', 'SUMMARY']) AS title,
        unnest([security > 0, quality > 0, files_with_errors > 0, true]) AS wanted FROM whole),
    all_lines AS (SELECT * FROM entries
        UNION ALL SELECT project, section, 0, '', 0, 0, 0, 0, 0, title FROM shown WHERE wanted
        UNION ALL SELECT project, section, 2, '', 0, 0, 0, 0, 0, '' FROM shown WHERE wanted AND section < 3
        UNION ALL SELECT project, 3, 1, '', 0, 0, 0, 0, 0, '  ' || total || ' issues (' || security || ' security, ' || quality
            || ' quality); ' || files_with_errors || ' file(s) failed to parse.' FROM whole
        UNION ALL SELECT project, 3, 2, '', 0, 0, 0, 0, 0, '  ' || critical || ' CRITICAL findings: review these first.'
            FROM whole WHERE critical > 0)
    SELECT project, text, row_number() OVER (PARTITION BY project
        ORDER BY section, kind, path, line, phase, rule_order, bfs, ord)::INT AS line_no FROM all_lines""")
def text_report(spark, sf_dir):
    done = corpus_scan(spark, sf_dir)
    overview = report.project_overview(corpus_projects(spark, sf_dir), done.issues, done.facts, done.parse_errors)
    rows = report.text_report(done.issues, done.parse_errors, overview)
    placed = numbered(rows, ["project"], report.TEXT_ORDER[1:], "line_no")
    return placed.select("project", "text", F.col("line_no").cast("int").alias("line_no"))


HISTORY = OVERVIEW + """, runs AS (SELECT project, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * files_scanned AS scanned_at,
        score_overall AS overall, total, security, quality FROM whole)"""


def _overview(spark, sf_dir) -> DataFrame:
    done = corpus_scan(spark, sf_dir)
    return report.project_overview(corpus_projects(spark, sf_dir), done.issues, done.facts, done.parse_errors)


def _history(spark, sf_dir) -> str:
    """A table to which one scan was added twice, as by a job that ran again, and half of it as another scan."""
    scanned_at = F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("files_scanned"))  # from 2024-01-01 UTC on
    rows = history.history_rows(_overview(spark, sf_dir), scanned_at)
    target = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    even = F.length("project") % 2 == 0
    history.append_history(rows, target, "one")
    history.append_history(rows.where(even), target, "one")
    history.append_history(rows.where(~even), target, "two")
    return target


@check("k03_scan_history", HISTORY + """ SELECT project, epoch(scanned_at)::BIGINT AS scanned_at, overall, total,
    security, quality FROM runs ORDER BY scanned_at DESC, project LIMIT 20""")
def scan_history(spark, sf_dir):
    return history.newest(history.read_history(spark, _history(spark, sf_dir))).withColumn("scanned_at", F.unix_timestamp("scanned_at"))


@check("k03_compacted_history", HISTORY + """ SELECT project, epoch(scanned_at)::BIGINT AS scanned_at, overall, total,
    security, quality FROM runs ORDER BY scanned_at DESC, project LIMIT 20""")
def compacted_history(spark, sf_dir):
    """All that is left in the table after two compactions."""
    table = _history(spark, sf_dir)
    history.compact_history(spark, table)
    history.compact_history(spark, table)
    return history.read_history(spark, table).withColumn("scanned_at", F.unix_timestamp("scanned_at"))


@check("k03_time_of_scan", OVERVIEW + " SELECT project, total, true AS just_now FROM whole")
def time_of_scan(spark, sf_dir):
    rows = history.history_rows(_overview(spark, sf_dir))
    now = F.abs(F.unix_timestamp("scanned_at") - F.unix_timestamp()) < 86400
    return rows.select("project", "total", now.alias("just_now"))


@check("k04_history_view", HISTORY + """ SELECT project, epoch(scanned_at)::BIGINT AS scanned_at, overall || '/100' AS score,
    total || CASE WHEN total = 1 THEN ' issue (' ELSE ' issues (' END || security || ' security, ' || quality || ' quality)' AS counts
    FROM runs ORDER BY scanned_at DESC, project LIMIT 20""")
def history_view(spark, sf_dir):
    return history.history_view(history.read_history(spark, _history(spark, sf_dir))).withColumn("scanned_at", F.unix_timestamp("scanned_at"))
