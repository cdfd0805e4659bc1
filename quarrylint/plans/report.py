"""Roll-ups and reports over the issue table. Every table is keyed by project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylint.functions.staging import numbered, running_total, stage, work_partitions
from quarrylint.operators.catalog import SEVERITIES, explanation_maps, penalty
from quarrylint.operators.findings import ISSUE_ORDER
from quarrylint.plans.scan import Scan

# Band limits.
BANDS = ((85, "Great health"), (60, "Needs attention"), (0, "At risk"))

NO_FILES_NOTE = "Nothing to scan: the project has no Python files."
SUMMARY_COLUMNS = ("total", "quality", "security", "critical", "error", "warning", "info")
SCORE_COLUMNS = ("overall", "security", "quality", "complexity")

GATHERED_BYTES = 16 << 20  # sources that a task gathers into maps
ENTRY_BYTES = 128  # what an entry takes in memory beside its text


def _security() -> Column:
    return F.col("category") == "security"


def _quality() -> Column:
    return F.col("category") == "quality"


def _complexity() -> Column:
    return F.col("checker") == "complexity"


def _counts() -> list[Column]:
    columns = [
        F.count("*").alias("total"),
        F.count_if(_quality()).alias("quality"),
        F.count_if(_security()).alias("security"),
    ]
    columns += [F.count_if(F.col("severity") == s).alias(s) for s in SUMMARY_COLUMNS[3:]]
    return columns


def summary(issues: DataFrame) -> DataFrame:
    """Issue counts per project, by category and severity."""
    counted = issues.groupBy("project").agg(*_counts())
    return counted.select("project", *[F.col(c).cast("int").alias(c) for c in SUMMARY_COLUMNS])


def _sub_score(test: Column) -> Column:
    lost = F.coalesce(F.sum(F.when(test, penalty(F.col("severity")))), F.lit(0))
    return F.greatest(F.lit(0), 100 - lost).cast("int")


def sub_scores(issues: DataFrame) -> DataFrame:
    """100 minus penalties, not below 0, for security, quality without complexity, complexity."""
    return issues.groupBy("project").agg(
        _sub_score(_security()).alias("security"),
        _sub_score(_quality() & ~_complexity()).alias("quality"),
        _sub_score(_complexity()).alias("complexity"),
    )


def overall(security: Column, quality: Column, complexity: Column) -> Column:
    return F.round((security + quality + complexity) / 3).cast("int")


def health_band(score: Column) -> Column:
    band = F.lit(BANDS[-1][1])
    for limit, text in reversed(BANDS[:-1]):
        band = F.when(score >= limit, text).otherwise(band)
    return band


def scores(issues: DataFrame) -> DataFrame:
    """Sub-scores, overall score and health band per project that has issues."""
    total = overall(F.col("security"), F.col("quality"), F.col("complexity"))
    return sub_scores(issues).withColumn("overall", total).withColumn("band", health_band(F.col("overall")))


def _by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that no task and no driver holds as a whole.

    Sizes of compressed or generated text are estimated far too low, by which Spark would broadcast it.
    """
    return df.hint("merge")


def coverage(files: DataFrame, parse_errors: DataFrame) -> DataFrame:
    """Files scanned, analyzed and with errors per project."""
    scanned = files.select("project", F.lit(0).alias("bad"))
    failed = parse_errors.select("project", F.lit(1).alias("bad"))
    # One aggregate over both, instead of two and a join; errors are no extra files.
    return (
        scanned.unionByName(failed)
        .groupBy("project")
        .agg(
            F.count_if(F.col("bad") == 0).cast("int").alias("files_scanned"),
            F.count_if(F.col("bad") == 1).cast("int").alias("files_with_errors"),
        )
        .withColumn("files_analyzed", F.col("files_scanned") - F.col("files_with_errors"))
    )


def project_overview(projects: DataFrame, issues: DataFrame, files: DataFrame, parse_errors: DataFrame) -> DataFrame:
    """One flat row per project, also for projects without files or issues (scores 100, counts 0)."""
    lost = {
        "lost_security": _security(),
        "lost_quality": _quality() & ~_complexity(),
        "lost_complexity": _complexity(),
    }
    points = [
        F.sum(F.when(test, penalty(F.col("severity"))).otherwise(0)).alias(name) for name, test in lost.items()
    ]
    rolled = issues.groupBy("project").agg(*_counts(), *points)
    joined = (
        projects.select("project")
        .join(coverage(files, parse_errors), "project", "left")
        .join(rolled, "project", "left")
    )
    count = lambda name: F.coalesce(name, F.lit(0)).cast("int")
    score = lambda name: F.greatest(F.lit(0), 100 - count(name))
    sub = [score(name) for name in lost]
    return joined.select(
        "project",
        *[count(c).alias(c) for c in ("files_scanned", "files_analyzed", "files_with_errors")],
        *[count(c).alias(c) for c in SUMMARY_COLUMNS],
        *[s.alias(f"score_{name[5:]}") for s, name in zip(sub, lost)],
        overall(*sub).alias("score_overall"),
        health_band(overall(*sub)).alias("band"),
        F.when(count("files_scanned") == 0, NO_FILES_NOTE).alias("note"),
    )


def file_breakdown(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue counts of every discovered file, zeros included."""
    counted = issues.groupBy("project", "path").agg(
        F.count("*").alias("total"),
        F.count_if(_security()).alias("security"),
        F.count_if(_quality()).alias("quality"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
    )
    columns = ("total", "security", "quality", "critical")
    return files.select("project", "path").join(_by_shuffle(counted), ["project", "path"], "left").select(
        "project", "path", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in columns]
    )


def breakdown_order() -> list[Column]:
    """Per project, most issues first; equal counts stay in path order."""
    return [F.asc("project"), F.desc("total"), F.asc("path")]


def severity_gate(projects: DataFrame, issues: DataFrame, fail_on: str) -> DataFrame:
    """Whether a project has an issue at or above ``fail_on``."""
    limit = SEVERITIES.index(fail_on)
    worst = issues.groupBy("project").agg(F.min("severity_rank").alias("worst"))
    return projects.select("project").join(worst, "project", "left").select(
        "project", F.coalesce(F.col("worst") <= limit, F.lit(False)).alias("failed")
    )


def flagged_files(issues: DataFrame, max_files: int | None = None, folder: str | None = None) -> DataFrame:
    """The files with an issue per project, in issue order, with their rank; the first ``max_files`` if given.

    A limit is applied map side where it is small (window group limit). Without one, ranks come from
    sorted partitions, so no task holds a project.
    """
    first = issues.groupBy("project", "path").agg(F.min(F.struct(*ISSUE_ORDER)).alias("first"))
    if max_files is None:
        return numbered(first, ["project"], ["first", "path"], "rank", folder).select(
            "project", "path", F.col("rank").cast("int").alias("rank")
        )
    by_first = Window.partitionBy("project").orderBy("first", "path")
    return (
        first.withColumn("rank", F.row_number().over(by_first))
        .filter(F.col("rank") <= max_files)
        .select("project", "path", "rank")
    )


def flagged_sources(
    files: DataFrame, issues: DataFrame, max_files: int | None = None, max_chars: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Text of the flagged files, each cut to ``max_chars`` characters, if given, before any shuffle."""
    return _by_shuffle(_cut_texts(files, max_chars)).join(flagged_files(issues, max_files, folder), ["project", "path"])


def _cut_texts(files: DataFrame, max_chars: int | None) -> DataFrame:
    text = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    return files.filter("content IS NOT NULL").select("project", "path", text.alias("source"))


def _marked_lines(sources: DataFrame, issues: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each source as its lines, with the issues that point at one of them, sorted by line.

    The marks of a file are one array and meet its text in one row, so no line is ever shuffled.
    """
    order = [c for c in ISSUE_ORDER if c != "path"]
    mark = F.struct("line", *order, *fields)
    marks = issues.groupBy("project", "path").agg(F.array_sort(F.collect_list(mark)).alias("marks"))
    split = sources.join(_by_shuffle(marks), ["project", "path"], "left").select(
        "project", "path", F.split("source", "\n", -1).alias("lines"), "marks"
    )
    inside = F.filter("marks", lambda m: (m["line"] > 0) & (m["line"] <= F.size("lines")))
    kind = split.schema["marks"].dataType
    return split.select("project", "path", "lines", F.coalesce(inside, F.array().cast(kind)).alias("marks"))


def annotated_source(sources: DataFrame, issues: DataFrame) -> DataFrame:
    """Every line of the sources, split at ``\\n`` only, with the issues that point at it.

    A line with several issues gives one row for each; a line without any gives one row. Issues
    at line 0 or beyond the cut mark nothing.
    """
    marked = _marked_lines(sources, issues, ("severity", "checker", "message"))
    none = F.lit(None).cast(marked.schema["marks"].dataType.elementType)
    row = lambda line, mark: F.struct(
        line.alias("line_no"), F.get("lines", line - 1).alias("text"), mark.alias("mark")
    )
    flagged = F.transform("marks", lambda m: row(m["line"], m))
    bare = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.transform("marks", lambda m: m["line"]))
    rows = marked.select("project", "path", F.inline(F.concat(flagged, F.transform(bare, lambda line: row(line, none)))))
    _, fix = explanation_maps()
    known = F.when(F.col("mark").isNotNull(), F.coalesce(fix[F.col("mark.checker")], F.lit("")))
    return rows.select("project", "path", "line_no", "text", "mark.*", known.alias("fix")).drop("line").withColumn(
        "flagged", F.col("message").isNotNull()
    )


def excerpts(sources: DataFrame, issues: DataFrame, context: int = 2) -> DataFrame:
    """Per issue its line and ``context`` lines around it, as far as the source has them."""
    around = lambda m: F.sequence(
        F.greatest(F.lit(1), m["line"] - context), F.least(F.size("lines"), m["line"] + context)
    )
    row = lambda line, mark: F.struct(
        line.alias("line_no"), F.get("lines", line - 1).alias("text"), mark.alias("mark")
    )
    marked = _marked_lines(sources, issues, ("checker",))
    rows = F.flatten(F.transform("marks", lambda m: F.transform(around(m), lambda line: row(line, m))))
    return marked.select("project", "path", F.inline(rows)).select("project", "path", "line_no", "text", "mark.*").withColumn(
        "flagged", F.col("line_no") == F.col("line")
    )


def source_parts(
    files: DataFrame, issues: DataFrame, max_sources: int | None = None, max_chars: int | None = None,
    part_bytes: int = 16 << 20, folder: str | None = None,
) -> DataFrame:
    """(project, part, sources): the flagged sources of a project as maps, dealt in issue order by running bytes.

    No map holds more than ``part_bytes`` and one source, however many sources a project has. Only lengths are
    put in order; texts are shuffled to their file's marks and to their part.
    """
    dealt, places = _dealt_sources(files, issues, max_sources, max_chars, part_bytes, folder)
    return _gathered(dealt, _gathering_tasks(places))


def _dealt_sources(
    files: DataFrame, issues: DataFrame, max_sources: int | None, max_chars: int | None, part_bytes: int,
    folder: str | None,
) -> tuple[DataFrame, DataFrame]:
    """(project, part, path, bytes, source) of the flagged files, one a row, and the same without the source."""
    keys = ["project", "path"]
    texts, ranks = _cut_texts(files, max_chars), flagged_files(issues, max_sources, folder)
    lengths = texts.select(*keys, F.octet_length("source").cast("bigint").alias("bytes"))
    sized = _by_shuffle(lengths).join(ranks, keys)
    places = running_total(sized, ["project"], ["rank"], "bytes", "before", folder).select(
        *keys, F.floor(F.col("before") / part_bytes).cast("int").alias("part"), "bytes"
    )
    flagged = _by_shuffle(texts).join(ranks, keys)
    dealt = flagged.join(_by_shuffle(places), keys).select("project", "part", "path", "bytes", "source")
    return dealt, places


def _gathering_tasks(places: DataFrame) -> int:
    """Number of tasks that gather sources, so that each gets about ``GATHERED_BYTES`` of them.

    Given as a number, because adaptive execution merges partitions by their compressed bytes, and a gathering
    aggregate has up to 128 maps in memory. With fewer tasks than other shuffles, joins would shuffle the maps.
    """
    held = F.col("bytes") + F.octet_length("path") + ENTRY_BYTES
    total = places.agg(F.sum(held)).first()[0] or 0
    return max(work_partitions(places.sparkSession), -(-total // GATHERED_BYTES))


def _gathered(dealt: DataFrame, tasks: int) -> DataFrame:
    """(project, part, sources), partitioned as the report is joined, so that no map is shuffled."""
    entry = F.struct("path", "source")
    return dealt.repartition(tasks, "project", "part").groupBy("project", "part").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("sources")
    )


def _error_text() -> Column:
    return F.concat("path", F.lit(": "), "error")


def report_heads(scan: Scan, projects: DataFrame | None = None) -> DataFrame:
    """What every part of a report has: summary, score, coverage and the rules that ran, one row per project."""
    # The staged facts list the files; the source table is read for the flagged texts only.
    projects = scan.facts.select("project").distinct() if projects is None else projects
    rules = F.array(*[F.lit(rule) for rule in scan.rules])
    return project_overview(projects, scan.issues, scan.facts, scan.parse_errors).select(
        "project",
        F.struct(*SUMMARY_COLUMNS).alias("summary"),
        F.struct(*[F.col(f"score_{c}").alias(c) for c in SCORE_COLUMNS]).alias("score"),
        "band", "files_scanned", "files_analyzed", "files_with_errors",
        F.when(F.col("files_scanned") > 0, rules).otherwise(F.array().cast("array<string>")).alias("checkers_run"),
        "note",
    )


def project_report(
    scan: Scan, projects: DataFrame | None = None, part_rows: int = 5000,
    max_sources: int | None = None, max_chars: int | None = None, part_bytes: int = 16 << 20,
    with_sources: bool = True,
) -> DataFrame:
    """The full nested report: summary, score, coverage, issues, errors, file list, sources.

    A project is one row, part 0, unless one of its lists is longer than ``part_rows`` or its sources
    have more than ``part_bytes``: then lists and sources go on in parts 1, 2, …, so no row and no
    task ever holds an unbounded project. Every part has the counts, scores, summary and the
    number of parts. How many sources, and how much of each, are arguments; None stands for all.
    Reports that show no source do without them: no text is read, and only lists make parts.
    """
    head = report_heads(scan, projects)
    longest = F.greatest("summary.total", "files_scanned", "files_with_errors")
    parts = F.greatest(F.lit(1), F.ceil(longest / part_rows))
    no_sources = F.create_map().cast("map<string,string>")
    tasks = None
    if with_sources:
        # Staged one source a row: a Parquet page of maps gets a hundred of them before its size is looked at.
        dealt, _ = _dealt_sources(scan.files, scan.issues, max_sources, max_chars, part_bytes, scan.folder)
        dealt = stage(dealt, "report-sources", scan.folder)
        tasks = _gathering_tasks(dealt)
        sources = _gathered(dealt, tasks)
        most = dealt.groupBy("project").agg((F.max("part") + 1).alias("source_parts"))
        head = head.join(most, "project", "left")
        parts = F.greatest(parts, "source_parts")
    fields = [c for c in head.columns if c not in ("project", "source_parts")]
    head = head.select("project", parts.cast("int").alias("parts"), *fields)
    lists = _report_lists(scan, part_rows, tasks)
    # Everything meets on (project, part), so the parts of a huge project stay spread out.
    whole = head.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    whole = whole.select("project", "part", "parts", *fields)
    if with_sources:
        whole = whole.join(_by_shuffle(sources), ["project", "part"], "left")
    else:
        whole = whole.withColumn("sources", no_sources)
    whole = whole.join(_by_shuffle(lists), ["project", "part"], "left")
    kinds = {f.name: f.dataType for f in lists.schema if f.name not in ("project", "part")}
    lists = {name: F.coalesce(name, F.array().cast(kind)) for name, kind in kinds.items()}
    return whole.withColumns({**lists, "sources": F.coalesce("sources", no_sources)})


def _report_lists(scan: Scan, part_rows: int, tasks: int | None = None) -> DataFrame:
    """issues, parse_errors and files_list cut into parts: one row per (project, part), in ``tasks`` partitions if given."""
    order = [c for c in ISSUE_ORDER if c != "path"]
    issue = F.struct(
        "rule_id", "checker", "category", "severity", F.col("path").alias("file"), "line", "message",
        "snippet", "column",
    )
    issues = scan.issues.select(
        "project", F.lit("issues").alias("section"), "path", *order, issue.alias("issue"),
        F.lit(None).cast("string").alias("error"),
    )
    none = issues.schema["issue"].dataType
    plain = lambda df, section, error: df.select(
        "project", F.lit(section).alias("section"), "path", *[F.lit(0).alias(c) for c in order],
        F.lit(None).cast(none).alias("issue"), error.cast("string").alias("error"),
    )
    items = issues.unionByName(plain(scan.parse_errors, "parse_errors", _error_text())).unionByName(
        plain(scan.facts, "files_list", F.lit(None))
    )
    ranked = numbered(items, ["project", "section"], ISSUE_ORDER, folder=scan.folder)
    ranked = ranked.withColumn("part", F.floor((F.col("seq") - 1) / part_rows).cast("int"))
    if tasks is not None:
        ranked = ranked.repartition(tasks, "project", "part")
    # At most part_rows rows of each section meet in one group.
    of = lambda section, value: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("seq", value)))),
        lambda row: row["value"],
    )
    lists = ranked.groupBy("project", "part").agg(
        of("issues", F.col("issue").alias("value")).alias("issues"),
        of("parse_errors", F.col("error").alias("value")).alias("parse_errors"),
        of("files_list", F.col("path").alias("value")).alias("files_list"),
    )
    # Reasons and remedies are looked up last, so that their text is never shuffled.
    why, fix = explanation_maps()
    explained = lambda i: i.withField("why", F.coalesce(why[i["checker"]], F.lit(""))).withField(
        "fix", F.coalesce(fix[i["checker"]], F.lit(""))
    )
    return lists.withColumn("issues", F.transform("issues", explained))


def json_reports(report: DataFrame) -> DataFrame:
    """(project, part, document): summary, issues and parse errors as JSON."""
    slim = F.transform("issues", lambda i: i.dropFields("rule_id", "why", "fix"))
    document = F.struct("summary", slim.alias("issues"), "parse_errors")
    return report.select("project", "part", F.to_json(document).alias("document"))


def report_order() -> list[Column]:
    """Per project, security before quality, then file and line, equal ones in scan order."""
    rest = [F.col(c) for c in ISSUE_ORDER if c != "path"]
    return [F.col("project"), F.when(_security(), 0).otherwise(1), F.col("path"), F.col("line"), *rest]


TEXT_ORDER = ("project", "section", "kind", "path", "line", "phase", "rule_order", "bfs", "ord")


def text_report(issues: DataFrame, parse_errors: DataFrame, overview: DataFrame) -> DataFrame:
    """The text report as one row per line with the columns that order it (``TEXT_ORDER``).

    ``section``: 0 security, 1 quality, 2 parse errors, 3 summary. ``kind``: 0 title, 1 entry,
    2 closing line. Lines stay rows, so a project of any size can be sorted and written by Spark.
    """
    places = ("path", "line", "phase", "rule_order", "bfs", "ord")

    def rows(df: DataFrame, section: Column, text: Column, **own: Column) -> DataFrame:
        place = {name: F.lit("" if name == "path" else 0) for name in places} | own
        return df.select(
            "project", section.alias("section"), F.lit(1).alias("kind"),
            *[value.alias(name) for name, value in place.items()], text.alias("text"),
        )

    entry = F.format_string(
        "  %s:%d  [%s] (%s) %s", "path", "line", F.upper("severity"), "checker", "message"
    )
    body = rows(issues, F.when(_security(), 0).otherwise(1), entry, **{name: F.col(name) for name in places})
    errors = rows(parse_errors, F.lit(2), F.concat(F.lit("  "), _error_text()), path=F.col("path"))

    # Titles, blank lines and the summary of a project come from its one overview row.
    def line(section: int, kind: int, text, shown) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(kind).alias("kind"),
            (text if isinstance(text, Column) else F.lit(text)).alias("text"), shown.alias("shown"),
        )

    total = F.format_string(
        "  %d issues (%d security, %d quality); %d file(s) failed to parse.",
        "total", "security", "quality", "files_with_errors",
    )
    alarm = F.format_string("  %d CRITICAL findings: review these first.", "critical")
    frame = [
        part
        for section, (title, count) in enumerate(
            (("SECURITY", "security"), ("CODE QUALITY", "quality"), ("PARSE ERRORS", "files_with_errors"))
        )
        for part in (line(section, 0, title, F.col(count) > 0), line(section, 2, "", F.col(count) > 0))
    ]
    frame += [
        line(3, 0, "SUMMARY", F.lit(True)), line(3, 1, total, F.lit(True)), line(3, 2, alarm, F.col("critical") > 0)
    ]
    framed = overview.select("project", F.inline(F.filter(F.array(*frame), lambda l: l["shown"])))
    framed = framed.select(
        "project", "section", "kind", *[F.lit("" if name == "path" else 0).alias(name) for name in places], "text"
    )
    return body.unionByName(errors).unionByName(framed)


def write_json(reports: DataFrame, target: str) -> None:
    reports.write.mode("errorifexists").json(target)


def write_text(lines: DataFrame, target: str) -> None:
    """One folder per project; the lines of a project are in order within and across its files."""
    ordered = lines.repartitionByRange(*TEXT_ORDER).sortWithinPartitions(*TEXT_ORDER)
    ordered.select("project", "text").write.mode("errorifexists").partitionBy("project").text(target)
