import hashlib
import os
import re
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylint.functions.staging import join_groups, numbered, running_total, semi_join_spread, stage
from quarrylint.operators import duplicates
from quarrylint.operators.findings import finding
from quarrylint.operators.registry import Rule, choose_rules, project_rule, python_rule
from quarrylint.plans import history, report, triage
from quarrylint.plans.scan import file_issues, in_order, scan, scan_facts, scan_issues

SAMPLE = {
    "a.py": "import os\ndef f(a=[]):\n    return eval(a)\n",
    "b.py": "token = 'q8Zr3LpX0vWn5TsY'\n",
    "bad.py": "def f(:\n",
    "clean.py": "x = 1\n",
}


@pytest.fixture(scope="module")
def done(files_of):
    return scan(files_of(SAMPLE))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_issue_order_runs_by_file_then_rule(files_of):
    copy = "def g(a):\n    x = a\n    y = x\n    z = y\n    return eval(z)\n"
    rows = in_order(scan(files_of({**SAMPLE, "0.py": copy, "z.py": copy})).issues).orderBy("seq").collect()
    assert [(r.seq, r.path, r.checker) for r in rows] == [
        (1, "0.py", "dangerous-exec"), (2, "a.py", "unused-imports"), (3, "a.py", "mutable-default-arg"),
        (4, "a.py", "dangerous-exec"), (5, "b.py", "hardcoded-secret"), (6, "z.py", "dangerous-exec"),
        (7, "0.py", "duplicate-code"),
    ]


def test_numbered_equals_row_number_on_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"),
        F.xxhash64("id").alias("v"), "id",
    )
    wanted = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("long"))
    got = numbered(df.repartition(13), ["g"], ["v", "id"])
    assert rows_of(got, "g", "id", "seq") == rows_of(wanted, "g", "id", "seq")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "_slot" in plan  # no group is numbered in one piece


def test_join_groups_equals_plain_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 30")
    assert rows_of(join_groups(rows, groups, ["k"], "n", hot=2), "k", "id", "n") == rows_of(
        rows.join(groups, "k"), "k", "id", "n"
    )


def test_semi_join_spread_equals_plain_semi_join(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    keys = spark.range(0, 10, 2).select(F.col("id").alias("k"))
    assert rows_of(semi_join_spread(rows, keys, "k", "id"), "k", "id") == rows_of(
        rows.join(keys, "k", "left_semi"), "k", "id"
    )


def test_hot_copies_are_counted_whole(spark, files_of):
    body = "def f{i}(a):\n    x = a\n    y = x\n    z = y\n    return z\n"
    done = scan(files_of({f"m{i:03}.py": body.format(i=i) for i in range(620)}), profile=["duplicate-code"])
    found = duplicates.duplicate_code(done.facts).collect()
    assert len(found) == 1 and found[0].measure == 620
    places = done.duplicate_places().filter(F.col("first_path") == found[0].path).filter(F.col("first_line") == found[0].line)
    assert places.count() == 620 and places.filter("is_first").select("path").first()[0] == "m000.py"


def test_no_staged_column_holds_a_secret(files_of):
    key = "AKIA" + "Q" * 16
    done = scan(files_of({"a.py": f"k = '{key}'\ncall(token='{key}')\n"}), profile=["hardcoded-secret"])
    assert [r.snippet for r in done.issues.collect()] == ["AKIA****", "AKIA****"]
    facts = done.facts.select(F.to_json(F.struct("secret_hits")).alias("all")).collect()
    assert key not in facts[0]["all"]


def test_only_the_given_folder_is_written(spark, files_of, tmp_path):
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) if os.path.isdir(spark.conf.get("spark.checkpoint.dir")) else set()
    done = scan(files_of(SAMPLE), folder=str(tmp_path))
    report.project_report(done).count()
    in_order(done.issues, done.folder).count()
    done.duplicate_places().count()
    now = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) if os.path.isdir(spark.conf.get("spark.checkpoint.dir")) else set()
    assert now == before and os.listdir(tmp_path)
    done.drop()
    assert not os.path.isdir(f"{tmp_path}/{os.path.basename(done.folder)}")


def test_thresholds_need_no_new_parse(files_of):
    rules = choose_rules(["too-many-parameters"])
    facts = stage(scan_facts(files_of({"a.py": "def f(a, b, c): pass\n"}), rules), "facts")
    for limit, hits in ((3, 0), (2, 1)):
        assert file_issues(facts, rules, {"too-many-parameters": {"threshold": limit}}).count() == hits


def test_text_rules_need_no_python(files_of):
    rules = choose_rules(["long-file", "hardcoded-secret"])
    issues = scan_issues(scan_facts(files_of(SAMPLE), rules), rules)
    assert "Python" not in issues._jdf.queryExecution().executedPlan().toString()
    assert rows_of(issues, "path", "checker") == [("b.py", "hardcoded-secret")]


def test_syntax_errors_are_reported_without_tree_rules(files_of):
    done = scan(files_of(SAMPLE), profile="cli", only="security")
    assert done.rules == ("hardcoded-secret",)
    assert [r.path for r in done.parse_errors.collect()] == ["bad.py"]
    assert scan(files_of(SAMPLE), profile="cli", only="security", parse=False).parse_errors.count() == 0


def test_facts_are_pruned_to_what_rules_read(files_of):
    done = scan(files_of(SAMPLE))
    rules = choose_rules(["dangerous-exec"])
    plan = file_issues(done.facts, rules)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: (.*)", plan).group(1)
    assert "calls" in schema and "functions" not in schema and "bodies" not in schema


def test_profiles_and_categories():
    assert len(choose_rules("web")) == 16
    assert [r.checker for r in choose_rules("cli")] == [
        "complexity", "long-function", "duplicate-code", "unused-imports", "hardcoded-secret"
    ]
    assert [r.checker for r in choose_rules("cli", only="security")] == ["hardcoded-secret"]


def test_scan_without_rules_is_refused(files_of):
    with pytest.raises(ValueError):
        scan(files_of(SAMPLE), profile=[])


def test_partitions_do_not_change_results(files_of, done):
    columns = ("path", "checker", "line", "message")
    for n in (1, 200):
        assert rows_of(scan(files_of(SAMPLE), partitions=n).issues, *columns) == rows_of(done.issues, *columns)


def test_layout_and_names_do_not_change_measures(files_of):
    plain = "def f(a):\n    if a: pass\n    if a: pass\n    x = a\n    return x\n"
    changed = "def renamed(a):\n    # note\n    if a: pass\n\n    if a: pass\n    x = a\n    return x\n"
    done = scan(files_of({"a.py": plain, "b.py": changed}), thresholds={"complexity": {"threshold": 2}})
    assert rows_of(done.issues, "path", "checker", "measure") == [
        ("a.py", "complexity", 3), ("a.py", "duplicate-code", 2), ("b.py", "complexity", 3)
    ]


def test_failed_fact_group_gives_one_warning_per_rule(spark, done):
    broken = F.array(F.struct(F.lit("calls").alias("part"), F.lit("ValueError: x").alias("error")))
    facts = done.facts.withColumn("failures", F.when(F.col("path") == "a.py", broken).otherwise(F.col("failures")))
    rules = choose_rules(["dangerous-exec", "mutable-default-arg"])
    rows = file_issues(facts, rules).filter("path = 'a.py'").orderBy("rule_order").collect()
    assert [(r.checker, r.severity, r.line) for r in rows] == [
        ("dangerous-exec", "warning", 0), ("mutable-default-arg", "error", 2)
    ]
    assert rows[0].message == "Rule 'dangerous-exec' failed on this file: ValueError: x"


def test_custom_rules(files_of):
    def check(path, content):
        if "eval" in content:
            raise RuntimeError("no")
        return [{"line": 1, "message": "note", "severity": "info"}] if path == "clean.py" else []

    def many_files(facts):
        note = finding("info", 1, F.format_string("%d files", "n"))
        counted = facts.groupBy("project").agg(F.count("*").alias("n"), F.min("path").alias("path"))
        return counted.select("project", "path", note.alias("f")).select("project", "path", "f.*")

    rules = [python_rule("own", "quality", check, rule_id="OWN1"), Rule("many", "quality", query=many_files)]
    done = scan(files_of(SAMPLE), profile="cli", extra_rules=rules)
    found = rows_of(done.issues.filter("checker IN ('own', 'many')"), "path", "checker", "rule_id", "severity", "line", "message")
    assert found == [
        ("a.py", "many", "UNKNOWN", "info", 1, "4 files"),
        ("a.py", "own", "OWN1", "warning", 0, "Rule 'own' failed on this file: no"),
        ("clean.py", "own", "OWN1", "info", 1, "note"),
    ]


def test_rules_over_entries_are_not_asked_about_files_without_any(files_of):
    def first_call():
        name = F.get("calls", F.lit(0))["func"]
        return F.array(finding("info", 1, F.coalesce(name, F.raise_error(F.lit("a file without calls")))))

    own = Rule("first-call", "quality", findings=first_call, parts=("calls",), over="calls")
    rules = [*choose_rules(["hardcoded-secret", "dangerous-exec", "mutable-default-arg"]), own]
    facts = scan_facts(files_of(SAMPLE), rules)
    assert rows_of(file_issues(facts, rules), "path", "checker", "message", "rule_order") == [
        ("a.py", "dangerous-exec", "eval() runs text as code", 1), ("a.py", "first-call", "eval", 3),
        ("a.py", "mutable-default-arg", "Function 'f' shares a mutable default between calls", 2),
        ("b.py", "hardcoded-secret", "Possible secret in code: high-entropy", 0),
    ]


def test_scores_and_bands(spark, done):
    row = report.scores(done.issues).first()
    # security 100 - 20 - 10, quality 100 - 10 - 2
    assert (row.security, row.quality, row.complexity, row.overall, row.band) == (70, 88, 100, 86, "Great health")
    df = spark.createDataFrame([(s,) for s in (85, 84, 60, 59)], "s INT")
    assert [r[0] for r in df.select(report.health_band(F.col("s"))).collect()] == [
        "Great health", "Needs attention", "Needs attention", "At risk"
    ]


def test_overview_of_an_empty_project(spark, done):
    projects = spark.createDataFrame([("p",), ("none",)], "project STRING")
    rows = {r.project: r for r in report.project_overview(projects, done.issues, done.files, done.parse_errors).collect()}
    none = rows["none"]
    assert (none.total, none.files_scanned, none.score_overall, none.note) == (0, 0, 100, report.NO_FILES_NOTE)
    assert (rows["p"].files_scanned, rows["p"].files_analyzed, rows["p"].files_with_errors) == (4, 3, 1)
    assert rows["p"].note is None


def test_breakdown_lists_clean_files_too(done):
    rows = [tuple(r)[1:] for r in report.file_breakdown(done.files, done.issues).orderBy(*report.breakdown_order()).collect()]
    assert rows == [("a.py", 3, 1, 2, 0), ("b.py", 1, 1, 0, 1), ("bad.py", 0, 0, 0, 0), ("clean.py", 0, 0, 0, 0)]


def test_report_in_parts_is_whole(files_of):
    contents = {f"m{i:02}.py": "eval(x)\n" * (i % 4) for i in range(30)}
    done = scan(files_of(contents))
    whole = report.project_report(done).collect()
    assert len(whole) == 1 and whole[0].parts == 1
    parts = report.project_report(done, part_rows=7).orderBy("part").collect()
    assert len(parts) == parts[0].parts == 7
    assert {(p.summary, p.score, p.files_scanned) for p in parts} == {(whole[0].summary, whole[0].score, 30)}
    for name in ("issues", "files_list", "parse_errors"):
        assert [x for p in parts for x in p[name]] == list(whole[0][name])
    assert whole[0].files_list == sorted(contents) and len(whole[0].issues) == sum(i % 4 for i in range(30))
    assert whole[0].issues[0].why and whole[0].issues[0].rule_id == "SEC002"


def test_sources_are_cut_in_characters(files_of):
    files = files_of({f"f{i:02}.py": "eval(é)\n" * 3 for i in range(40)})
    done = scan(files)
    rows = report.flagged_sources(done.files, done.issues, max_chars=10).orderBy("rank").collect()
    assert [r.path for r in rows] == [f"f{i:02}.py" for i in range(40)]
    assert rows[0].source == "eval(é)\nev"


def test_annotated_source_keeps_the_last_empty_line(done):
    sources = report.flagged_sources(done.files, done.issues)
    rows = rows_of(report.annotated_source(sources, done.issues).filter("path = 'a.py'"), "line_no", "text", "flagged")
    assert rows == [(1, "import os", True), (2, "def f(a=[]):", True), (3, "    return eval(a)", True), (4, "", False)]
    near = report.excerpts(sources, done.issues, context=1).filter("checker = 'dangerous-exec'")
    assert rows_of(near, "line_no", "flagged") == [(2, False), (3, True), (4, False)]


def test_json_and_text_sinks(spark, done, tmp_path):
    report.write_json(report.json_reports(report.project_report(done)), str(tmp_path / "json"))
    stored = spark.read.json(str(tmp_path / "json")).first()
    assert '"total":4' in stored.document and '"parse_errors":["bad.py: Cannot be parsed' in stored.document
    overview = report.project_overview(done.files.select("project").distinct(), done.issues, done.files, done.parse_errors)
    lines = report.text_report(done.issues, done.parse_errors, overview)
    report.write_text(lines, str(tmp_path / "text"))
    parts = sorted((tmp_path / "text" / "project=p").glob("part-*"))
    text = "".join(p.read_text() for p in parts).split("\n")
    assert text[0] == "SECURITY" and text[1].startswith("  a.py:3  [ERROR] (dangerous-exec)")
    assert text[3] == "" and text[4] == "CODE QUALITY"
    assert text[-3] == "  4 issues (2 security, 2 quality); 1 file(s) failed to parse."
    assert text[-2] == "  1 CRITICAL findings: review these first."


def test_gate(spark, done):
    projects = spark.createDataFrame([("p",), ("none",)], "project STRING")
    for level, failed in (("critical", True), ("info", True)):
        rows = dict(tuple(r) for r in report.severity_gate(projects, done.issues, level).collect())
        assert rows == {"p": failed, "none": False}
    mild = done.issues.filter("severity = 'info'")
    assert not report.severity_gate(projects, mild, "warning").filter("project = 'p'").first().failed


def test_triage(done):
    issues = done.issues
    assert [r.checker for r in triage.triage(issues).collect()] == [
        "hardcoded-secret", "mutable-default-arg", "dangerous-exec", "unused-imports"
    ]
    assert [r.checker for r in triage.triage(issues, category="quality", severity="info").collect()] == ["unused-imports"]
    assert triage.triage(issues, path="b.py").count() == 1
    assert triage.triage(issues, text="EVAL").count() == 1
    assert triage.search(issues, "%").count() == 0 and triage.search(issues, "_").count() == 0
    top = triage.triage(issues, top=2)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    assert [r.path for r in triage.triage(issues, collation="UNICODE", top=1).collect()] == ["b.py"]


def test_history(spark, tmp_path):
    table = str(tmp_path / "history")
    for day in range(1, 22):
        row = [("p", datetime(2024, 1, day), None if day == 21 else day, 1 if day == 20 else 2, 1, 0)]
        for _ in range(1 + day % 2):  # a job that runs again replaces what it wrote
            history.append_history(spark.createDataFrame(row, history.HISTORY_DDL), table, f"day-{day}")
    assert history.read_history(spark, table).count() == 21
    rows = history.history_view(history.read_history(spark, table)).collect()
    assert len(rows) == 20 and rows[0].score == "—/100" and rows[1].score == "20/100"
    assert rows[1].counts == "1 issue (1 security, 0 quality)"
    assert rows[-1].scanned_at == datetime(2024, 1, 2)
    history.compact_history(spark, table)
    assert len(os.listdir(table)) == 1 and history.read_history(spark, table).count() == 20
    assert history.history_view(history.read_history(spark, table)).collect() == rows
    row = [("q", datetime(2024, 2, 1), 1, 2, 1, 0)]
    history.append_history(spark.createDataFrame(row, history.HISTORY_DDL), table, "day-22")
    shutil.copytree(f"{table}/append-compact-1", f"{table}/append-compact-9")  # as if a compaction had stopped
    assert history.read_history(spark, table).count() == 21
    history.compact_history(spark, table)
    assert sorted(os.listdir(table)) == ["append-compact-10"]
    assert {r.project for r in history.read_history(spark, table).collect()} == {"p", "q"}
    history.compact_history(spark, str(tmp_path / "none"))


def test_history_rows_of_a_scan(done):
    overview = report.project_overview(done.files.select("project").distinct(), done.issues, done.files, done.parse_errors)
    row = history.history_rows(overview, datetime(2024, 5, 1)).first()
    assert (row.project, row.scanned_at, row.overall, row.total) == ("p", datetime(2024, 5, 1), 86, 4)


def test_project_rule_streams_notes_and_reports_failures(spark, files_of):
    def gather(path, content):
        if "boom" in content:
            raise ValueError("no notes")
        return [word for word in content.split() if word != "="]

    def finish(notes):
        seen = {}
        for path, word in notes:
            if word in seen:
                yield {"path": path, "message": f"{word} also in {seen[word]}", "line": 1}
            seen.setdefault(word, path)
            if word == "stop":
                raise RuntimeError("enough")

    files = files_of({"b.py": "x = 1", "a.py": "x = 2", "c.py": "boom", "d.py": None}).unionByName(
        files_of({"a.py": "y = y", "b.py": "stop = 1", "c.py": "y = 3"}, project="q")
    )
    done = scan(files, profile=[], extra_rules=[project_rule("same-word", "quality", gather, finish)], parse=False)
    assert rows_of(done.issues, "project", "path", "severity", "line", "message") == [
        ("p", "b.py", "warning", 1, "x also in a.py"),
        ("p", "c.py", "warning", 0, "Rule 'same-word' failed on this file: no notes"),
        ("q", "", "warning", 0, "Rule 'same-word' failed on this project: enough"),
        ("q", "a.py", "warning", 1, "y also in a.py"),
    ]


def test_excerpts_shuffle_no_lines(done):
    plan = report.excerpts(report.flagged_sources(done.files, done.issues), done.issues)._jdf.queryExecution().executedPlan()
    assert "line_no" not in "".join(line for line in plan.toString().split("\n") if "Exchange" in line)


def test_running_totals_of_a_hot_group(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 5).alias("g"), F.xxhash64("id").alias("v"), (F.col("id") % 11).alias("w")
    )
    before = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    wanted = df.withColumn("sum", F.coalesce(F.sum("w").over(before), F.lit(0)))
    assert rows_of(running_total(df.repartition(9), ["g"], ["v"], "w", "sum"), "g", "v", "sum") == rows_of(wanted, "g", "v", "sum")


def test_sources_are_dealt_into_parts(files_of):
    texts = {f"f{n:02}.py": f"eval({n})\n" + "# filling\n" * n for n in range(40)}
    done = scan(files_of(texts), profile=["dangerous-exec"])
    parts = report.project_report(done, part_bytes=500).orderBy("part").collect()
    assert {path: text for r in parts for path, text in r.sources.items()} == texts
    assert len(parts) == parts[0].parts > 10
    assert all(sum(map(len, r.sources.values())) <= 500 + 410 for r in parts)


def test_sources_are_gathered_by_their_own_bytes(spark, files_of, tmp_path, monkeypatch):
    """Texts are staged one a row, and a task gathers few maps, however well the texts compress."""
    texts = {f"f{n:02}.py": f"eval({n})\n" + "# filling\n" * 4000 for n in range(60)}
    done = scan(files_of(texts), profile=["dangerous-exec"], folder=str(tmp_path))
    monkeypatch.setattr(report, "GATHERED_BYTES", 100_000, raising=False)
    whole = report.project_report(done, part_rows=7, part_bytes=100_000)
    staged, = (name for name in os.listdir(done.folder) if name.startswith("report-sources"))
    assert spark.read.parquet(f"{done.folder}/{staged}").count() == len(texts)
    for parts in (whole.filter("size(sources) > 0"), report.source_parts(done.files, done.issues, part_bytes=100_000)):
        rows = parts.select("part", "sources", F.spark_partition_id().alias("task")).collect()
        assert {path: text for r in rows for path, text in r.sources.items()} == texts and len(rows) == 24
        assert len({r.task for r in rows}) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(len(r.files_list) for r in whole.select("files_list").collect()) == len(texts)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2  # sources and lists; ENSURE_REQUIREMENTS over neither


def shuffled_joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "SortMergeJoin [project" in line and "path" in line]


def test_flagged_texts_are_never_broadcast(spark, done):
    made = done.files.select("project", "path", F.repeat("content", 1000).alias("content"))  # estimated at a few bytes
    assert len(shuffled_joins(report.flagged_sources(made, done.issues))) == 1
    parts = report.source_parts(made, done.issues)
    assert len(shuffled_joins(parts)) >= 2


def test_marks_are_never_broadcast(done):
    sources = report.flagged_sources(done.files, done.issues)
    for df in (report.annotated_source(sources, done.issues), report.excerpts(sources, done.issues)):
        assert len(shuffled_joins(df)) == 2
    assert len(shuffled_joins(report.file_breakdown(done.files, done.issues))) == 1


def test_report_without_sources_reads_no_text(files_of, tmp_path):
    done = scan(files_of({f"m{i:02}.py": "eval(x)\n" * (i % 4) for i in range(30)}), folder=str(tmp_path))
    lean = report.project_report(done, part_rows=7, with_sources=False).orderBy("part").drop("sources").collect()
    assert not [name for name in os.listdir(done.folder) if name.startswith(("report-sources", "summed"))]
    assert lean == report.project_report(done, part_rows=7).orderBy("part").drop("sources").collect()


def test_report_heads_put_nothing_in_order(files_of, tmp_path):
    done = scan(files_of({"a.py": "eval(x)\n", "b.py": "x = 1\n"}), folder=str(tmp_path))
    staged = set(os.listdir(done.folder))
    head = report.report_heads(done).collect()
    assert set(os.listdir(done.folder)) == staged
    whole = report.project_report(done).select(*report.report_heads(done).columns).collect()
    assert head == whole and head[0].checkers_run == list(done.rules)


def test_a07_flagged_sources_are_whole(spark, tmp_path):
    """All files with an issue, however many a project has, with all of their text."""
    from quarrylint.checks import queries

    parts = [(k, "Brand#1", "STEEL", 20 + k % 30) for k in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(n, 7) for n in range(24)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    found = queries.QUERIES["a07_flagged_sources"](spark, str(tmp_path)).collect()
    files = queries.QUERIES["a07_flagged_files"](spark, str(tmp_path)).collect()
    assert {(r.project, r.path, r.rank) for r in found} == {(r.project, r.path, r.rank) for r in files}
    assert max(r.rank for r in found) > 7 and {r.path.split("/")[0] for r in found} > {"calls", "long", "nest", "imports"}
    whole = "def long_one():\n    x = 9\n" + "    pass\n" * 87 + "    return x\nclass Big:\n" + "    a = 0\n" * 232
    assert hashlib.md5(whole.encode()).hexdigest() in {r.source_md5 for r in found}
