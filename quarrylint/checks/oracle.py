"""The answers of all checks as SQL over the driver tables, for an independent engine."""

from __future__ import annotations

from quarrylint.operators.catalog import CATEGORIES, PENALTIES, PROFILES, RULE_IDS, RULES

_ORDER = {checker: position for position, checker in enumerate(PROFILES["web"])}

PART = """part_rows AS (
    SELECT p_brand AS project, p_partkey::VARCHAR AS k, p_size::INT AS s, p_type AS t FROM part)"""


def _issue(checker, where, *, folder, severity, line, message, symbol="NULL", measure="NULL",
           threshold="NULL", column="0", snippet="''", ord="0", source="part_rows", path=None, bfs="0"):
    path = path or f"'{folder}/part_' || k || '.py'"
    return f"""SELECT project, '{RULE_IDS[checker]}' AS rule_id, '{checker}' AS checker,
    '{CATEGORIES[checker]}' AS category, {severity} AS severity, {path} AS path,
    CAST({line} AS INT) AS line, CAST({column} AS INT) AS "column",
    CAST({symbol} AS VARCHAR) AS symbol, CAST({measure} AS INT) AS measure,
    CAST({threshold} AS INT) AS threshold, {message} AS message, {snippet} AS snippet,
    {99 if checker == 'duplicate-code' else 0} AS phase, {_ORDER[checker]} AS rule_order,
    {bfs} AS bfs, {ord} AS ord
    FROM {source} WHERE {where}"""


def complexity(t=10):
    return [_issue(
        "complexity", f"1 + s > {t}", folder="branches",
        severity=f"CASE WHEN 1 + s > {2 * t} THEN 'error' ELSE 'warning' END", line="1", symbol="'h'",
        measure="1 + s", threshold=t,
        message=f"'h has ' || (1 + s) || ' paths through it (McCabe), limit {t}'")]


def long_function(t=50):
    return [
        _issue("long-function", f"{n} > {t}", folder=folder,
               severity=f"CASE WHEN {n} > {2 * t} THEN 'error' ELSE 'warning' END", line="1",
               symbol=f"'{name}'", measure=n, threshold=t,
               message=f"'Function ''{name}'' spans ' || ({n}) || ' lines, limit {t}'")
        for folder, name, n in (("branches", "h", "s + 2"), ("long", "long_one", "3 * s + 3"))
    ]


# Bodies that are equal only within the family: groups of parts of one brand, type and size.
DUPLICATES = """duplicate_rows AS (
    SELECT project, min(path) AS path, min_by(k, path) AS k, count(*) AS n
    FROM (SELECT *, 'dups/part_' || k || '.py' AS path FROM part_rows)
    GROUP BY project, t, s HAVING count(*) > 1)"""


def duplicate_code():
    return [_issue(
        "duplicate-code", "true", folder="dups", source="duplicate_rows", path="path", severity="'warning'",
        line="1", symbol="'d_' || k", measure="n", threshold=5,
        message="'One body, ' || n || ' functions; this is the first of them'")]


# Last binding of each imported name in the family, with its place in the file.
IMPORT_CASES = (
    ("os", "CASE WHEN s % 7 = 0 THEN 9 ELSE 2 END", "os", "s % 7 = 0 OR s % 5 <> 0", 1, 0),
    ("system", "3", "system", "s % 2 <> 0", 2, 0),
    ("dumps", "4", "dumps", "true", 3, 0),
    ("loads", "4", "loads", "s % 4 <> 0", 3, 1),
    ("xml", "5", "xml.dom", "s % 3 <> 0", 4, 0),
)


def unused_imports():
    return [
        _issue("unused-imports", f"({where})", folder="imports", severity="'info'", line=line,
               symbol=f"'{shown}'", message=f"'Import ''{shown}'' is never used'", bfs=place, ord=ord)
        for _, line, shown, where, place, ord in IMPORT_CASES
    ]


def deep_nesting(t=4):
    return [_issue(
        "deep-nesting", f"1 + s % 7 > {t}", folder="nest", severity="'warning'", line=t + 2, symbol="'g'",
        measure=t + 1, threshold=t, message=f"'Nesting level {t + 1} in ''g'', limit {t}'")]


def too_many_parameters(t=6):
    return [_issue(
        "too-many-parameters", f"1 + s % 10 > {t}", folder="params", severity="'warning'", line="1",
        symbol="'f'", measure="1 + s % 10", threshold=t,
        message=f"'Function ''f'' takes ' || (1 + s % 10) || ' parameters, limit {t}'")]


def long_file(t=500):
    n = "11 * s + 4"
    return [_issue(
        "long-file", f"{n} > {t}", folder="long", severity="'warning'", line="1", measure=n, threshold=t,
        message=f"'File has ' || ({n}) || ' lines, limit {t}'")]


def large_class(t=300):
    n = "8 * s + 1"
    return [_issue(
        "large-class", f"{n} > {t}", folder="long", severity="'warning'", line="3 * s + 4", symbol="'Big'",
        measure=n, threshold=t, message=f"'Class ''Big'' spans ' || ({n}) || ' lines, limit {t}'")]


def mutable_default_arg():
    return [_issue(
        "mutable-default-arg", "s % 5 IN (0, 1, 3)", folder="defaults", severity="'error'", line="1",
        symbol="'f'", message="'Function ''f'' shares a mutable default between calls'")]


def broad_exception():
    what = "CASE WHEN s % 6 = 0 THEN 'Bare except' ELSE 'except Exception' END"
    how = "CASE WHEN s % 4 < 2 THEN ' drops the error silently' ELSE ' catches every error' END"
    return [_issue(
        "broad-exception", "s % 6 IN (0, 1)", folder="handlers",
        severity="CASE WHEN s % 4 < 2 THEN 'error' ELSE 'warning' END", line="3", message=f"{what} || {how}")]


EVENTS = """event_rows AS (
    SELECT 'user_' || user_id AS project, 'calls/event_' || event_id || '.py' AS path, event_id % 12 AS v
    FROM events)"""


def _call(checker, cases, severity):
    """``cases``: (variant, called name, message)."""
    pick = lambda column: "CASE v " + " ".join(f"WHEN {c[0]} THEN '{c[column]}'" for c in cases) + " END"
    variants = ", ".join(str(c[0]) for c in cases)
    return [_issue(
        checker, f"v IN ({variants})", folder="", source="event_rows", path="path", severity=f"'{severity}'",
        line="2", symbol=pick(1), message=pick(2))]


def dangerous_exec():
    return _call("dangerous-exec", [(0, "eval", "eval() runs text as code")], "error")


def unsafe_subprocess():
    return _call("unsafe-subprocess", [(2, "run", "run() starts a shell (shell=True)")], "error")


def weak_crypto():
    text = "MD5 is no longer collision resistant"
    return _call("weak-crypto", [(4, "md5", text), (5, "md5", text)], "warning")


def unsafe_deserialization():
    return _call("unsafe-deserialization", [
        (6, "loads", "pickle loads() may run foreign code"), (11, "load", "pickle load() may run foreign code"),
    ], "error")


def sql_injection_risk():
    return _call("sql-injection-risk", [
        (8, "execute", "Query text is put together with +"), (9, "execute", "Query text is an f-string"),
    ], "warning")


def entropy(value):
    """Bits per character of a text, to six decimals."""
    share = f"(len({value}) - len(replace({value}, c, ''))) / len({value})::DOUBLE"
    return (
        f"round(list_sum(list_transform(list_distinct(string_split({value}, '')), "
        f"lambda c: -({share}) * log2({share}))), 6)"
    )


# variant: (kind, column, first four characters)
SECRET_CASES = {
    0: ("aws-access-key", 8, "'AK' || 'IA'"),
    1: ("github-token", 7, "'gh' || 'p_'"),
    2: ("slack-token", 6, "'xo' || 'xb'"),
    3: ("json-web-token", 6, "'ey' || 'J' || md5(k)[1:1]"),
    4: ("private-key", 8, "'----'"),
    5: ("high-entropy", 14, "md5(k)[1:4]"),
    7: ("aws-access-key", 10, "'AK' || 'IA'"),
}


def hardcoded_secret():
    pick = lambda column, quote: "CASE s % 8 " + " ".join(
        f"WHEN {v} THEN {quote}{c[column]}{quote}" for v, c in SECRET_CASES.items()) + " END"
    return [_issue(
        "hardcoded-secret", f"s % 8 <> 6 AND (s % 8 <> 5 OR {entropy('md5(k)')} >= 3.0)", folder="secrets",
        severity="'critical'", line="2", column=pick(1, ""), symbol=pick(0, "'"),
        message=f"'Possible secret in code: ' || {pick(0, chr(39))}", snippet=f"({pick(2, '')}) || '****'")]


def _each(n, line):
    return f"array_to_string(list_transform(range(1, 1 + {n}), lambda i: {line}), '')"


# The text of each file that can be flagged, over the columns of its row; made-up keys are put together here as well.
FAMILY_TEXTS = {
    "params": r"""'def f(' || array_to_string(list_transform(range(0, 1 + s % 10), lambda i: 'a' || i), ', ')
        || e'):\n    return a0\n'""",
    "nest": r"e'def g(x):\n' || " + _each("1 + s % 7", r"repeat('    ', i) || 'if x > ' || i || e':\n'")
    + r" || repeat('    ', 2 + s % 7) || 'return x + ' || k || e'\n'",
    "branches": r"e'def h(x):\n' || " + _each("s", r"'    if x == ' || i || e': x += 1\n'")
    + r" || '    return x + ' || k || e'\n'",
    "long": r"""e'def long_one():\n    x = ' || k || e'\n' || repeat(e'    pass\n', 3 * s) || e'    return x\nclass Big:\n'
        || repeat(e'    a = 0\n', 8 * s)""",
    "dups": r"""'def d_' || k || e'(x):\n    "part ' || k || e'"\n    a = "' || t || e'"\n    b = ' || s
        || e'\n    c = a * b\n    return c\n'""",
    "imports": r"""e'from __future__ import annotations\nimport os' || CASE WHEN s % 5 = 0 THEN '  # noqa' ELSE '' END
        || e'\nimport sys as system\nfrom json import dumps, loads\nimport xml.dom\n'
        || CASE WHEN s % 4 = 0 THEN e'__all__ = ["loads"]\n' ELSE e'__all__ = []\n' END
        || CASE WHEN s % 2 = 0 THEN e'print(system)\n' ELSE e'pass\n' END
        || CASE WHEN s % 3 = 0 THEN 'xml.dom.x(' || k || e')\n' ELSE e'pass\n' END
        || CASE WHEN s % 7 = 0 THEN e'import posix as os\n' ELSE e'pass\n' END""",
    "defaults": r"""['def f(a=[]):', 'def f(a, *, b={}):', 'def f(a=list()):', 'def f(a={1}, b=[]):', 'def f(a=None):'][1 + s % 5]
        || e'\n    return a + ' || k || e'\n'""",
    "handlers": r"""e'try:\n    work(' || k || e')\nexcept'
        || ['', ' Exception', ' (Exception,)', ' ValueError', ' BaseException', ' m.Exception'][1 + s % 6]
        || CASE WHEN s % 4 < 2 THEN e':\n    pass\n' ELSE e':\n    pass\n    x = 1\n' END""",
    "secrets": r"""e'pass\n' || ['key = "AK' || 'IA' || lpad(k, 16, '0') || '"', 'gh = "gh' || 'p_' || md5(k) || 'abcd"',
        's = "xo' || 'xb-' || lpad(k, 10, '0') || '-' || md5(k) || '"',
        'j = "ey' || 'J' || md5(k) || '.ey' || 'J' || md5(k) || '.' || md5(k) || '"',
        'pem = "-----BEGIN RSA ' || 'PRIVATE KEY-----"', 'api_token = "' || md5(k) || '"', 'password = "aaaaaaaaaaaaaaaa"',
        'token = "AK' || 'IA' || lpad(k, 16, '0') || '"'][1 + s % 8] || e'\n'""",
}
CALL_TEXTS = r"""['pass', 'pass', 'pass', 'pass', 'pass', 'from hashlib import md5', 'pass', 'pass', 'pass', 'pass', 'pass',
    'from pickle import load'][1 + v] || e'\n' || ['eval(x)', 'm.eval(x)', 'subprocess.run(c, shell=True)', 'run(c, shell=flag)',
    'hashlib.md5(x)', 'md5(x)', 'pickle.loads(x)', 'json.loads(x)', 'cur.execute("a" + x)', 'cur.execute(f"a {x}")',
    'cur.execute("a", (x,))', 'load(x)'][1 + v] || e'\n'"""
TEXTS = "texts AS (" + " UNION ALL ".join(
    f"SELECT project, '{f}/part_' || k || '.py' AS path, {text} AS text FROM part_rows" for f, text in FAMILY_TEXTS.items()
) + f" UNION ALL SELECT project, path, {CALL_TEXTS} AS text FROM event_rows)"

BY_RULE = {
    "complexity": complexity, "long-function": long_function, "duplicate-code": duplicate_code,
    "unused-imports": unused_imports, "hardcoded-secret": hardcoded_secret, "deep-nesting": deep_nesting,
    "too-many-parameters": too_many_parameters, "long-file": long_file, "large-class": large_class,
    "mutable-default-arg": mutable_default_arg, "broad-exception": broad_exception,
    "dangerous-exec": dangerous_exec, "unsafe-subprocess": unsafe_subprocess, "weak-crypto": weak_crypto,
    "unsafe-deserialization": unsafe_deserialization, "sql-injection-risk": sql_injection_risk,
}

FOLDERS = ("params", "nest", "branches", "long", "dups", "imports", "defaults", "handlers", "secrets", "broken")
FILES = "files AS (" + " UNION ALL ".join(
    f"SELECT project, '{f}/part_' || k || '.py' AS path FROM part_rows" for f in FOLDERS
) + " UNION ALL SELECT project, path FROM event_rows)"
ERRORS = "errors AS (SELECT project, 'broken/part_' || k || '.py' AS path FROM part_rows WHERE s % 9 = 0)"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END"
POINTS = "CASE severity " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in PENALTIES.items()) + " ELSE 0 END"

ISSUE_FIELDS = (
    'project, rule_id, checker, category, severity, path, line, "column", symbol, measure, threshold, message, snippet'
)


def issues_cte(checkers=None, **thresholds):
    """CTEs part_rows, event_rows, duplicate_rows, files, errors, issues."""
    selects = []
    for checker in checkers or BY_RULE:
        build = BY_RULE[checker]
        limit = thresholds.get(checker)
        selects += build(limit) if limit is not None else build()
    union = "\nUNION ALL ".join(selects)
    return f"WITH {PART}, {EVENTS}, {DUPLICATES}, {FILES}, {ERRORS}, issues AS (\n{union})\n"


def issues_sql(checkers=None, **thresholds):
    return issues_cte(checkers, **thresholds) + f"SELECT {ISSUE_FIELDS} FROM issues"


SUMMARY = """count(*)::INT AS total,
    count(*) FILTER (category = 'quality')::INT AS quality, count(*) FILTER (category = 'security')::INT AS security,
    count(*) FILTER (severity = 'critical')::INT AS critical, count(*) FILTER (severity = 'error')::INT AS error,
    count(*) FILTER (severity = 'warning')::INT AS warning, count(*) FILTER (severity = 'info')::INT AS info"""


def _sub(test):
    return f"greatest(0, 100 - coalesce(sum({POINTS}) FILTER ({test}), 0))::INT"


SCORES = f"""sub AS (SELECT project, {_sub("category = 'security'")} AS security,
    {_sub("category = 'quality' AND checker <> 'complexity'")} AS quality,
    {_sub("checker = 'complexity'")} AS complexity FROM issues GROUP BY project)"""
OVERALL = "round((security + quality + complexity) / 3.0)::INT"


def band(score):
    return f"CASE WHEN {score} >= 85 THEN 'Great health' WHEN {score} >= 60 THEN 'Needs attention' ELSE 'At risk' END"


CATALOG = "catalog AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("'" + text.replace("'", "''") + "'" for text in (checker, rule_id, why, fix)) + ")"
    for rule_id, checker, _, _, why, fix in RULES
) + ") AS v(checker, rule_id, why, fix))"

# Lines as str.splitlines gives them; an empty text has none and a final break opens none.
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def line_list(text):
    parts = f"regexp_split_to_array({text}, '{BREAKS}')"
    return f"CASE WHEN {text} = '' THEN [] WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"
