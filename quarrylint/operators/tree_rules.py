"""Rules over the facts of one file. Each returns an array of findings as a Catalyst expression.

Thresholds enter here and not in extraction, so changing one needs no new parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylint.functions.facts import binding_imports, has_mark, imported_from, resolved
from quarrylint.operators.findings import finding, no_findings


# The names the rules look for, and the default marks of a line left alone.
SHELL_CALLS = ("run", "call", "check_call", "check_output", "Popen")
EXEC_CALLS = ("eval", "exec")
WEAK_HASHES = ("md5", "sha1")
PICKLE_LOADS = ("load", "loads")
SQL_CALLS = ("execute", "executemany")
MUTABLE_LITERALS = ("List", "Dict", "Set")
RECEIVERS = ("self", "cls")
IGNORE_MARKS = ("noqa", "quarrylint: ignore")


def _length(node: Column) -> Column:
    return node["end_lineno"] - node["lineno"] + 1


def _above(measure: Column, threshold: int) -> Column:
    """A warning, or an error above twice the threshold."""
    return F.when(measure > 2 * threshold, "error").otherwise("warning")


def _text(pattern: str, *values) -> Column:
    return F.format_string(pattern, *values)


def complexity_score(function: Column) -> Column:
    return F.aggregate(function["decisions"], F.lit(1), lambda acc, d: acc + d["weight"])


def complexity(threshold: int = 10) -> Column:
    scored = F.transform(
        "functions", lambda f: F.struct(f.alias("f"), complexity_score(f).alias("score"))
    )
    return F.transform(
        F.filter(scored, lambda s: s["score"] > threshold),
        lambda s: finding(
            _above(s["score"], threshold), s["f"]["lineno"],
            _text(f"%s has %d paths through it (McCabe), limit {threshold}", s["f"]["name"], s["score"]),
            bfs=s["f"]["bfs"], symbol=s["f"]["name"], measure=s["score"], threshold=threshold,
        ),
    )


def long_function(threshold: int = 50) -> Column:
    return F.transform(
        F.filter("functions", lambda f: _length(f) > threshold),
        lambda f: finding(
            _above(_length(f), threshold), f["lineno"],
            _text(f"Function '%s' spans %d lines, limit {threshold}", f["name"], _length(f)),
            bfs=f["bfs"], symbol=f["name"], measure=_length(f), threshold=threshold,
        ),
    )


def unused_imports(marks=IGNORE_MARKS) -> Column:
    bound = binding_imports(F.col("imports"))
    unused = F.array_except(
        F.array_except(F.transform(bound, lambda b: b["local"]), F.col("names")), F.col("exported")
    )
    found = F.transform(
        F.filter(resolved(F.col("imports"), unused), lambda b: ~has_mark(b["line_text"], marks)),
        lambda b: finding(
            "info", b["lineno"], _text("Import '%s' is never used", b["display"]),
            bfs=b["bfs"], ord=b["ord"], symbol=b["display"],
        ),
    )
    return F.when(F.size("imports") == 0, no_findings()).otherwise(found)


def deep_nesting(threshold: int = 4) -> Column:
    too_deep = F.transform(
        "functions",
        lambda f: F.struct(
            f.alias("f"),
            F.get(F.filter(f["nesting"], lambda n: n["depth"] > threshold), F.lit(0)).alias("at"),
        ),
    )
    return F.transform(
        F.filter(too_deep, lambda d: d["at"].isNotNull()),
        lambda d: finding(
            "warning", d["at"]["lineno"],
            _text(f"Nesting level %d in '%s', limit {threshold}", d["at"]["depth"], d["f"]["name"]),
            bfs=d["f"]["bfs"], symbol=d["f"]["name"], measure=d["at"]["depth"], threshold=threshold,
        ),
    )


def too_many_parameters(threshold: int = 6) -> Column:
    count = lambda f: F.size(F.filter(f["params"], lambda p: ~p.isin(*RECEIVERS)))
    return F.transform(
        F.filter("functions", lambda f: count(f) > threshold),
        lambda f: finding(
            "warning", f["lineno"],
            _text(f"Function '%s' takes %d parameters, limit {threshold}", f["name"], count(f)),
            bfs=f["bfs"], symbol=f["name"], measure=count(f), threshold=threshold,
        ),
    )


def large_class(threshold: int = 300) -> Column:
    return F.transform(
        F.filter("classes", lambda c: _length(c) > threshold),
        lambda c: finding(
            "warning", c["lineno"],
            _text(f"Class '%s' spans %d lines, limit {threshold}", c["name"], _length(c)),
            bfs=c["bfs"], symbol=c["name"], measure=_length(c), threshold=threshold,
        ),
    )


def mutable_default_arg() -> Column:
    literals = F.array(*[F.lit(kind) for kind in MUTABLE_LITERALS])
    return F.transform(
        F.filter("functions", lambda f: F.exists(f["default_kinds"], lambda k: F.array_contains(literals, k))),
        lambda f: finding(
            "error", f["lineno"],
            _text("Function '%s' shares a mutable default between calls", f["name"]),
            bfs=f["bfs"], symbol=f["name"],
        ),
    )


def broad_exception() -> Column:
    bare = lambda h: h["type_kind"].isNull()
    named = lambda h: F.coalesce(h["type_name"], F.lit("")) == "Exception"
    what = lambda h: F.when(bare(h), "Bare except").otherwise("except Exception")
    return F.transform(
        F.filter("handlers", lambda h: bare(h) | named(h)),
        lambda h: finding(
            F.when(h["only_pass"], "error").otherwise("warning"), h["lineno"],
            F.concat(what(h), F.when(h["only_pass"], " drops the error silently").otherwise(" catches every error")),
            bfs=h["bfs"],
        ),
    )


def _calls(test, severity: str, message) -> Column:
    return F.transform(
        F.filter("calls", test),
        lambda c: finding(severity, c["lineno"], message(c), bfs=c["bfs"], symbol=c["func"]),
    )


def dangerous_exec() -> Column:
    return _calls(
        lambda c: (c["form"] == "name") & c["func"].isin(*EXEC_CALLS),
        "error",
        lambda c: _text("%s() runs text as code", c["func"]),
    )


def unsafe_subprocess() -> Column:
    shell = lambda k: (k["name"] == "shell") & (k["const"] == "True")
    return _calls(
        lambda c: c["func"].isin(*SHELL_CALLS) & F.exists(c["keywords"], shell),
        "error",
        lambda c: _text("%s() starts a shell (shell=True)", c["func"]),
    )


def _imported_from(call: Column, module: str) -> Column:
    """True if the last from-import that binds the called name takes it from ``module``."""
    return F.coalesce(imported_from(F.col("imports"), call["func"]) == module, F.lit(False))


def weak_crypto() -> Column:
    return _calls(
        lambda c: c["func"].isin(*WEAK_HASHES)
        & ((c["form"] == "attribute") | _imported_from(c, "hashlib")),
        "warning",
        lambda c: _text("%s is no longer collision resistant", F.upper(c["func"])),
    )


def unsafe_deserialization() -> Column:
    return _calls(
        lambda c: c["func"].isin(*PICKLE_LOADS)
        & F.when(c["form"] == "attribute", F.coalesce(c["recv"] == "pickle", F.lit(False)))
        .otherwise(_imported_from(c, "pickle")),
        "error",
        lambda c: _text("pickle %s() may run foreign code", c["func"]),
    )


def sql_injection_risk() -> Column:
    added = lambda c: (c["arg0_kind"] == "BinOp") & (c["arg0_op"] == "Add")
    return _calls(
        lambda c: (c["form"] == "attribute") & c["func"].isin(*SQL_CALLS)
        & F.coalesce(added(c) | (c["arg0_kind"] == "JoinedStr"), F.lit(False)),
        "warning",
        lambda c: F.when(added(c), "Query text is put together with +").otherwise("Query text is an f-string"),
    )


def long_file(threshold: int = 500) -> Column:
    """Needs only ``n_lines``, so it also runs on files that do not parse."""
    text = _text(f"File has %d lines, limit {threshold}", F.col("n_lines"))
    found = F.array(finding("warning", 1, text, measure=F.col("n_lines"), threshold=threshold))
    return F.when(F.col("n_lines") > threshold, found).otherwise(no_findings())


def hardcoded_secret() -> Column:
    """Needs only ``secret_hits`` of the text."""
    return F.transform(
        "secret_hits",
        lambda h, i: finding(
            "critical", h["line"], F.concat(F.lit("Possible secret in code: "), h["kind"]),
            bfs=h["line"], ord=i, column=h["column"], symbol=h["kind"], snippet=h["shown"],
        ),
    )
