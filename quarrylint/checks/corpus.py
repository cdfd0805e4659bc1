"""Python source files derived from the driver tables, one row of a table to one file.

Each family makes one kind of code whose issues are arithmetic on the columns of its row, so
that every rule has an exact answer in plain SQL (see ``oracle.py``). The work of a query grows
with its table: no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Share out rows before they grow into text: a small table is one partition otherwise."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


# Spark SQL text of each family over columns k (p_partkey), s (p_size), t (p_type).
_LINES = "array_join(transform(sequence(1, {n}), i -> {line}), '')"
FAMILIES = {
    "params": r"""concat('def f(', array_join(transform(sequence(0, s % 10), i -> concat('a', i)), ', '),
        '):\n    return a0\n')""",
    "nest": r"concat('def g(x):\n', "
    + _LINES.format(n="1 + s % 7", line=r"concat(repeat('    ', i), 'if x > ', i, ':\n')")
    + r", repeat('    ', 2 + s % 7), 'return x + ', k, '\n')",
    "branches": r"concat('def h(x):\n', "
    + _LINES.format(n="s", line=r"concat('    if x == ', i, ': x += 1\n')")
    + r", '    return x + ', k, '\n')",
    "long": r"""concat('def long_one():\n    x = ', k, '\n', repeat('    pass\n', 3 * s),
        '    return x\nclass Big:\n', repeat('    a = 0\n', 8 * s))""",
    "dups": r"""concat('def d_', k, '(x):\n    "part ', k, '"\n    a = "', t, '"\n    b = ', s,
        '\n    c = a * b\n    return c\n')""",
    "imports": r"""concat('from __future__ import annotations\n',
        'import os', if(s % 5 = 0, '  # noqa', ''), '\n',
        'import sys as system\nfrom json import dumps, loads\nimport xml.dom\n',
        if(s % 4 = 0, '__all__ = ["loads"]\n', '__all__ = []\n'),
        if(s % 2 = 0, 'print(system)\n', 'pass\n'),
        if(s % 3 = 0, concat('xml.dom.x(', k, ')\n'), 'pass\n'),
        if(s % 7 = 0, 'import posix as os\n', 'pass\n'))""",
    "defaults": r"""concat(element_at(array('def f(a=[]):', 'def f(a, *, b={}):', 'def f(a=list()):',
        'def f(a={1}, b=[]):', 'def f(a=None):'), 1 + s % 5), '\n    return a + ', k, '\n')""",
    "handlers": r"""concat('try:\n    work(', k, ')\nexcept',
        element_at(array('', ' Exception', ' (Exception,)', ' ValueError', ' BaseException', ' m.Exception'),
        1 + s % 6), ':\n', if(s % 4 < 2, '    pass\n', '    pass\n    x = 1\n'))""",
    # made-up keys; the format prefixes are put together here so that scanners pass this file
    "secrets": r"""concat('pass\n', element_at(array(
        concat('key = "AK', 'IA', lpad(k, 16, '0'), '"'),
        concat('gh = "gh', 'p_', md5(k), 'abcd"'),
        concat('s = "xo', 'xb-', lpad(k, 10, '0'), '-', md5(k), '"'),
        concat('j = "ey', 'J', md5(k), '.ey', 'J', md5(k), '.', md5(k), '"'),
        concat('pem = "-----BEGIN RSA ', 'PRIVATE KEY-----"'),
        concat('api_token = "', md5(k), '"'),
        'password = "aaaaaaaaaaaaaaaa"',
        concat('token = "AK', 'IA', lpad(k, 16, '0'), '"')), 1 + s % 8), '\n')""",
    "broken": r"if(s % 9 = 0, 'def f(:\n', concat('x = ', k, '\n'))",
}

# Call snippets by event_id % 12: first line, second line.
CALLS = (
    ("pass", "eval(x)"),
    ("pass", "m.eval(x)"),
    ("pass", "subprocess.run(c, shell=True)"),
    ("pass", "run(c, shell=flag)"),
    ("pass", "hashlib.md5(x)"),
    ("from hashlib import md5", "md5(x)"),
    ("pass", "pickle.loads(x)"),
    ("pass", "json.loads(x)"),
    ("pass", 'cur.execute("a" + x)'),
    ("pass", 'cur.execute(f"a {x}")'),
    ("pass", 'cur.execute("a", (x,))'),
    ("from pickle import load", "load(x)"),
)


def families(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """``files`` of some families: one file per part and family, one project per brand."""
    part = table(spark, sf_dir, "part").selectExpr(
        "p_brand AS project", "cast(p_partkey AS string) AS k", "p_size AS s", "p_type AS t"
    )
    texts = [
        f"struct(concat('{name}/part_', k, '.py') AS path, {FAMILIES[name]} AS content)" for name in names
    ]
    return spread(part, "k").selectExpr("project", f"inline(array({', '.join(texts)}))")


def call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` with one call each: one file per event, one project per user."""
    texts = F.array(*[F.lit(f"{first}\n{second}\n") for first, second in CALLS])
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return spread(events, "event_id").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("project"),
        F.format_string("calls/event_%d.py", "event_id").alias("path"),
        F.get(texts, (F.col("event_id") % len(CALLS)).cast("int")).alias("content"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families and call files as one table."""
    return families(spark, sf_dir, *FAMILIES).unionByName(call_files(spark, sf_dir))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per order with one to seven functions; few different bodies, so huge groups of copies.

    A function has 3 to 7 lines: its body depends on customer, place in the file and order status.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    text = (
        r"concat('def line_', i, '(a):\n', repeat('    a += 1\n', cast((o_custkey + i) % 5 AS int) + 1), "
        r"""'    return "', o_orderstatus, '"\n')"""
    )
    return spread(orders, "o_orderkey").selectExpr(
        "o_orderpriority AS project",
        "concat('orders/order_', o_orderkey, '.py') AS path",
        f"array_join(transform(sequence(1, 1 + o_orderkey % 7), i -> {text}), '') AS content",
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents themselves as files: a project per source."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "source AS project", "cast(doc_id AS string) AS path", "text AS content"
    )
