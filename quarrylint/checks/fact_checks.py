"""Checks of extraction: one per kind of fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylint.checks import corpus as made
from quarrylint.checks import oracle
from quarrylint.checks.base import Query, check
from quarrylint.functions import facts as code
from quarrylint.functions.staging import stage


def facts_of(name: str) -> Query:
    return lambda spark, sf_dir: code.extract_facts(made.families(spark, sf_dir, name))


def order_facts(spark, sf_dir):
    return code.extract_facts(made.order_files(spark, sf_dir))


def staged_order_facts(spark, sf_dir):
    return stage(order_facts(spark, sf_dir), "facts")


ORDER_ITEMS = """numbers AS (SELECT *, unnest(range(1, 2 + o_orderkey % 7)) AS n FROM orders),
    items AS (SELECT o_orderpriority AS project, 'orders/order_' || o_orderkey || '.py' AS path, n,
        (o_custkey + n) % 5 AS q, o_orderstatus AS f, n AS pos FROM numbers),
    placed AS (SELECT *, (sum(q + 3) OVER (PARTITION BY path ORDER BY pos) - (q + 3) + 1)::INT AS lineno FROM items)"""


@check("x01_file_facts", f"""WITH {ORDER_ITEMS}
    SELECT project, path, sum(q + 3)::INT AS n_lines, count(*)::INT AS n_functions, 0 AS n_classes,
        0 AS n_calls, true AS parsed FROM placed GROUP BY ALL""")
def file_facts(spark, sf_dir):
    return order_facts(spark, sf_dir).select(
        "project", "path", "n_lines", F.size("functions").alias("n_functions"),
        F.size("classes").alias("n_classes"), F.size("calls").alias("n_calls"),
        F.col("parse_error").isNull().alias("parsed"),
    )


@check("x02_parse_errors", f"WITH {oracle.PART}, {oracle.ERRORS} "
       "SELECT project, path, 'Cannot be parsed: invalid syntax, line 1' AS error, 1 AS line FROM errors")
def parse_errors(spark, sf_dir):
    return code.parse_errors(facts_of("broken")(spark, sf_dir))


@check("x03_functions", f"""WITH {ORDER_ITEMS}
    SELECT project, path, 'line_' || n AS name, lineno, (lineno + q + 2)::INT AS end_lineno, (q + 3)::INT AS n_lines,
        'a' AS params FROM placed""")
def functions(spark, sf_dir):
    return code.functions(order_facts(spark, sf_dir)).select(
        "project", "path", "name", "lineno", "end_lineno", "n_lines", F.array_join("params", ",").alias("params")
    )


@check("x04_classes", f"""WITH {oracle.PART} SELECT project, 'long/part_' || k || '.py' AS path, 'Big' AS name,
    3 * s + 4 AS lineno, 11 * s + 4 AS end_lineno, 8 * s + 1 AS n_lines FROM part_rows""")
def classes(spark, sf_dir):
    return code.classes(facts_of("long")(spark, sf_dir)).select(
        "project", "path", "name", "lineno", "end_lineno", "n_lines"
    )


@check("x05_import_bindings", f"""WITH {oracle.PART} SELECT project, 'imports/part_' || k || '.py' AS path,
    unnest(['os', 'system', 'dumps', 'loads', 'xml']) AS local,
    unnest([CASE WHEN s % 7 = 0 THEN 9 ELSE 2 END, 3, 4, 4, 5])::INT AS lineno,
    unnest(['os', 'system', 'dumps', 'loads', 'xml.dom']) AS display FROM part_rows""")
def import_bindings(spark, sf_dir):
    return code.bindings(facts_of("imports")(spark, sf_dir)).select("project", "path", "local", "lineno", "display")


@check("x06_names", f"""WITH {oracle.PART}, n AS (SELECT project, 'imports/part_' || k || '.py' AS path, unnest(
    ['__all__'] || CASE WHEN s % 2 = 0 THEN ['print', 'system'] ELSE [] END
    || CASE WHEN s % 3 = 0 THEN ['xml'] ELSE [] END) AS name FROM part_rows) SELECT * FROM n""")
def names(spark, sf_dir):
    return code.names(facts_of("imports")(spark, sf_dir))


@check("x07_exported", f"""WITH {oracle.PART} SELECT project, 'imports/part_' || k || '.py' AS path,
    'loads' AS name FROM part_rows WHERE s % 4 = 0""")
def exported(spark, sf_dir):
    return code.exported(facts_of("imports")(spark, sf_dir))


@check("x08_import_sources", f"""WITH {oracle.EVENTS} SELECT project, path,
    CASE v WHEN 5 THEN 'md5' ELSE 'load' END AS local, CASE v WHEN 5 THEN 'hashlib' ELSE 'pickle' END AS module
    FROM event_rows WHERE v IN (5, 11)""")
def import_sources(spark, sf_dir):
    return code.import_sources(code.extract_facts(made.call_files(spark, sf_dir)))


CALL_FACTS = (
    ("name", "eval", None, "", "Name", None), ("attribute", "eval", "m", "", "Name", None),
    ("attribute", "run", "subprocess", "shell=True", "Name", None), ("name", "run", None, "shell=", "Name", None),
    ("attribute", "md5", "hashlib", "", "Name", None), ("name", "md5", None, "", "Name", None),
    ("attribute", "loads", "pickle", "", "Name", None), ("attribute", "loads", "json", "", "Name", None),
    ("attribute", "execute", "cur", "", "BinOp", "Add"), ("attribute", "execute", "cur", "", "JoinedStr", None),
    ("attribute", "execute", "cur", "", "Constant", None), ("name", "load", None, "", "Name", None),
)
_CALL_VALUES = ", ".join(
    "(" + ", ".join([str(v)] + ["NULL" if x is None else f"'{x}'" for x in row]) + ")"
    for v, row in enumerate(CALL_FACTS)
)


@check("x09_calls", f"""WITH {oracle.EVENTS} SELECT project, path, 2 AS lineno, form, func, recv, keywords,
    arg0_kind, arg0_op FROM event_rows JOIN (VALUES {_CALL_VALUES})
    AS c(v, form, func, recv, keywords, arg0_kind, arg0_op) USING (v)""")
def calls(spark, sf_dir):
    keyword = lambda k: F.concat(k["name"], F.lit("="), F.coalesce(k["const"], F.lit("")))
    return code.calls(code.extract_facts(made.call_files(spark, sf_dir))).select(
        "project", "path", "lineno", "form", "func", "recv",
        F.array_join(F.transform("keywords", keyword), ",").alias("keywords"), "arg0_kind", "arg0_op",
    )


@check("x10_handlers", f"""WITH {oracle.PART} SELECT project, 'handlers/part_' || k || '.py' AS path, 3 AS lineno,
    CASE s % 6 WHEN 0 THEN NULL WHEN 2 THEN 'Tuple' WHEN 5 THEN 'Attribute' ELSE 'Name' END AS type_kind,
    CASE s % 6 WHEN 1 THEN 'Exception' WHEN 3 THEN 'ValueError' WHEN 4 THEN 'BaseException' END AS type_name,
    s % 4 < 2 AS only_pass FROM part_rows""")
def handlers(spark, sf_dir):
    return code.handlers(facts_of("handlers")(spark, sf_dir)).drop("bfs")


@check("x11_suppression_marks", f"""WITH {oracle.PART}, rows AS (SELECT *, 'imports/part_' || k || '.py' AS path FROM part_rows)
    SELECT project, path, 2 AS lineno, 'noqa' AS mark FROM rows WHERE s % 5 = 0
    UNION ALL SELECT project, path, 9, 'posix' FROM rows WHERE s % 7 = 0""")
def suppression_marks(spark, sf_dir):
    return code.suppressions(facts_of("imports")(spark, sf_dir), ("noqa", "posix"))
