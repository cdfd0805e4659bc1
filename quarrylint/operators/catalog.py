"""The rule catalog: stable ids, names, categories, severities, penalties, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severities with their rank (0 is worst) and score penalty.
SEVERITIES = ("critical", "error", "warning", "info")
PENALTIES = {"critical": 20, "error": 10, "warning": 5, "info": 2}

# Rule ids and rule names, in the order in which rules run.
# (rule_id, checker, category, needs_tree, why, fix)
RULES = (
    ("QUAL001", "complexity", "quality", True,
     "The more ways through a function, the more cases a change can break unseen.",
     "Look for decisions that belong together and give each group a function."),
    ("QUAL002", "long-function", "quality", True,
     "A long function tends to mix several tasks.",
     "Cut it into steps, one function per step."),
    ("QUAL003", "duplicate-code", "quality", True,
     "A fix in one copy is easily forgotten in the others.",
     "Keep one function and call it from every place."),
    ("QUAL004", "unused-imports", "quality", True,
     "An import nobody uses is noise and hides dead code.",
     "Delete it, or mark the line with noqa if it is meant to stay."),
    ("QUAL005", "deep-nesting", "quality", True,
     "What a line does depends on all conditions around it, and here there are many.",
     "Turn outer conditions around so that the main path stays at the left."),
    ("QUAL006", "too-many-parameters", "quality", True,
     "Two arguments swapped by a caller go unnoticed.",
     "Pass one object for values that always travel together."),
    ("QUAL007", "long-file", "quality", False,
     "A very long file usually holds several subjects.",
     "Split it by subject into modules."),
    ("QUAL008", "large-class", "quality", True,
     "Every method can touch all of its state.",
     "See which methods share fields, and part the class there."),
    ("QUAL009", "mutable-default-arg", "quality", True,
     "All calls without the argument work on one and the same object.",
     "Make the object inside the function when the argument is missing."),
    ("QUAL010", "broad-exception", "quality", True,
     "A typing mistake in the block ends up in the same handler.",
     "List what the block is known to raise."),
    ("SEC001", "hardcoded-secret", "security", False,
     "Whoever gets a copy of the sources gets the key as well, also from old commits.",
     "Withdraw the key, issue a new one and hand it to the program when it starts."),
    ("SEC002", "dangerous-exec", "security", True,
     "Evaluating text as code runs whatever the text says.",
     "Use a literal parser or a table of allowed operations."),
    ("SEC003", "unsafe-subprocess", "security", True,
     "A shell interprets the command, so input can add commands.",
     "Pass a list of arguments and leave the shell out."),
    ("SEC004", "weak-crypto", "security", True,
     "Two inputs of one digest can be computed.",
     "SHA-256 for sums; scrypt or argon2 where people type the input."),
    ("SEC005", "unsafe-deserialization", "security", True,
     "The bytes name functions that are called while they are read.",
     "Exchange JSON, or sign the bytes and check that first."),
    ("SEC006", "sql-injection-risk", "security", True,
     "Input that is part of the query text can change the query.",
     "Pass values as query parameters."),
)

# The order in which the full profile runs its rules, and the short profile.
PROFILES = {
    "web": (
        "complexity", "long-function", "duplicate-code", "unused-imports", "hardcoded-secret",
        "deep-nesting", "too-many-parameters", "long-file", "large-class", "mutable-default-arg",
        "broad-exception", "dangerous-exec", "unsafe-subprocess", "weak-crypto",
        "unsafe-deserialization", "sql-injection-risk",
    ),
    "cli": ("complexity", "long-function", "duplicate-code", "unused-imports", "hardcoded-secret"),
}

RULE_IDS = {checker: rule_id for rule_id, checker, *_ in RULES}
CATEGORIES = {checker: category for _, checker, category, *_ in RULES}
NEEDS_TREE = {checker: needs for _, checker, _, needs, *_ in RULES}


def rule_catalog(spark: SparkSession) -> DataFrame:
    """The 16 rules as a table; rule_order is the place in the full profile."""
    order = {checker: position for position, checker in enumerate(PROFILES["web"])}
    rows = [
        (checker, rule_id, category, order[checker], needs, why, fix)
        for rule_id, checker, category, needs, why, fix in RULES
    ]
    return spark.createDataFrame(
        rows,
        "checker STRING, rule_id STRING, category STRING, rule_order INT, needs_tree BOOLEAN, "
        "why STRING, fix STRING",
    )


def severity_rank(severity: Column) -> Column:
    """0 critical … 3 info, 4 for anything else."""
    ranks = F.lit(len(SEVERITIES))
    for rank in reversed(range(len(SEVERITIES))):
        ranks = F.when(severity == SEVERITIES[rank], rank).otherwise(ranks)
    return ranks


def penalty(severity: Column) -> Column:
    points = F.lit(0)
    for name, value in PENALTIES.items():
        points = F.when(severity == name, value).otherwise(points)
    return points


def explanation_maps() -> tuple[Column, Column]:
    """Rule name to reason and to remedy, as constant maps."""
    pairs = lambda place: [F.lit(text) for rule in RULES for text in (rule[1], rule[place])]
    return F.create_map(*pairs(4)), F.create_map(*pairs(5))


def explain_issues(issues: DataFrame) -> DataFrame:
    """Add rule_id (``UNKNOWN`` for a name outside the catalog), why and fix (empty by default).

    The catalog is a constant of 16 rows, hence the broadcast.
    """
    known = rule_catalog(issues.sparkSession).select("checker", "rule_id", "why", "fix")
    joined = issues.drop("rule_id", "why", "fix").join(F.broadcast(known), "checker", "left")
    return joined.withColumns({
        "rule_id": F.coalesce("rule_id", F.lit("UNKNOWN")),
        "why": F.coalesce("why", F.lit("")),
        "fix": F.coalesce("fix", F.lit("")),
    })
