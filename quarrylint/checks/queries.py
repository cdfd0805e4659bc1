"""All checks; importing the modules registers them, in the order of the inventory."""

from quarrylint.checks import (  # noqa: F401
    source_checks, fact_checks, rule_checks, scan_checks, report_checks,
)
from quarrylint.checks.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
