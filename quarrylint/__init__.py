"""Scanning Python source code of many projects as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python workers get our functions with the task, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from quarrylint.operators.registry import Rule, choose_rules, python_rule  # noqa: E402
from quarrylint.plans.scan import Scan, in_order, scan  # noqa: E402
from quarrylint.sources.archives import load_archives  # noqa: E402
from quarrylint.sources.tree import load_tree  # noqa: E402

__all__ = ["Rule", "Scan", "choose_rules", "in_order", "load_archives", "load_tree", "python_rule", "scan"]
