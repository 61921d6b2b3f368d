"""Queries over the test tables, each an application of the operators, with the SQL that says the same."""

from . import covering, linking, readying, reconciling, searching, smaller, snapshots, suites
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "covering", "linking", "readying", "reconciling", "searching", "smaller", "snapshots", "suites"]
