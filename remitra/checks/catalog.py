"""All registered queries."""

from remitra.checks import core, intake, results, stored  # noqa: F401
from remitra.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
