"""Collects each operator's query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from remitra.checks.inputs import Workspace
from remitra.checks.sql import PRELUDE

Query = Callable[[Workspace], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None) -> None:
    """Register one operator; without SQL only its rows are looked at."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = PRELUDE + sql
