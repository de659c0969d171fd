"""One query beside its SQL."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from remitra.checks.inputs import TABLES

KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


@dataclass
class Outcome:
    rows: int
    problems: list[str] = field(default_factory=list)


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return str(value) if isinstance(value, (list, dict, tuple)) else value


def compare(df: DataFrame, con, sql: str | None) -> Outcome:
    """Column names, types and rows must all be the same, in any row order."""
    names, types = sorted(df.columns), dict(df.dtypes)
    picked = df.select(*[f"`{n}`" for n in names]).collect()
    ours = Counter(tuple(_plain(v) for v in row) for row in picked)
    outcome = Outcome(len(picked))
    if sql is None:
        return outcome
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(kinds) != names:
        outcome.problems.append(f"columns {names} against {sorted(kinds)}")
        return outcome
    order = [list(kinds).index(n) for n in names]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    for n in names:
        if KINDS.get(kinds[n]) != types[n]:
            outcome.problems.append(f"type of {n}: {types[n]} against {kinds[n]}")
    if ours != theirs:
        outcome.problems.append(
            f"{names}: only here {list((ours - theirs).items())[:3]},"
            f" only there {list((theirs - ours).items())[:3]}"
        )
    return outcome
