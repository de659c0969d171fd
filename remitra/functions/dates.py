"""Calendar keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def day_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def lag_days(transaction: Column, submission: Column) -> Column:
    """Calendar-day boundaries crossed, not elapsed days of 24 hours."""
    return F.datediff(submission, transaction)
