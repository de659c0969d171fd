"""Number parsing, rounding and banding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _to_double(c: Column) -> Column:
    # Java reads "1d" and "1f" as numbers, so the shape is tested first.
    return F.when(c.rlike(_NUMBER), c).try_cast("double")


def to_num(c: Column, commas: bool = True) -> Column:
    return _to_double(F.replace(c, F.lit(","), F.lit("")) if commas else c)


def num_eu(c: Column) -> Column:
    """European text: a dot groups thousands, the comma is the decimal point."""
    s = F.regexp_replace(c, r"[^\d.,-]", "")
    plain = F.replace(s, F.lit("."), F.lit(""))
    return _to_double(F.replace(plain, F.lit(","), F.lit(".")))


def num_en(c: Column) -> Column:
    """English text: the comma groups thousands, the dot is the decimal point."""
    return _to_double(F.replace(F.regexp_replace(c, r"[^\d.,-]", ""), F.lit(","), F.lit("")))


def r2(c: Column, places: int = 3) -> Column:
    """Round for output; NULL and minus zero become zero.

    Nine places come first: the order in which partitions are added changes the
    last bits of a sum, and must not decide which way a half is rounded.
    """
    return F.coalesce(F.round(F.round(c.cast("double"), 9), places), F.lit(0.0)) + F.lit(0.0)


def millions(total: Column) -> Column:
    return total / F.lit(1e6)


def size_bucket(usd: Column, bands: Sequence[tuple[float, float | None, str]]) -> Column:
    """Position of the half-open band that holds ``usd``; the last one has no upper end."""
    chain = None
    for position, (low, high, _) in enumerate(bands):
        inside = usd >= F.lit(float(low))
        if high is not None:
            inside = inside & (usd < F.lit(float(high)))
        chain = F.when(inside, position) if chain is None else chain.when(inside, position)
    return chain.otherwise(-1)


def python_number(c: Column) -> Column:
    """A double as Python prints it, for amounts from 0.0001 up to 1e16."""
    plain = F.regexp_replace(c.cast("string").try_cast("decimal(38,18)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(c)
    return (
        F.when(c == 0, F.lit("0.0"))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(c.cast("string"))
    )
