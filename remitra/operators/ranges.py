"""Any range of days from running totals: the difference of two rows per key, read from two periods at most.

A daily cube becomes running totals per key. Every period (a month, or a year) in
which a key has already been seen starts with a row of what came before, so the
total up to any day is the last row of that day's period up to it. Totals are
decimals, so differences are exact. Written by period, a range reads the period of
its last day and that of the day before its first, however long it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from remitra.functions.numbers import r2
from remitra.operators.scale import top_k
from remitra.session import shared_dir, stage

MONTH, YEAR = 7, 4
_EXACT = "decimal(30,3)"


def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("ymd", "n", "usd_m", "days", "period")]


def running_totals(cube: DataFrame, grain: int = MONTH) -> DataFrame:
    """(keys, period, ymd, days, n, usd_m): totals up to and with each day of a daily cube.

    ``days`` counts rows, so that a key without any in a range is told from one whose values add up to nothing.
    """
    keys = _keys(cube)
    sums = {"days": F.count("*")} | ({"n": F.sum("n")} if "n" in cube.columns else {}) | {"usd_m": F.sum(F.col("usd_m").cast(_EXACT))}
    days = cube.groupBy(*keys, "ymd").agg(*[c.cast("long" if k != "usd_m" else _EXACT).alias(k) for k, c in sums.items()])
    days = stage(days.withColumn("period", F.substring("ymd", 1, grain)), "days")
    periods = days.groupBy(*keys, "period").agg(*[F.sum(k).alias(k) for k in sums])
    by_period = W.partitionBy(*keys).orderBy("period")
    upto = by_period.rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = periods.select(*keys, "period", F.lead("period").over(by_period).alias("_next"), *[F.sum(k).over(upto).alias(k) for k in sums])
    every = sorted(r[0] for r in days.select("period").distinct().collect())  # months or years
    later = F.filter(F.array(*map(F.lit, every)), lambda p: (p > F.col("period")) & (F.col("_next").isNull() | (p <= F.col("_next"))))
    carried = stage(reached.withColumn("period", F.explode(later)).drop("_next"), "carried")
    start = F.concat("period", F.lit("-00" if grain == MONTH else "-00-00"))
    # Within a period the carried row comes first, so one running sum covers both.
    rows = carried.withColumn("ymd", start).unionByName(days)
    within = W.partitionBy(*keys, "period").orderBy("ymd").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select(*keys, "period", "ymd", *[F.sum(k).over(within).cast("long" if k != "usd_m" else _EXACT).alias(k) for k in sums])


def write_totals(totals: DataFrame, folder: str | None = None) -> DataFrame:
    """Totals in a folder by period, read back."""
    spark = totals.sparkSession
    folder = folder or f"{shared_dir(spark)}/staged/totals-{uuid.uuid4().hex}"
    totals.repartition("period").sortWithinPartitions("period", "ymd").write.partitionBy("period").parquet(folder)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in totals.schema)
    return spark.read.schema(fields).parquet(folder)


def between(totals: DataFrame, low: str, high: str) -> DataFrame:
    """(keys, n, usd_m) of an inclusive range of days, for keys with a row in it."""
    keys = _keys(totals)
    measures = [c for c in ("days", "n", "usd_m") if c in totals.columns]
    periods = sorted(r[0] for r in totals.select("period").distinct().collect())  # names of folders

    def at(day: str, included: bool) -> DataFrame:
        period = max((p for p in periods if p <= day[: len(p)]), default="")
        until = F.col("ymd") <= day if included else F.col("ymd") < day
        rows = totals.filter((F.col("period") == period) & until)
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*measures), "ymd").alias("_at"))

    end, start = at(high, True), at(low, False).select(F.struct(*keys).alias("_key"), F.col("_at").alias("_before"))
    both = end.withColumn("_own", F.struct(*keys)).join(start, F.col("_own") == F.col("_key"), "left")
    # no row before the range: everything up to its end lies in it
    change = lambda m: F.col("_at")[m] - F.coalesce(F.col("_before")[m], F.lit(0).cast(totals.schema[m].dataType))
    found = both.select(*keys, *[change(m).alias(m) for m in measures]).filter("days > 0").drop("days")
    return found.withColumn("usd_m", F.col("usd_m").cast("double"))


def period_report(totals: DataFrame, low: str, high: str, banks: Sequence[int] | None = None, uses: Sequence[int] | None = None) -> DataFrame:
    """A daily cube summed over a range of days, optionally for some banks or uses."""
    rows = totals
    if banks is not None:
        rows = rows.filter(F.col("bank_ix").isin(*banks))
    if uses is not None:
        rows = rows.filter(F.col("use_ix").isin(*uses))
    found = between(rows, low, high)
    keys = [c for c in _keys(found) if c not in ("bank_ix", "use_ix")]
    counts = [F.sum("n").alias("n")] if "n" in found.columns else []
    return found.groupBy(*keys).agg(*counts, r2(F.sum("usd_m")).alias("usd_m"))


def bank_shares(totals: DataFrame, low: str, high: str) -> DataFrame:
    """Each bank's share of the value of its direction, in percent."""
    sums = between(totals, low, high).groupBy("flow_ix", "bank_ix").agg(F.sum("usd_m").alias("usd_m"))
    whole = F.sum("usd_m").over(W.partitionBy("flow_ix"))  # a row per bank and direction
    return sums.select("flow_ix", "bank_ix", r2(F.col("usd_m")).alias("usd_m"), r2(F.try_divide(F.lit(100) * F.col("usd_m"), whole), 2).alias("share_pct"))


def top_movers(totals: DataFrame, low: str, high: str, n: int) -> DataFrame:
    """The names that moved most in a range of days, per direction and in all."""
    sums = between(totals, low, high).groupBy("flow_ix", "name").agg(F.sum("usd_m").alias("usd_m"))
    return top_k(sums, [F.desc("usd_m"), F.col("flow_ix"), F.col("name")], n).withColumn("usd_m", r2(F.col("usd_m")))


