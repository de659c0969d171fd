"""Views over the cubes: they never go back to the transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from remitra.config import loader
from remitra.config.loader import Config
from remitra.functions.numbers import r2
from remitra.functions.text import bank_key
from remitra.operators.scale import top_k

MEASURES = ("n", "usd_m")


def _between(df: DataFrame, low: str, high: str) -> DataFrame:
    return df.filter(F.col("ymd").between(low, high))


def period_report(
    cube: DataFrame, low: str, high: str, banks: Sequence[int] | None = None,
    uses: Sequence[int] | None = None,
) -> DataFrame:
    """A daily cube summed over an inclusive range of days, optionally for some banks or uses."""
    rows = _between(cube, low, high)
    if banks is not None:
        rows = rows.filter(F.col("bank_ix").isin(*banks))
    if uses is not None:
        rows = rows.filter(F.col("use_ix").isin(*uses))
    measures = [c for c in MEASURES if c in cube.columns]
    keys = [c for c in cube.columns if c not in (*MEASURES, "ymd", "bank_ix", "use_ix")]
    sums = [(r2(F.sum(c)) if c == "usd_m" else F.sum(c)).alias(c) for c in measures]
    return rows.groupBy(*keys).agg(*sums)


def bank_shares(day_bank: DataFrame, low: str, high: str) -> DataFrame:
    """Each bank's share of the value of its direction, in percent."""
    sums = _between(day_bank, low, high).groupBy("flow_ix", "bank_ix").agg(
        F.sum("usd_m").alias("usd_m")
    )
    # At most one row per bank and direction is left here.
    total = F.sum("usd_m").over(W.partitionBy("flow_ix"))
    return sums.select(
        "flow_ix", "bank_ix", r2(F.col("usd_m")).alias("usd_m"),
        r2(F.try_divide(F.lit(100) * F.col("usd_m"), total), 2).alias("share_pct"),
    )


def period_label(ym: Column, grain: str) -> Column:
    """A month as its month, quarter or year."""
    year, month = F.substring(ym, 1, 4), F.substring(ym, 6, 2).cast("int")
    if grain == "year":
        return year
    if grain == "quarter":
        return F.concat(year, F.lit("-Q"), F.ceil(month / 3).cast("string"))
    return ym


def rollup_period(cube: DataFrame, months: DataFrame, grain: str) -> DataFrame:
    """A monthly cube at a coarser grain: the sum of its months."""
    keys = [c for c in cube.columns if c not in (*MEASURES, "month_ix")]
    return (
        cube.join(months, "month_ix").withColumn("period", period_label(F.col("ym"), grain))
        .groupBy("period", *keys)
        .agg(F.sum("n").alias("n"), r2(F.sum("usd_m")).alias("usd_m"))
    )


def matrix(cube: DataFrame, rows: str, columns: str, members: Sequence[int]) -> DataFrame:
    """Two dimensions against each other; the column members are named, so no scan looks for them."""
    table = cube.groupBy(rows).pivot(columns, list(members)).agg(F.sum("usd_m"))
    return table.select(rows, *[r2(F.col(str(m))).alias(f"c{m}") for m in members])


def top_movers(day_entity: DataFrame, low: str, high: str, n: int) -> DataFrame:
    """The names that moved most in a range of days, per direction and in all."""
    sums = _between(day_entity, low, high).groupBy("flow_ix", "name").agg(
        F.sum("usd_m").alias("usd_m")
    )
    order = [F.desc("usd_m"), F.col("flow_ix"), F.col("name")]
    return top_k(sums, order, n).withColumn("usd_m", r2(F.col("usd_m")))


def search_names(names: DataFrame, text: str) -> DataFrame:
    return names.filter(F.lower("nm").contains(text.lower()))


def summary_split(day_line: DataFrame, config: Config) -> DataFrame:
    """Value by account group, with own-account lines and without."""
    lines = loader.report_line_frame(day_line.sparkSession, config)
    rows = day_line.join(F.broadcast(lines.select("line_ix", "grp", "bank_own")), "line_ix")
    business = F.sum(F.when(~F.col("bank_own"), F.col("usd_m")))
    return rows.groupBy("flow_ix", "grp").agg(
        r2(F.sum("usd_m")).alias("usd_m"), r2(business).alias("business_usd_m")
    )


def join_officers(banks: DataFrame, config: Config) -> DataFrame:
    """Responsible officer and full Lao name of each bank; NULL where none is assigned."""
    spark = banks.sparkSession
    officers = loader.pairs_frame(spark, config.officers, "_code string, officer string")
    names = loader.pairs_frame(spark, config.bank_names_lo, "_code string, bank_lo string")
    df = banks.withColumn("_key", bank_key(F.col("label")))
    for frame in (officers, names):
        keyed = frame.withColumn("_key", bank_key(F.col("_code"))).drop("_code")
        df = df.join(F.broadcast(keyed.dropDuplicates(["_key"])), "_key", "left")
    return df.withColumn("officer", F.nullif("officer", F.lit(""))).drop("_key")
