"""Aggregates for the reports.

Cubes read one of two shared base aggregates, never the transactions again,
unless they need a column no other cube needs. Positions are joined after
the aggregation, when few rows are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.config import loader, values
from remitra.functions.numbers import millions, r2, size_bucket
from remitra.functions.text import is_missing
from remitra.operators import fact as J
from remitra.operators.fact import Dims
from remitra.operators.names import only_real_names
from remitra.operators.scale import list_position, running_total, top_k_per_group, value_bucket

FLOW_USE = ["flow_ix", "use_ix"]


def base_day(tx: DataFrame, *more: str) -> DataFrame:
    """The daily counterpart of the monthly base."""
    keys = ["ymd", *FLOW_USE, "bank", "currency", "pur5", *more]
    return tx.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))


def _on(flag: str) -> Column:
    return F.when(F.col(flag), 1).otherwise(0)


def base_filed(tx: DataFrame, *more: str) -> DataFrame:
    """What the method, size and flag cubes share; amounts that are not positive have no size."""
    size = F.when(F.col("usd") > 0, size_bucket(F.col("usd"), values.SIZE_BANDS))
    df = tx.withColumns({"size_ix": size, "m2_ix": _on("m2_flag"), "move_ix": _on("move_flag")})
    return counted(df, ["yr", *FLOW_USE, "method_raw", "size_ix", "m2_ix", "move_ix", *more])


def _tests() -> dict[str, Column]:
    return {
        "bad_fx": F.col("bad_fx"), "null_amt": F.col("null_amt"), "zero_amt": F.col("zero_amt"),
        "neg_amt": F.col("neg_amt"), "future_dated": F.col("future_dated"),
        "no_country": F.col("country").isNull(), "no_method": F.col("method_raw").isNull(),
        "no_lsic": F.col("lsic").isNull(),
    }


def failed_tests(usd_band: tuple[float, float] = (values.FX_MIN, values.FX_MAX)) -> dict[str, Column]:
    """Every test that ``base_checks`` counts, by name."""
    fx = F.col("fx")
    return {
        **_tests(), "fx_missing": fx.isNull(), "fx_low": fx < usd_band[0], "fx_high": fx > usd_band[1],
        **{f"blank {field}": is_missing(F.col(field)) for field, _, _ in values.QUALITY_FIELDS},
    }


def base_checks(tx: DataFrame, *more: str, usd_band: tuple[float, float] = (values.FX_MIN, values.FX_MAX)) -> DataFrame:
    """Rows and failed tests by year, bank and code: one pass for quality, completeness and exchange-rate bands."""
    return counted_tests(tx, failed_tests(usd_band), *more)


def counted_tests(tx: DataFrame, tests: dict[str, Column], *more: str) -> DataFrame:
    """Rows, and those for which each test holds, by year, bank and code."""
    return tx.groupBy("yr", "bank", "pur5", *more).agg(F.count("*").alias("n"), *[F.count_if(test).alias(name) for name, test in tests.items()])


def cube(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("n").alias("n"), r2(millions(F.sum("usd"))).alias("usd_m")
    )


def sums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(r2(millions(F.sum("usd"))).alias("usd_m"))


def counted(tx: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tx.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))


def sort_cube(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A total order is for the sink; nothing in between sorts."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


# -- yearly and monthly ------------------------------------------------------


def cube_month(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_pur2(J.join_purposes(J.join_periods(base, dims), dims))
    df = J.join_bank_left(df.filter("pur2_ix IS NOT NULL"), dims)
    return cube(df, ["month_ix", "flow_ix", "pur2_ix", "use_ix", "bank_ix"])


def cube_country(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_bank_left(J.join_country(J.join_periods(base, dims), dims), dims)
    return cube(df, ["year_ix", "flow_ix", "country_ix", "use_ix", "bank_ix"])


def cube_currency(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_bank_left(J.join_currency(J.join_periods(base, dims), dims), dims)
    return cube(df, ["year_ix", "flow_ix", "currency_ix", "use_ix", "bank_ix"])


def cube_bank(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_bank_inner(J.join_periods(base, dims), dims)
    return cube(df, ["year_ix", "flow_ix", "bank_ix", "use_ix"])


def cube_purpose(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_purposes(J.join_periods(base, dims), dims).filter("purpose_ix >= 0")
    return cube(
        J.join_bank_left(df, dims), ["year_ix", "flow_ix", "purpose_ix", "use_ix", "bank_ix"]
    )


def cube_method(filed: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_methods(J.join_years(filed, dims), dims).filter("method_ix >= 0")
    return cube(df, ["year_ix", "flow_ix", "method_ix", "use_ix"])


def cube_size(filed: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_years(filed.filter("size_ix >= 0"), dims)
    return cube(df, ["year_ix", "flow_ix", "size_ix", "use_ix"])


def ts_bank(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_bank_inner(J.join_months(base, dims), dims)
    return cube(df, ["month_ix", "flow_ix", "bank_ix", "use_ix"])


def ts_country(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_bank_inner(J.join_country(J.join_months(base, dims), dims), dims)
    return cube(df, ["month_ix", "flow_ix", "country_ix", "use_ix", "bank_ix"])


def ts_currency(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_bank_inner(J.join_currency(J.join_months(base, dims), dims), dims)
    return cube(df, ["month_ix", "flow_ix", "currency_ix", "use_ix", "bank_ix"])


def coded_short(df: DataFrame) -> DataFrame:
    """Rows coded at two to four digits; this is not a roll-up of longer codes."""
    return df.filter((F.col("purpose_ix") >= 0) & (F.length("pur5") <= 4))


def ts_purpose(base: DataFrame, dims: Dims) -> DataFrame:
    df = coded_short(J.join_purposes(J.join_months(base, dims), dims))
    return cube(
        J.join_bank_inner(df, dims), ["month_ix", "flow_ix", "purpose_ix", "use_ix", "bank_ix"]
    )


def ts_line(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_purposes(J.join_months(base, dims), dims).filter("line_ix >= 0")
    return cube(
        J.join_bank_inner(df, dims), ["month_ix", "flow_ix", "line_ix", "use_ix", "bank_ix"]
    )


# -- daily -------------------------------------------------------------------


def day_line(day: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_bank_inner(J.join_purposes(day, dims).filter("line_ix >= 0"), dims)
    return cube(df, ["ymd", "flow_ix", "line_ix", "use_ix", "bank_ix"])


def day_bank(day: DataFrame, dims: Dims) -> DataFrame:
    return cube(J.join_bank_inner(day, dims), ["ymd", "flow_ix", "bank_ix", "use_ix"])


def day_currency(day: DataFrame, dims: Dims, top: int = values.DAILY_CURRENCIES) -> DataFrame:
    df = J.join_currency(day, dims).filter(F.col("currency_ix") < top)
    return sums(df, ["ymd", "flow_ix", "currency_ix", "use_ix"])


def day_goods(day: DataFrame) -> DataFrame:
    df = sums(J.join_goods(day), ["ymd", "flow_ix", "goods_ix", "use_ix"])
    return df.filter("usd_m <> 0")


def entity_days(tx: DataFrame, *more: str, least: float = values.ENTITY_DAY_MIN) -> DataFrame:
    """Daily totals of at least ``least`` dollars by name as filed."""
    name = F.coalesce("tr_name", "rc_name")
    return (
        tx.withColumn("raw_name", name).filter(F.col("raw_name").isNotNull())
        .groupBy("ymd", *FLOW_USE, "raw_name", *more).agg(F.sum("usd").alias("usd"))
        .filter(F.col("usd") >= least)
    )


def day_entity(totals: DataFrame, block: Sequence[str]) -> DataFrame:
    """Named daily totals, from the staged ``entity_days``.

    The threshold holds for each name as filed; names that clean to one name are
    then added up.
    """
    named = only_real_names(totals, "raw_name", "name", block)
    return sums(named, ["ymd", "flow_ix", "name", "use_ix"])


def big_entities(day_entity_rows: DataFrame) -> DataFrame:
    """Names in the order they first appear; within a day by direction and name."""
    first = day_entity_rows.groupBy("name").agg(
        F.min(F.struct("ymd", "flow_ix")).alias("first")
    ).select("name", "first.*")
    return list_position(
        first, [F.col("ymd"), F.col("flow_ix"), F.col("name")], F.col("ymd"), "entity_ix"
    ).select("name", "entity_ix")


def index_entities(day_entity_rows: DataFrame, names: DataFrame) -> DataFrame:
    return day_entity_rows.join(names, "name")


# -- two dimensions crossed --------------------------------------------------


def cross_country_currency(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_currency(J.join_country(J.join_months(base, dims), dims), dims)
    return cube(df, ["month_ix", "flow_ix", "country_ix", "currency_ix", "use_ix"])


def cross_country_sector(base: DataFrame, dims: Dims) -> DataFrame:
    df = coded_short(J.join_purposes(J.join_country(J.join_months(base, dims), dims), dims))
    return cube(df, ["month_ix", "flow_ix", "country_ix", "purpose_ix", "use_ix"])


def cross_country_line(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_purposes(J.join_country(J.join_months(base, dims), dims), dims)
    return cube(
        df.filter("line_ix >= 0"), ["month_ix", "flow_ix", "country_ix", "line_ix", "use_ix"]
    )


def cross_currency_sector(base: DataFrame, dims: Dims) -> DataFrame:
    df = coded_short(J.join_purposes(J.join_currency(J.join_months(base, dims), dims), dims))
    return cube(df, ["month_ix", "flow_ix", "currency_ix", "purpose_ix", "use_ix"])


def cross_currency_line(base: DataFrame, dims: Dims) -> DataFrame:
    df = J.join_purposes(J.join_currency(J.join_months(base, dims), dims), dims)
    return cube(
        df.filter("line_ix >= 0"), ["month_ix", "flow_ix", "currency_ix", "line_ix", "use_ix"]
    )


def cross_sector_line(base: DataFrame, dims: Dims) -> DataFrame:
    df = coded_short(J.join_purposes(J.join_months(base, dims), dims))
    return cube(
        df.filter("line_ix >= 0"), ["month_ix", "flow_ix", "purpose_ix", "line_ix", "use_ix"]
    )


# -- reporting quality -------------------------------------------------------


def lag(tx: DataFrame, dims: Dims) -> DataFrame:
    """Median and ninetieth percentile of the reporting lag per year and bank.

    Lags are whole days, so they are counted per day first and the percentile
    sees a short list of days with their frequencies.
    """
    days = (
        tx.filter("lag_days IS NOT NULL").groupBy("yr", "bank", "lag_days")
        .agg(
            F.count("*").alias("n"), F.count_if("late_sub").alias("late"),
            F.count_if("future_dated").alias("future"),
        )
    )
    days = J.join_bank_inner(J.join_years(days, dims), dims)
    at = lambda share: r2(F.percentile("lag_days", share, F.col("n")), 1)
    return days.groupBy("year_ix", "bank_ix").agg(
        at(0.5).alias("median_lag"), at(0.9).alias("p90_lag"),
        F.sum("late").alias("late"), F.sum("future").alias("future"), F.sum("n").alias("n"),
    )


def quality(checks: DataFrame, dims: Dims) -> DataFrame:
    counts = J.join_bank_inner(J.join_years(J.join_purposes(checks, dims), dims), dims)
    unclassified = F.when(F.col("pur2") == values.PUR2_OTHER, F.col("n")).otherwise(0)
    return counts.groupBy("year_ix", "bank_ix").agg(
        F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in _tests()],
        F.sum(unclassified).alias("unclassified"),
    )


def completeness(checks: DataFrame, dims: Dims) -> DataFrame:
    fields = [field for field, _, _ in values.QUALITY_FIELDS]
    counts = checks.groupBy("yr").agg(F.sum("n").alias("n"), *[F.sum(f"blank {f}").alias(f"no_{f}") for f in fields])
    return J.join_years(counts, dims).drop("yr")


def _used(tx: DataFrame) -> DataFrame:
    return tx.filter("usd > 0 AND use_ix = 1").select("yr", "flow_ix", "usd", "Hash_ID")


def rank_by_usd(tx: DataFrame, dims: Dims) -> DataFrame:
    """Rank of every used amount in its year and direction, with the group's total.

    Amounts are ranked within bands of like size, and the counts of the bands add up.
    """
    order = [F.desc("usd"), F.col("Hash_ID").asc_nulls_last()]
    keys = ["yr", "flow_ix"]
    ranked = running_total(_used(tx), keys, value_bucket(F.col("usd")), order, F.lit(1), "rn")
    totals = _used(tx).groupBy(*keys).agg(F.sum("usd").alias("tot"))
    return J.join_years(ranked.join(totals, keys), dims).drop("yr")


def largest_by_usd(tx: DataFrame, dims: Dims, deepest: int = 1000) -> DataFrame:
    """The ``deepest`` largest used amounts per year and direction, with the group's total.

    The total is aggregated apart, so the ranking can drop small amounts before
    the shuffle instead of sorting the whole group in one task.
    """
    used = _used(tx)
    order = [F.desc("usd"), F.col("Hash_ID").asc_nulls_last()]
    ranked = top_k_per_group(used, ["yr", "flow_ix"], order, deepest, spread_by="Hash_ID")
    totals = used.groupBy("yr", "flow_ix").agg(F.sum("usd").alias("tot"))
    return J.join_years(ranked.join(totals, ["yr", "flow_ix"]), dims).drop("yr")


def concentration(tx: DataFrame, dims: Dims) -> DataFrame:
    """Share of value held by the largest 10, 100 and 1000 transactions, in percent."""
    ranked = largest_by_usd(tx, dims)
    share = lambda k: r2(
        F.lit(100) * F.sum(F.when(F.col("rn") <= k, F.col("usd"))) / F.max("tot"), 2
    )
    return ranked.groupBy("year_ix", "flow_ix").agg(
        share(10).alias("top10"), share(100).alias("top100"), share(1000).alias("top1000")
    )


def flags(filed: DataFrame, dims: Dims) -> DataFrame:
    return cube(J.join_years(filed, dims), ["year_ix", *FLOW_USE, "m2_ix", "move_ix"])


def goods_sides(base: DataFrame) -> DataFrame:
    """Declared against measured main direction of each goods code."""
    goods = loader.goods_frame(base.sparkSession)
    codes = [code for code, _ in values.GOODS]
    side = lambda ix: F.sum(F.when(F.col("flow_ix") == ix, F.col("usd")).otherwise(0.0))
    measured = base.filter(F.col("pur5").isin(*codes)).groupBy("pur5").agg(
        F.when(side(1) > side(0), "in").otherwise("out").alias("measured")
    )
    return goods.join(measured, goods["code"] == measured["pur5"], "left").select(
        "code", "side", "measured", (~F.col("side").eqNullSafe(F.col("measured"))).alias("violates")
    )


def goods_side_violations(base: DataFrame) -> DataFrame:
    """Expected to be empty: a row means directions are wired the wrong way round."""
    return goods_sides(base).filter("violates")


def meta_totals(tx: DataFrame) -> DataFrame:
    return tx.agg(
        F.count("*").alias("n"),
        F.count_distinct("Hash_ID").alias("ids"),
        F.min("tx_date").cast("date").alias("first_day"),
        F.max("tx_date").cast("date").alias("last_day"),
        r2(millions(F.sum("usd"))).alias("gross_usd_m"),
    )


def source_stats(tx: DataFrame) -> DataFrame:
    return tx.filter("Source_File IS NOT NULL").groupBy("Source_File").agg(
        F.min("flow").alias("flow"),
        F.count("*").alias("n"),
        F.min("tx_date").cast("date").alias("first_day"),
        F.max("tx_date").cast("date").alias("last_day"),
    )
