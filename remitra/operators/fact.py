"""Joins that put dimension positions on transactions or on their aggregates.

None carries a broadcast hint: dimensions are staged tables, so the planner
broadcasts them by their measured size and otherwise falls back to a shuffle
join whose hot keys are split at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitra.config import loader, values
from remitra.config.loader import Config
from remitra.operators import dims as D
from remitra.operators.clean import with_flow_use_ix
from remitra.session import stage_all


@dataclass
class Dims:
    months: DataFrame
    years: DataFrame
    purposes: DataFrame
    countries: DataFrame
    currencies: DataFrame
    banks: DataFrame
    methods: DataFrame


def build_dims(base: DataFrame, names: DataFrame, filed: DataFrame, config: Config) -> Dims:
    """All dimensions from three aggregates, each written once; ``base`` may be the sums by single keys. They are small and independent, so they run side by side."""
    def purposes() -> DataFrame:
        return D.dim_purposes(base, D.purpose_name_votes(names), config)

    makers = {
        "months": lambda: D.dim_months(base), "years": lambda: D.dim_years(base),
        "purposes": purposes, "countries": lambda: D.dim_countries(base, config),
        "currencies": lambda: D.dim_currencies(base), "banks": lambda: D.dim_banks(base, config),
        "methods": lambda: D.dim_methods(filed),
    }
    return Dims(**stage_all(base.sparkSession, makers))


def join_purposes(df: DataFrame, dims: Dims) -> DataFrame:
    """Position, group and report line of the filed code; -1, '99' and -1 where it is unknown.

    The filed code is compared as it is, so odd lengths stay unmatched.
    """
    found = dims.purposes.select(
        F.col("code").alias("pur5"), F.col("purpose_ix").alias("_p"),
        F.col("pur2").alias("_g"), F.col("line_ix").alias("_l"),
    )
    return df.join(found, "pur5", "left").withColumns({
        "purpose_ix": F.coalesce("_p", F.lit(-1)),
        "pur2": F.coalesce("_g", F.lit(values.PUR2_OTHER)),
        "line_ix": F.coalesce("_l", F.lit(-1)),
    }).drop("_p", "_g", "_l")


def join_methods(df: DataFrame, dims: Dims) -> DataFrame:
    found = dims.methods.select("method_raw", F.col("method_ix").alias("_m"))
    return df.join(found, "method_raw", "left").withColumn(
        "method_ix", F.coalesce("_m", F.lit(-1))
    ).drop("_m")


def join_codes(tx: DataFrame, dims: Dims) -> DataFrame:
    """Transactions with every surrogate key the row-level reports use."""
    return with_flow_use_ix(join_methods(join_purposes(tx, dims), dims))


def join_months(df: DataFrame, dims: Dims) -> DataFrame:
    return df.join(dims.months, "ym")


def join_years(df: DataFrame, dims: Dims) -> DataFrame:
    return df.join(dims.years, "yr")


def join_periods(df: DataFrame, dims: Dims) -> DataFrame:
    return join_years(join_months(df, dims), dims)


def join_pur2(df: DataFrame) -> DataFrame:
    groups = loader.pur2_frame(df.sparkSession).select(F.col("code").alias("pur2"), "pur2_ix")
    return df.join(F.broadcast(groups), "pur2", "left")


def join_bank_left(df: DataFrame, dims: Dims) -> DataFrame:
    """Keep rows without a bank, at position -1."""
    found = dims.banks.select("bank", F.col("bank_ix").alias("_b"))
    return df.join(found, "bank", "left").withColumn(
        "bank_ix", F.coalesce("_b", F.lit(-1))
    ).drop("_b")


def join_bank_inner(df: DataFrame, dims: Dims) -> DataFrame:
    return df.join(dims.banks.select("bank", "bank_ix"), "bank")


def join_country(df: DataFrame, dims: Dims) -> DataFrame:
    return df.join(dims.countries.select("country", "country_ix"), "country")


def join_currency(df: DataFrame, dims: Dims) -> DataFrame:
    return df.join(dims.currencies.select("currency", "currency_ix"), "currency")


def join_goods(df: DataFrame) -> DataFrame:
    goods = loader.goods_frame(df.sparkSession)
    return df.join(F.broadcast(goods), df["pur5"] == goods["code"]).drop("code")
