"""Exchange-rate errors and repeated reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.config import loader, values
from remitra.config.loader import Config
from remitra.functions.numbers import millions, r2
from remitra.functions.text import clean_name
from remitra.operators import fact as J
from remitra.operators.clean import flow_ix
from remitra.operators.fact import Dims
from remitra.operators.scale import exact_percentile, that_may_repeat, top_k

# -- exchange rates ----------------------------------------------------------


def fx_by_year_bank(checks: DataFrame, dims: Dims) -> DataFrame:
    """Rates that are missing or outside the band, from the shared test counts."""
    counts = J.join_bank_inner(J.join_years(checks.filter("bad_fx > 0"), dims), dims)
    return counts.groupBy("year_ix", "bank_ix").agg(
        *[F.sum(f"fx_{c}").alias(c) for c in ("missing", "low", "high")]
    )


def currency_medians(tx: DataFrame, least: int = values.MEDIAN_MIN_ROWS) -> DataFrame:
    """Median filed kip rate per currency and year, where enough was filed."""
    filed = tx.filter("currency IS NOT NULL").select("currency", "yr", "fxkip")
    return exact_percentile(filed, ["currency", "yr"], "fxkip", 0.5, least).select(
        "currency", "yr", F.col("result").alias("med"), "n"
    )


def year_medians(tx: DataFrame) -> DataFrame:
    """Median kip per US dollar of each year."""
    return exact_percentile(tx.select("yr", "fx"), ["yr"], "fx", 0.5).select(
        "yr", F.col("result").alias("med_fx")
    )


def ccy_rates(medians: DataFrame, dims: Dims) -> DataFrame:
    return J.join_currency(medians, dims).select("currency_ix", "yr", r2(F.col("med")).alias("rate"))


def join_medians(tx: DataFrame, medians: DataFrame, fx_medians: DataFrame) -> DataFrame:
    """Both references beside each transaction; pass staged tables, which are small."""
    return tx.join(medians.select("currency", "yr", "med"), ["currency", "yr"], "left").join(
        fx_medians, "yr", "left"
    )


def _off(rate: Column, reference: Column, factor: int) -> Column:
    apart = (rate > reference * factor) | (rate < reference / factor)
    return F.coalesce(reference.isNotNull() & (rate > 0) & apart, F.lit(False))


def wrong_rate() -> Column:
    return _off(F.col("fxkip"), F.col("med"), values.WRONG_RATE_FACTOR)


def off_band() -> Column:
    return _off(F.col("fx"), F.col("med_fx"), values.BAND_FACTOR)


def fx_counts(judged: DataFrame) -> DataFrame:
    """Totals per kind of error; one row may count under several kinds."""
    usd = F.col("usd")
    return judged.agg(
        F.count_if(usd.isNull()).alias("missing"),
        F.count_if(usd <= 0).alias("nonpos"),
        F.count_if(wrong_rate()).alias("wrongrate"),
        F.count_if((usd > 0) & off_band()).alias("band"),
    )


def fx_rows(judged: DataFrame, dims: Dims, limit: int = values.EXCEPTION_LIMIT) -> DataFrame:
    """The worst rows, each under its first kind, by how far they distort the dollar value."""
    usd, known = F.col("usd"), F.coalesce("usd", F.lit(0.0))
    kind = (
        F.when(usd.isNull(), "missing").when(usd <= 0, "nonpos")
        .when(wrong_rate(), "wrongrate").when(off_band(), "band")
    )
    comparable = F.col("med").isNotNull() & (F.col("fxkip") > 0)
    distortion = F.when(
        comparable, F.abs(known * (F.col("med") / F.when(F.col("fxkip") > 0, F.col("fxkip"))) - known)
    ).otherwise(known)
    rows = judged.withColumns({"kind": kind, "distortion": distortion}).filter("kind IS NOT NULL")
    order = [F.col("distortion").desc_nulls_last(), F.col("ymd"), F.col("Hash_ID").asc_nulls_last()]
    return _with_positions(top_k(rows, order, limit), dims).select(
        "Hash_ID", "ymd", "bank_ix", flow_ix(F.col("flow")).alias("flow_ix"), "currency_ix",
        r2(F.col("amt_orig"), 2).alias("amt"), F.round("fxkip", 3).alias("rate"),
        F.round("med", 3).alias("expected"), r2(usd, 2).alias("usd"), "ref", "kind",
    )


def _with_positions(df: DataFrame, dims: Dims) -> DataFrame:
    # Looked up by every spelling of a bank, not only by its label.
    found = dims.currencies.select("currency", F.col("currency_ix").alias("_c"))
    return (
        J.join_bank_left(df, dims).join(found, "currency", "left")
        .withColumn("currency_ix", F.coalesce("_c", F.lit(-1))).drop("_c")
    )


def rate_band_check(tx: DataFrame, config: Config | None = None) -> DataFrame:
    """Filed kip rates that are zero or outside the declared band of their currency."""
    bands = loader.rate_band_frame(tx.sparkSession, config or Config())
    rate = F.col("fxkip")
    kind = (
        F.when(rate == 0, "zero").when(rate < F.col("low"), "low").when(rate > F.col("high"), "high")
    )
    return (
        tx.join(bands, "currency").withColumn("kind", kind)
        .filter("kind IS NOT NULL").select("Hash_ID", "ymd", "currency", "fxkip", "kind")
    )


# -- duplicates --------------------------------------------------------------


def dup_tier(
    tx_all: DataFrame, keys: Sequence[str], min_reference: int | None = None,
    names: str | None = None,
) -> DataFrame:
    """Groups of rows alike in ``keys``, before deduplication, with size and value.

    Digests of the keys are counted first, so that only rows which may have
    copies are shuffled with all their columns; pass a written table.
    """
    rows = tx_all
    if min_reference is not None:
        rows = rows.filter(F.length("ref") >= min_reference)
    if names == "present":
        rows = rows.filter("tr_name IS NOT NULL AND rc_name IS NOT NULL")
    if names == "absent":
        rows = rows.filter("tr_name IS NULL AND rc_name IS NULL")
    # Values that vary within a group are reported by their lowest, which is repeatable.
    extra = {"country": F.min("country"), "nm": F.min(F.coalesce("tr_name", "rc_name"))}
    wanted = [c.alias(name) for name, c in extra.items() if min_reference is not None]
    groups = that_may_repeat(rows, keys).groupBy(*keys).agg(
        F.count("*").alias("c"), F.sum("usd").alias("usd"), *wanted
    )
    return groups.filter("c > 1")


def excess() -> Column:
    """Value of the copies beyond the first."""
    return F.col("usd") * (F.col("c") - 1) / F.col("c")


def dup_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("extra"),
        r2(millions(F.sum(excess()))).alias("usd_m"),
    )


def dup_by_year_bank(groups: DataFrame, dims: Dims) -> DataFrame:
    sums = groups.groupBy("yr", "bank").agg(
        F.sum(F.col("c") - 1).alias("extra"), F.sum(excess()).alias("usd")
    )
    return J.join_bank_inner(J.join_years(sums, dims), dims).groupBy("year_ix", "bank_ix").agg(
        F.sum("extra").alias("extra"), r2(millions(F.sum("usd"))).alias("usd_m")
    )


def dup_rows(
    groups: DataFrame, keys: Sequence[str], dims: Dims, limit: int = values.EXCEPTION_LIMIT,
) -> DataFrame:
    """The groups whose copies carry the most value, with names fit to print."""
    order = [excess().desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]]
    detail = [c for c in groups.columns if c in ("ref", "nm", "country", "pur5", "tr_name", "rc_name")]
    return _with_positions(top_k(groups, order, limit), dims).select(
        "ymd", "bank_ix", flow_ix(F.col("flow")).alias("flow_ix"), "currency_ix",
        r2(F.col("amt_orig"), 2).alias("amt"), F.col("c").alias("n"),
        r2(F.col("usd"), 2).alias("usd"),
        *[clean_name(F.col(c)).alias(c) if c in ("nm", "tr_name", "rc_name") else F.col(c) for c in detail],
    )
