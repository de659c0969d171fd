"""Dimensions: short ordered lists whose position is the key used in every cube.

They are built from sums by single keys, or from the base aggregate. Written
once with ``stage`` they carry their real size, so the planner broadcasts them
only while they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from remitra.config import loader, values
from remitra.config.loader import Config
from remitra.functions.text import bank_key, fix_mojibake, norm_text, strip
from remitra.operators.scale import list_position, top_k_per_group, value_bucket

BASE_KEYS = ["ym", "yr", "flow_ix", "use_ix", "bank", "country", "currency", "pur5"]


def base_month(tx: DataFrame, *more: str) -> DataFrame:
    """Counts and values at the finest grain the monthly and yearly cubes share.

    One pass over the transactions; twenty cubes are sums of it.
    """
    return tx.groupBy(*BASE_KEYS, *more).agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))


def key_sums(tx: DataFrame) -> DataFrame:
    """Value by each key of the dimensions alone, the other keys NULL: what they need of ``base_month``.

    As many rows as the keys have values, so next to nothing is shuffled, where
    the keys together are about as many as the transactions.
    """
    keys = ["ym", "yr", "bank", "country", "currency", "pur5"]
    return tx.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.sum("usd").alias("usd"))


def _positions(df: DataFrame, key: str, name: str) -> DataFrame:
    # Months and years: a century is 1,200 rows.
    return df.select(
        key, (F.row_number().over(W.orderBy(F.col(key))) - 1).alias(name)
    )


def dim_months(base: DataFrame) -> DataFrame:
    return _positions(base.select("ym").filter("ym IS NOT NULL").distinct(), "ym", "month_ix")


def dim_years(base: DataFrame) -> DataFrame:
    return _positions(base.select("yr").filter("yr IS NOT NULL").distinct(), "yr", "year_ix")


def by_value(base: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct values of ``key`` in falling order of value, the key breaking ties."""
    totals = base.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("usd").alias("usd"))
    order = [F.col("usd").desc_nulls_last(), F.col(key)]
    return list_position(totals, order, value_bucket(F.col("usd")), name)


def dim_countries(base: DataFrame, config: Config) -> DataFrame:
    spark = base.sparkSession
    english = loader.pairs_frame(spark, values.COUNTRY_NAMES, "country string, _en string")
    lao = loader.pairs_frame(spark, config.country_names_lo, "country string, lo string")
    return country_names(by_value(base, "country", "country_ix"), english, lao)


def country_names(df: DataFrame, english: DataFrame, lao: DataFrame) -> DataFrame:
    """English name, else the code itself; Lao name where one is given."""
    return (
        df.join(english, "country", "left")
        .join(lao, "country", "left")
        .withColumn("name", F.coalesce("_en", "country"))
        .drop("_en")
    )


def dim_currencies(base: DataFrame) -> DataFrame:
    return by_value(base, "currency", "currency_ix")


def resolve_alias(df: DataFrame, aliases: dict[str, str], key: str) -> DataFrame:
    """Replace a bank key by the one it is an alias of; one hop only."""
    frame = loader.pairs_frame(df.sparkSession, aliases, "_from string, _to string").select(
        bank_key(F.col("_from")).alias("_from"), bank_key(F.col("_to")).alias("_to")
    ).dropDuplicates(["_from"])
    return (
        df.join(F.broadcast(frame), F.col(key) == F.col("_from"), "left")
        .withColumn(key, F.coalesce("_to", key))
        .drop("_from", "_to")
    )


def dim_banks(base: DataFrame, config: Config) -> DataFrame:
    """One row per spelling: its bank's position and label.

    Spellings that differ in case, punctuation or by a declared alias are one
    bank, labelled with the spelling that carries the most value.
    """
    spellings = (
        base.filter(F.col("bank").isNotNull())
        .groupBy("bank").agg(F.sum("usd").alias("usd"))
        .withColumn("key", bank_key(F.col("bank")))
    )
    spellings = resolve_alias(spellings, config.bank_aliases, "key")
    # Most value first, no value last, the lower spelling on a tie.
    best = F.min_by("bank", F.struct(-F.coalesce("usd", F.lit(float("-inf"))), F.col("bank")))
    groups = spellings.groupBy("key").agg(
        F.sum(F.coalesce("usd", F.lit(0.0))).alias("bank_usd"), best.alias("label")
    )
    order = [F.col("bank_usd").desc_nulls_last(), F.col("key")]
    groups = list_position(groups, order, value_bucket(F.col("bank_usd")), "bank_ix")
    return spellings.select("bank", "key").join(groups, "key")


def norm_purpose_code(code: Column) -> Column:
    """Cut to the nearest lower valid length of 6, 4 or 2."""
    c = strip(code)
    size = F.length(c)
    return (
        F.when(size.isin(2, 4, 6), c)
        .when(size > 6, F.substring(c, 1, 6))
        .when(size > 4, F.substring(c, 1, 4))
        .otherwise(F.substring(c, 1, 2))
    )


def parent_code(code: Column) -> Column:
    return F.when(F.length(code) > 2, F.left(code, F.length(code) - 2))


def pur2_of(code: Column) -> Column:
    two = F.substring(code, 1, 2)
    known = [row[0] for row in values.PUR2]
    return F.when(two.isin(*known), two).otherwise(F.lit(values.PUR2_OTHER))


def report_line_for(codes: DataFrame, lines: DataFrame) -> DataFrame:
    """``line_ix`` of each distinct ``code`` by its longest declared prefix.

    Each code is expanded to its own prefixes and matched by equality. Without
    a match the catch-all line holds the code, or else the last line.
    """
    declared = lines.select("line_ix", F.explode("codes").alias("prefix"))
    # Of two lines with the same prefix the first one wins.
    declared = declared.groupBy("prefix").agg(F.min("line_ix").alias("line_ix"))
    # The empty prefix stands for the rest.
    rest = lines.agg(F.coalesce(F.max(F.when(F.col("catch_all"), F.col("line_ix"))), F.max("line_ix")).alias("line_ix"))
    declared = declared.unionByName(rest.select(F.lit("").alias("prefix"), "line_ix"))
    sizes = F.sequence(F.lit(0), F.length("code"))
    prefixes = F.transform(sizes, lambda n: F.substring(F.col("code"), F.lit(1), n))
    best = F.max_by("line_ix", F.length("prefix"))
    return (
        codes.select("code", F.explode(prefixes).alias("prefix"))
        .join(declared, "prefix").groupBy("code").agg(best.alias("line_ix"))
    )


def repaired_text(c: Column) -> Column:
    return norm_text(fix_mojibake(c))


def name_counts(tx: DataFrame, *more: str) -> DataFrame:
    """Rows by filed code and purpose name."""
    named = tx.filter((F.col("pur5") != "") & F.col("purpose_name").isNotNull())
    return named.groupBy("pur5", "purpose_name", *more).agg(F.count("*").alias("n"))


def purpose_name_votes(names: DataFrame) -> DataFrame:
    """The name most rows give each filed code, after repair; ties go to the lower name. ``names`` are ``name_counts``."""
    votes = (
        names.withColumn("name", repaired_text(F.col("purpose_name")))
        .groupBy("pur5", "name").agg(F.sum("n").alias("votes"))
    )
    order = [F.desc("votes"), F.col("name").asc_nulls_last()]
    return top_k_per_group(votes, ["pur5"], order, 1).drop("rn")


def dim_purposes(base: DataFrame, votes: DataFrame, config: Config) -> DataFrame:
    spark = base.sparkSession
    codes = (
        base.filter("pur5 <> ''").select(norm_purpose_code(F.col("pur5")).alias("code")).distinct()
    )
    lines = report_line_for(codes, loader.report_line_frame(spark, config))
    groups = loader.pur2_frame(spark).select("code", F.col("en").alias("_group_en"))
    official = loader.purpose_name_frame(spark, config)
    named = (
        codes.join(lines, "code")
        .join(votes.select(F.col("pur5").alias("code"), F.col("name").alias("_voted")), "code", "left")
        .join(groups, "code", "left")
        .join(official, "code", "left")
        .select(
            "code",
            F.coalesce(F.nullif("official_en", F.lit("")), "_group_en").alias("en"),
            F.coalesce(F.nullif("official_lo", F.lit("")), "_voted", "code").alias("name"),
            parent_code(F.col("code")).alias("parent"),
            pur2_of(F.col("code")).alias("pur2"),
            "line_ix",
        )
    )
    return list_position(named, [F.col("code")], F.substring("code", 1, 4), "purpose_ix")


def dim_methods(rows: DataFrame) -> DataFrame:
    """One row per filed method: its repaired name and the position of that name."""
    filed = rows.filter(F.col("method_raw").isNotNull()).select("method_raw").distinct()
    filed = filed.withColumn(
        "method", F.coalesce(repaired_text(F.col("method_raw")), F.col("method_raw"))
    )
    names = list_position(
        filed.select("method").distinct(), [F.col("method")], F.substring("method", 1, 2), "method_ix"
    )
    return filed.join(names, "method")
