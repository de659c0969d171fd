"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitra.operators.imports import conform
from remitra.schema import CANONICAL
from remitra.session import stage
from remitra.sources.pack import Pack, Part


def write_year(df: DataFrame, path: str) -> None:
    """Parquet by direction and year; a year that is written again replaces the old one.

    The rebalance hint lets adaptive execution split a year that is too large for
    one file and merge those that are too small.
    """
    keys = ["Flow", "Source_Year"]
    (
        conform(df).hint("rebalance", *keys).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    )


def write_typed(df: DataFrame, path: str) -> None:
    """Only the columns at hand, in their canonical types, snappy-compressed."""
    types = {f.name: f.dataType for f in CANONICAL}
    columns = [F.col(f"`{c}`").cast(types[c]).alias(c) for c in df.columns if c in types]
    df.select(*columns).write.mode("overwrite").option("compression", "snappy").parquet(path)


def payload(tables: dict[str, DataFrame]) -> DataFrame:
    """Every table as JSON rows under its name: the publishable pack."""
    whole = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def order_of(df: DataFrame) -> list[Column]:
    """The keys of a cube or list, in its order of columns; names go by their lower case. Lists of single rows have none."""
    if "usd" in df.columns or "tx" in df.columns:
        return []
    if "nm" in df.columns:
        return [F.lower("nm"), F.col("nm")]
    return [F.col(c).asc_nulls_last() for c in df.columns if c.endswith("_ix") or c in ("ymd", "yr", "name", "code")]


def write_payload(tables: dict[str, DataFrame], out: str, as_json: bool = False) -> None:
    """One parquet table per result, sorted by its keys, and on request the pack as JSON lines; see ``Pack``."""
    spark = next(iter(tables.values())).sparkSession
    pack = Pack(spark, out)
    orders = {name: keys for name, df in tables.items() if (keys := order_of(df))}
    pack.publish(tables, orders)
    if as_json:
        parts = pack.current()
        lines = payload({name: pack.read(name, parts) for name in tables})
        folder = f"{pack.new_folder()}/_pack"
        lines.write.partitionBy("table").text(f"{pack.root}/{folder}")
        pack.commit([*parts, Part("_pack", "", folder, lines.schema.json())])


def read_payload(spark: SparkSession, out: str) -> DataFrame:
    """The pack as (table, row)."""
    pack = Pack(spark, out)
    path = next(p.path for p in pack.current() if p.table == "_pack")
    return spark.read.text(f"{pack.root}/{path}").select("table", F.col("value").alias("row"))


def write_rates(rates: DataFrame, path: str) -> bool:
    """Replace the published rates, unless no source could be read. The old ones stay until the new ones are there."""
    rates = stage(rates, "rates")
    if rates.isEmpty():
        return False
    Pack(rates.sparkSession, path).publish({"rates": rates}, {"rates": [F.col("source"), F.col("code")]})
    return True


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return Pack(spark, path).read("rates")
