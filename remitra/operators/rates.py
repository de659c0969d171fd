"""Exchange rates out of captured web pages.

JVM string functions throughout, but for character references, which Python's
own table decodes in Arrow batches.
"""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from remitra.config import values
from remitra.functions.numbers import num_en, num_eu
from remitra.functions.text import collapse
from remitra.operators.scale import top_k_per_group

DATE_PATTERNS = [r"\d{4}-\d{2}-\d{2}", r"\d{1,2}-\d{1,2}-\d{4}", r"\d{1,2}/\d{1,2}/\d{4}"]


def _inner(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescaped(rows: pd.Series) -> pd.Series:
    """Named and numeric character references of cells, decoded."""
    return rows.map(lambda cells: None if cells is None else [unescape(c) if "&" in c else c for c in cells])


def extract_rate_rows(pages: DataFrame, *carried: Column) -> DataFrame:
    """Rows of the first table of each page: text of the non-empty cells, with its position; and columns carried along."""
    table = F.regexp_extract("html", r"(?is)<table[^>]*>(.*?)</table>", 1)
    bare = F.transform(_inner(F.col("row"), "t[dh]"), lambda c: F.regexp_replace(c, "<[^>]+>", " "))
    rows = pages.select("source", "style", *carried, F.posexplode(_inner(table, "tr")).alias("row_no", "row"))
    rows = rows.withColumn("cells", _unescaped(bare)).drop("row")
    cells = F.filter(F.transform("cells", collapse), lambda c: c != "")
    return rows.withColumn("cells", cells).filter(F.size("cells") > 0)


def _code(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^([A-Z]{3})\b", 1), F.lit(""))


def parse_rate_row(rows: DataFrame) -> DataFrame:
    """(code, name, buy, sell) of each row that names a currency and at least two numbers."""
    number = lambda c: F.when(F.col("style") == "eu", num_eu(c)).otherwise(num_en(c))
    codes = F.filter(F.transform("cells", _code), lambda c: c.isNotNull())
    found = F.filter(F.transform("cells", number), lambda n: n > 0)
    label = F.filter(
        "cells", lambda c: _code(c).isNull() & number(c).isNull() & (F.length(c) > 2)
    )
    first = F.get("found", F.lit(0))
    row_number = (F.size("found") > 2) & (first < 100) & (first == F.floor(first))
    numbers = F.when(row_number, F.slice("found", 2, F.greatest(F.size("found") - 1, F.lit(0))))
    return (
        rows.withColumns({"code": F.get(codes, F.lit(0)), "found": found, "label": F.get(label, F.lit(0))})
        .withColumn("numbers", numbers.otherwise(F.col("found")))
        .filter("code IS NOT NULL AND size(numbers) >= 2")
        .select(
            *[c for c in rows.columns if c != "cells"], "code", F.coalesce("label", "code").alias("name"),
            F.get("numbers", F.lit(0)).alias("buy"), F.element_at("numbers", -1).alias("sell"),
        )
    )


def first_per_currency(rates: DataFrame) -> DataFrame:
    """The first listing of a currency counts, not a later one for small notes."""
    return top_k_per_group(rates, ["source", "code"], [F.col("row_no")], 1).drop("rn")


def page_date(html: Column) -> Column:
    """The first date on the page, in the first style that occurs at all."""
    return F.coalesce(
        *[F.nullif(F.regexp_extract(html, f"({p})", 1), F.lit("")) for p in DATE_PATTERNS], F.lit("")
    )


def sane_sources(
    rates: DataFrame, low: float = values.PUBLISHED_USD_MIN, high: float = values.PUBLISHED_USD_MAX,
) -> DataFrame:
    """Sources whose dollar rate is plausible; the others are dropped whole."""
    plausible = (F.col("code") == "USD") & F.col("buy").between(low, high) & F.col("sell").between(low, high)
    of_source = W.partitionBy("source")  # a source lists some dozens of currencies
    return rates.withColumn("_sane", F.max(plausible).over(of_source)).filter("_sane").drop("_sane")


def rates_table(pages: DataFrame) -> DataFrame:
    """All plausible rates, with the page's date, in one pass over the pages."""
    rows = extract_rate_rows(pages, F.col("url"), page_date(F.col("html")).alias("date"))
    return sane_sources(first_per_currency(parse_rate_row(rows))).select(
        "source", "date", "url", "code", "name", "buy", "sell"
    )
