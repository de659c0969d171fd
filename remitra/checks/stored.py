"""Cubes of a store of which one year was sent again, against the cubes of all rows at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitra.checks import results  # noqa: F401
from remitra.checks.intake import CLEAN_BANK, KEPT, XLSX, hash_sql
from remitra.checks.registry import ORACLES, add
from remitra.checks.sql import PRELUDE
from remitra.functions.numbers import r2
from remitra.operators import cubes as C
from remitra.sources.pack import Pack

CUBES = {
    "month": "C1_month", "country": "C2_country", "currency": "C3_currency", "bank": "C4_bank", "purpose": "C5_purpose", "method": "C6_method",
    "size": "C7_size", "ts_bank": "C8_ts_bank", "ts_country": "C9_ts_country", "ts_currency": "C10_ts_currency", "ts_purpose": "C11_ts_purpose",
    "ts_line": "C12_ts_line", "day_line": "C13_day_line", "day_bank": "C14_day_bank", "day_currency": "C16_day_currency", "day_goods": "C17_day_goods",
    "cross_country_currency": "C18_cross_country_currency", "cross_country_sector": "C19_cross_country_sector",
    "cross_country_line": "C20_cross_country_line", "cross_currency_sector": "C21_cross_currency_sector",
    "cross_currency_line": "C22_cross_currency_line", "cross_sector_line": "C23_cross_sector_line", "quality": "C25_quality",
    "completeness": "C26_completeness", "flags": "C28_flags", "fx_by_year_bank": "X1_fx_by_year_bank",
}
_NO_COUNT = {"day_currency", "day_goods", "fx_by_year_bank"}
_NO_VALUE = {"quality", "completeness", "fx_by_year_bank"}


def _sql(name: str) -> str:
    return ORACLES[CUBES[name]].removeprefix(PRELUDE)


def _sums(ws):
    """Rows, counts and value of every additive cube."""
    whole = None
    for name, df in ws.replaced.additive_cubes().items():
        if name not in CUBES:
            continue
        if name == "day_currency":  # its statement keeps the three largest
            df = C.day_currency(ws.replaced.day, ws.replaced.dims, top=3)
        n = F.lit(None).cast("long") if name in _NO_COUNT else F.sum("n").cast("long")
        usd = F.lit(None).cast("double") if name in _NO_VALUE else r2(F.sum("usd_m"))
        part = df.agg(F.count("*").alias("rows"), n.alias("n"), usd.alias("usd_m")).select(F.lit(name).alias("cube"), "*")
        whole = part if whole is None else whole.unionByName(part)
    return whole


add("S7_replaced_year_sums", _sums, " UNION ALL ".join(
    f"""SELECT '{name}' AS cube, count(*) AS rows, CAST({'NULL' if name in _NO_COUNT else 'sum(n)'} AS BIGINT) AS n,
          CAST({'NULL' if name in _NO_VALUE else 'round(sum(usd_m), 3)'} AS DOUBLE) AS usd_m FROM ({_sql(name)})"""
    for name in CUBES))
for _name in ("month", "method", "day_bank", "day_line"):
    add(f"S7_replaced_year_{_name}", lambda ws, n=_name: ws.replaced.additive_cubes()[n], _sql(_name))


# -- from cells to cubes -----------------------------------------------------

# Imported rows as the rules and corrections leave them; header-matched ones have no flag of their own.
_CODE = {"header": "trim(Pur_5)", "position": "concat(trim(Pur_5), '01')"}


def _imported(kind: str, where: str, use: str) -> str:
    return f"""
      SELECT {hash_sql("trim(Pur_5)", CLEAN_BANK, XLSX if kind == "header" else None)} AS Hash_ID, {CLEAN_BANK} AS Banks, _flow, _flow AS Flow,
        CAST(year(Date_of_Transaction) AS BIGINT) AS Source_Year, Date_of_Transaction, Date_of_Submission, Reference_Number, Country_Code,
        Currency_Code, NULL::VARCHAR AS Purpose_Name, NULL::VARCHAR AS Transfer_Method, NULL::VARCHAR AS LSIC_Code, Transferor_Name,
        Recipient_Name, NULL::VARCHAR AS Transferor_TIN, NULL::VARCHAR AS Recipient_TIN, NULL::VARCHAR AS Supporting_Documents,
        Amount_Transferred, NULL::DOUBLE AS Amount_Kip, coalesce(o.amount, round(Amount_USD, 2)) AS Amount_USD, NULL::DOUBLE AS Exchange_Rates_Kip,
        NULL::DOUBLE AS Exchange_Rates_USD, NULL::VARCHAR AS M2, NULL::VARCHAR AS Move_Fund, 'x' AS Source_File, row_no,
        coalesce(o.purpose, CASE WHEN starts_with({_CODE[kind]}, '050104') THEN '0404' ELSE {_CODE[kind]} END) AS final, {use} AS Use
      FROM (SELECT * FROM {KEPT.replace("raw WHERE", "filed AS raw WHERE")}) f
      LEFT JOIN (SELECT flow AS of_flow, row_no AS of_row, purpose, amount FROM overrides) o ON of_flow = _flow AND of_row = row_no
      WHERE {where}"""


_RULED_USE = "CASE WHEN final = '050103' THEN 'FX' WHEN final[:6] IN ('050103', '050104', '050204') THEN 'No' ELSE 'Yes' END"
_WHOLE = PRELUDE.replace("WITH\nraw AS (", "WITH\nfiled AS (", 1).replace("\nspellings AS (", f"""
imports AS ({_imported("header", "year(Date_of_Transaction) <= 1998", "NULL::VARCHAR")}
      UNION ALL {_imported("position", "year(Date_of_Transaction) >= 1999", "Use")}),
raw AS (SELECT * REPLACE (coalesce(Use, {_RULED_USE}) AS Use), final[:6] AS Pur_5 FROM imports),
spellings AS (""", 1)
for _name in ("month", "ts_line"):
    add(f"I23_cells_to_{_name}", lambda ws, n=_name: Pack(ws.spark, ws.whole_run).read(n), None)
    ORACLES[f"I23_cells_to_{_name}"] = _WHOLE + _sql(_name)
