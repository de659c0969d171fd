"""The one cleaning layer: bank extracts to transaction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.config import values
from remitra.functions.dates import day_key, lag_days, month_key
from remitra.functions.text import blank_to_null, upper_code

TEXT_COLUMNS = {
    "bank": "Banks", "ref": "Reference_Number", "purpose_name": "Purpose_Name",
    "method_raw": "Transfer_Method", "lsic": "LSIC_Code", "tr_name": "Transferor_Name",
    "rc_name": "Recipient_Name", "tr_tin": "Transferor_TIN", "rc_tin": "Recipient_TIN",
    "docs": "Supporting_Documents",
}


def clean_text_columns() -> dict[str, Column]:
    """Trimmed text, blank to NULL; only the purpose code turns NULL into blank."""
    columns = {name: blank_to_null(F.col(source)) for name, source in TEXT_COLUMNS.items()}
    columns["pur5"] = F.coalesce(blank_to_null(F.col("Pur_5")), F.lit(""))
    columns["country"] = upper_code(F.col("Country_Code"))
    columns["currency"] = upper_code(F.col("Currency_Code"))
    return columns


def flow_year_columns() -> dict[str, Column]:
    """The filed direction and year win over the folder and the transaction date."""
    return {
        "flow": F.coalesce(blank_to_null(F.col("Flow")), F.col("_flow")),
        "yr": F.coalesce(F.col("Source_Year"), F.year("Date_of_Transaction").cast("long")),
    }


def yes_flags() -> dict[str, Column]:
    """Three-valued: NULL where the bank filed nothing."""
    return {
        "use_flag": F.col("Use") == "Yes",
        "m2_flag": F.col("M2") == "Yes",
        "move_flag": F.col("Move_Fund") == "Yes",
    }


def quality_flags(
    fx_min: float = values.FX_MIN, fx_max: float = values.FX_MAX, late: int = values.LATE_DAYS,
) -> dict[str, Column]:
    fx, usd = F.col("Exchange_Rates_USD"), F.col("Amount_USD")
    filed, done = F.col("Date_of_Submission"), F.col("Date_of_Transaction")
    return {
        "bad_fx": fx.isNull() | (fx < fx_min) | (fx > fx_max),
        "null_amt": usd.isNull(),
        "zero_amt": usd == 0,
        "neg_amt": usd < 0,
        "future_dated": filed < done,
        "late_sub": lag_days(done, filed) > late,
    }


def drop_undated(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("Date_of_Transaction").isNotNull())


def clean(raw: DataFrame, usd_band: tuple[float, float] = (values.FX_MIN, values.FX_MAX)) -> DataFrame:
    """Raw rows of either direction to the columns every report reads."""
    done, filed = F.col("Date_of_Transaction"), F.col("Date_of_Submission")
    columns = {
        "Hash_ID": F.col("Hash_ID"),
        **flow_year_columns(),
        "tx_date": done,
        "ym": month_key(done),
        "ymd": day_key(done),
        "sub_date": filed,
        "lag_days": lag_days(done, filed),
        **clean_text_columns(),
        "amt_orig": F.col("Amount_Transferred"),
        "usd": F.col("Amount_USD"),
        "kip": F.col("Amount_Kip"),
        "fx": F.col("Exchange_Rates_USD"),
        "fxkip": F.col("Exchange_Rates_Kip"),
        "Source_File": F.col("Source_File"),
        **yes_flags(),
        **quality_flags(*usd_band),
    }
    return drop_undated(raw).select(*[c.alias(name) for name, c in columns.items()])


def flow_ix(flow: Column) -> Column:
    return F.when(flow == "Payment", 0).otherwise(1)


def flag_ix(flag: Column) -> Column:
    return F.when(flag, 1).otherwise(0)


def with_flow_use_ix(tx: DataFrame) -> DataFrame:
    return tx.withColumns({"flow_ix": flow_ix(F.col("flow")), "use_ix": flag_ix(F.col("use_flag"))})
