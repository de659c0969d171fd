"""The canonical transaction schema."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _MONEY, _TIME, _YEAR = T.StringType(), T.DoubleType(), T.TimestampNTZType(), T.LongType()

# Canonical column names, in their published order.
COLUMNS = [
    "Hash_ID", "Banks", "Users", "Date_of_Transaction", "Date_of_Submission",
    "Reference_Number", "Transferor_Code", "Transferor_Name", "Transferor_Address",
    "Transferor_Contact_Number", "Supporting_Documents", "Document_Number",
    "Transferor_Business_Number", "Transferor_TIN", "TransferorName_AccountNumber",
    "BOL_License", "Relationship_Recipient", "LSIC_Code", "Recipient_Code",
    "Recipient_Name", "Recipient_Address", "Recipient_Contact_Number",
    "Recipient_Business_Number", "Recipient_TIN", "RecipientName_ AccountNumber",
    "Purpose_Code", "Purpose_Name", "Country_Code", "Transfer_Method",
    "Currency_Code", "Amount_Transferred", "Exchange_Rates_Kip", "Amount_Kip",
    "Exchange_Rates_USD", "Amount_USD", "Transfer_Fee", "Additional_Information",
    "Code_New_Confirm", "Pur_2", "Pur_5", "Month_Year", "Move_Fund", "M2", "Use",
    "Flow", "Source_Year", "Source_File",
]
MONEY_COLUMNS = {
    "Amount_Transferred", "Exchange_Rates_Kip", "Amount_Kip",
    "Exchange_Rates_USD", "Amount_USD", "Transfer_Fee",
}
TIME_COLUMNS = {"Date_of_Transaction", "Date_of_Submission", "Month_Year"}


def column_type(name: str) -> T.DataType:
    if name in MONEY_COLUMNS:
        return _MONEY
    if name in TIME_COLUMNS:
        return _TIME
    return _YEAR if name == "Source_Year" else _TEXT


CANONICAL = T.StructType([T.StructField(name, column_type(name)) for name in COLUMNS])
