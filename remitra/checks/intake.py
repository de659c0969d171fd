"""Readers, writers, bulk imports and rate pages."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import functions as F

from remitra.checks.inputs import EN_HEADERS, LO_HEADERS
from remitra.checks.registry import add
from remitra.checks.sql import bank_key, collapse, r2, strip, usd_m
from remitra.config import headers as H
from remitra.config import loader
from remitra.functions import numbers, text
from remitra.operators import dims as D
from remitra.operators import imports as I
from remitra.operators import exceptions as X
from remitra.operators import rates as K
from remitra.operators import rules as R
from remitra.operators.clean import clean
from remitra.session import shared_dir, stage
from remitra.sources import files, sinks

# -- sources -----------------------------------------------------------------


def _paths(ws, flow, suffix):
    return [p for p in files.discover(ws.spark, ws.root, flow) if p.endswith(suffix)]


def _discovered(ws):
    """The data sets found, each with the rows it holds."""
    whole = None
    for flow in ("Payment", "Receive"):
        for path in files.discover(ws.spark, ws.root, flow):
            part = files.read_flow(ws.spark, [path]).rows.agg(F.count("*").alias("n")).select(
                F.lit(flow).alias("flow"), F.lit(path.rsplit("/", 1)[-1]).alias("name"), "n"
            )
            whole = part if whole is None else whole.unionByName(part)
    return whole


_YEAR = "year(Date_of_Transaction)"
_PART = f"CASE WHEN {_YEAR} <= 1997 THEN 'early.parquet' WHEN {_YEAR} <= 2000 THEN 'middle.parquet' ELSE 'late.csv' END"
add("S1_discover", _discovered,
    f"SELECT _flow AS flow, {_PART} AS name, count(*) AS n FROM raw GROUP BY ALL")
add("S2_parquet_union",
    lambda ws: files.read_parquet_canonical(
        ws.spark, _paths(ws, "Payment", ".parquet") + _paths(ws, "Receive", ".parquet")
    ).rows.select("Hash_ID", "Date_of_Transaction", "Amount_USD", "Use", "M2", "Move_Fund", "Source_Year"),
    f"""SELECT Hash_ID, Date_of_Transaction, Amount_USD, Use, CASE WHEN {_YEAR} > 1997 THEN M2 END AS M2,
          CASE WHEN {_YEAR} > 1997 THEN Move_Fund END AS Move_Fund, Source_Year
        FROM raw WHERE {_YEAR} <= 2000""")
add("S3_csv",
    lambda ws: files.read_csv_canonical(
        ws.spark, _paths(ws, "Payment", ".csv") + _paths(ws, "Receive", ".csv")
    ).rows.select("Hash_ID", text.blank_to_null(F.col("Banks")).alias("bank"), "Date_of_Transaction",
                  "Date_of_Submission", "Amount_USD", "Exchange_Rates_Kip", "Source_Year", "Use", "Additional_Information"),
    f"""SELECT Hash_ID, nullif(trim(Banks), '') AS bank, Date_of_Transaction, Date_of_Submission,
          Amount_USD, Exchange_Rates_Kip, Source_Year, Use, CASE WHEN row_no % 3 = 0 THEN concat('paid "in full",', chr(10),
            'see ', row_no, chr(10), chr(10), '"', row_no, '"', chr(10), ', end') ELSE CAST(row_no AS VARCHAR) END AS Additional_Information
        FROM raw WHERE {_YEAR} > 2000""")
add("S4_union_flows",
    lambda ws: clean(files.union_flows(ws.spark, ws.root)).select(
        "Hash_ID", "flow", "yr", "ym", "bank", "usd", "move_flag", "use_flag"),
    f"""SELECT t.Hash_ID, flow, yr, ym, bank, usd, use_flag,
          CASE WHEN year(tx_date) > 1997 THEN move_flag END AS move_flag FROM tx_all t""")


def _filed(ws):
    return files.read_flows(ws.spark, ws.filed_root)


# What was filed where a typed cell held something else, and how often.
_LOST = """SELECT field, filed, count(*) AS n FROM (
    SELECT 'Date_of_Transaction' AS field, CASE WHEN row_no % 13 = 0 THEN 'pending' WHEN row_no % 29 = 0 THEN '31/02/1998' END AS filed FROM raw
    UNION ALL SELECT 'Date_of_Submission', CASE WHEN row_no % 31 = 0 THEN 'soon' END FROM raw
    UNION ALL SELECT 'Amount_USD', CASE WHEN row_no % 10 = 3 THEN '1,234.50' END FROM raw
    UNION ALL SELECT 'Exchange_Rates_Kip', CASE WHEN row_no % 17 = 0 THEN concat('n/a', chr(10), '(see note)') END FROM raw
    UNION ALL SELECT 'Source_Year', CASE WHEN row_no % 19 = 0 THEN 'FY98' END FROM raw)
  WHERE filed IS NOT NULL GROUP BY ALL"""
add("S12_rejects", lambda ws: _filed(ws).rejects.groupBy("field", "filed").agg(F.count("*").alias("n")), _LOST)
add("S12_kept_beside_rejects",
    lambda ws: _filed(ws).rows.select("Hash_ID", "Date_of_Transaction", "Date_of_Submission", "Amount_USD", "Exchange_Rates_Kip", "Source_Year"),
    """SELECT Hash_ID, CASE WHEN row_no % 13 <> 0 AND row_no % 29 <> 0 THEN Date_of_Transaction END AS Date_of_Transaction,
         CASE WHEN row_no % 31 <> 0 THEN Date_of_Submission END AS Date_of_Submission,
         CASE WHEN row_no % 10 <> 3 AND row_no % 37 <> 0 THEN Amount_USD END AS Amount_USD,
         CASE WHEN row_no % 17 <> 0 THEN Exchange_Rates_Kip END AS Exchange_Rates_Kip,
         CASE WHEN row_no % 19 <> 0 THEN Source_Year END AS Source_Year FROM raw""")
add("U1_union_by_name",
    lambda ws: files.union_by_name([
        ws.raw.filter(f"_flow = '{flow}'").select("Hash_ID", "Banks", extra)
        for flow, extra in (("Payment", "Transferor_Name"), ("Receive", "Recipient_Name"))
    ]),
    """SELECT Hash_ID, Banks, CASE _flow WHEN 'Payment' THEN Transferor_Name END AS Transferor_Name,
         CASE _flow WHEN 'Receive' THEN Recipient_Name END AS Recipient_Name FROM raw""")
add("S5_load_reference",
    lambda ws: files.load_reference(
        files.union_flows(ws.spark, ws.root).withColumn("Source_Year", F.year("Date_of_Transaction")), 1999
    ).groupBy("Transfer_Method", "Pur_5", "Move_Fund").agg(F.count("*").alias("n")),
    f"""SELECT Transfer_Method, Pur_5, Move_Fund, count(*) AS n FROM raw WHERE {_YEAR} = 1999
        GROUP BY ALL""")


def _out(ws, name):
    return f"{shared_dir(ws.spark)}/out/{name}-{uuid.uuid4().hex}"


# An override folder: two aliases, and rules, duplicate keys and bands that differ from the built-in ones.
_OVERRIDES = {
    "bank_aliases.json": {"aliases": {"Bank 1": "BANK-0", "bank2": "Bank0"}},
    "bop_rules.json": {
        "purposeTransform": {"rules": [
            {"id": "keep_bcel", "bank": "BCEL", "purposePrefix": ["05"], "action": "keep"},
            {"id": "financial_to_0601", "flow": "Receive", "purposePrefix": ["05"], "action": "set", "to": "0601", "why": "test"},
            {"id": "korea", "bank": "!OPD", "country": "KR", "sectorPrefix": ["03"], "action": "set", "to": "0301"},
        ]},
        "m2Flag": {"forceYes": [{"flow": "Payment", "purposeEquals": ["0404"]}],
                   "setNo": [{"bank": ["LDB", "BOC"], "purposePrefix": ["01", "02"]}, {"nameContains": ["moneygram"]}]},
        "useFlag": {"rules": [
            {"value": "Cash_{bank}", "anyOf": [{"purposePrefix": ["07"]}, {"bank": "OPD", "remarkContains": ["loan", "move"]}]},
            {"value": "No", "flow": "Payment", "country": "TH"}, {"value": "Yes", "default": True}]},
        "duplicates": {"tierA": {"keys": ["bank", "reference", "currency"], "minReferenceLength": 3},
                       "tierD": {"keys": ["flow", "date", "purpose", "transferorName"], "requireNames": True}},
        "exchangeRate": {"bands": {"usd": {"min": 21100, "max": 22000}, "THB": {"min": 600, "max": 652.5, "note": "x"}},
                         "usdPerUsdBand": {"min": 20500, "max": 23000}},
    },
}


def _override_folder(ws):
    folder = _out(ws, "config")
    for name, document in _OVERRIDES.items():
        ws.spark.range(1).select(F.lit(json.dumps(document))).coalesce(1).write.text(f"{folder}/{name}")
    return loader.load_config(folder, ws.spark)


def _configured(ws):
    """Bank groups under aliases that come from an override folder."""
    return D.dim_banks(ws.base, _override_folder(ws)).select("bank", "key")


add("S6_load_config", _configured,
    f"""SELECT bank, CASE WHEN k IN ('BANK1', 'BANK2') THEN 'BANK0' ELSE k END AS key
        FROM (SELECT DISTINCT bank, {bank_key('bank')} AS k FROM tx WHERE bank IS NOT NULL)""")


_EDITED = """(SELECT *, CASE WHEN bank = 'BCEL' AND starts_with(purpose, '05') THEN purpose
      WHEN flow = 'Receive' AND starts_with(purpose, '05') THEN '0601'
      WHEN coalesce(bank, '') <> 'OPD' AND country = 'KR' AND starts_with(sector, '03') THEN '0301' ELSE purpose END AS final_purpose FROM rules)"""
add("S6_edited_rules",
    lambda ws: R.classify(ws.rules, _override_folder(ws).rules).select("id", "final_purpose", "m2_rule", "use_rule"),
    f"""SELECT id, final_purpose,
          CASE WHEN flow = 'Payment' AND final_purpose = '0404' THEN 'Yes'
            WHEN bank IN ('LDB', 'BOC') AND final_purpose[:2] IN ('01', '02') THEN 'No'
            WHEN contains(upper(name), 'MONEYGRAM') THEN 'No' ELSE 'Yes' END AS m2_rule,
          CASE WHEN starts_with(final_purpose, '07') OR (bank = 'OPD' AND (contains(upper(remark), 'LOAN') OR contains(upper(remark), 'MOVE')))
              THEN concat('Cash_', coalesce(bank, ''))
            WHEN flow = 'Payment' AND country = 'TH' THEN 'No' ELSE 'Yes' END AS use_rule
        FROM {_EDITED}""")


def _edited_tiers(ws):
    whole = None
    for name, tier in _override_folder(ws).rules.tiers.items():
        part = X.dup_summary(X.dup_tier(ws.tx_all, **tier)).select(F.lit(name).alias("tier"), "*")
        whole = part if whole is None else whole.unionByName(part)
    return whole


add("S6_edited_tiers", _edited_tiers,
    " UNION ALL ".join(
        f"""SELECT '{tier}' AS tier, count(*) AS groups, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS extra, {usd_m('usd * (c - 1) / c')} AS usd_m
            FROM (SELECT count(*) AS c, sum(usd) AS usd FROM tx_all WHERE {where} GROUP BY {keys} HAVING count(*) > 1)"""
        for tier, keys, where in (("A", "bank, ref, currency, yr", "length(ref) >= 3"),
                                  ("D", "flow, ymd, pur5, tr_name, yr", "tr_name IS NOT NULL AND rc_name IS NOT NULL"))))
add("S6_edited_bands",
    lambda ws: X.rate_band_check(ws.tx, _override_folder(ws)).groupBy("currency", "kind").agg(F.count("*").alias("n")).unionByName(
        clean(ws.raw, _override_folder(ws).rules.usd_band).filter("bad_fx").select(
            F.lit("LAK per USD").alias("currency"), F.lit("bad").alias("kind")).groupBy("currency", "kind").agg(F.count("*").alias("n"))),
    """SELECT currency, kind, count(*) AS n FROM (
         SELECT currency, CASE WHEN fxkip = 0 THEN 'zero' WHEN fxkip < low THEN 'low' WHEN fxkip > high THEN 'high' END AS kind
         FROM tx JOIN (VALUES ('USD', 21100, 22000), ('THB', 600, 652.5)) AS b(currency, low, high) USING (currency)
         UNION ALL SELECT 'LAK per USD', 'bad' FROM tx_all WHERE fx IS NULL OR fx < 20500 OR fx > 23000)
       WHERE kind IS NOT NULL GROUP BY ALL""")


def _rules_shown(ws):
    """Rules in force with the number of each section, and the words of one."""
    frame = loader.rules_frame(ws.spark, _override_folder(ws))
    return ws.rules.groupBy("bank").agg(F.count("*").alias("n")).join(
        frame.filter("section = 'purpose'").select("position", F.get_json_object("declared", "$.bank").alias("bank")), "bank")


add("S6_rules_in_force", _rules_shown,
    "SELECT bank, count(*) AS n, 0 AS position FROM rules WHERE bank = 'BCEL' GROUP BY bank")


def _canonical(ws):
    return ws.raw.withColumns({
        "Flow": F.col("_flow"), "Source_Year": F.year("Date_of_Transaction").cast("long"),
    })


def _years(ws):
    """All years, then one of them again with half its rows: only that one is replaced."""
    path = _out(ws, "years")
    sinks.write_year(_canonical(ws), path)
    sinks.write_year(_canonical(ws).filter("Source_Year = 1998 AND row_no % 2 = 0"), path)
    return ws.spark.read.parquet(path).groupBy("Flow", F.col("Source_Year").cast("long")).agg(
        F.count("*").alias("n"), numbers.r2(numbers.millions(F.sum("Amount_USD"))).alias("usd_m"))


add("S7_write_year", _years,
    f"""SELECT _flow AS Flow, {_YEAR} AS Source_Year, count(*) AS n, {usd_m('Amount_USD')} AS usd_m
        FROM raw WHERE {_YEAR} <> 1998 OR row_no % 2 = 0 GROUP BY ALL""")


def _typed(ws):
    path = _out(ws, "typed")
    sinks.write_typed(ws.raw.withColumn("Source_Year", F.lit("1999")), path)
    return ws.spark.read.parquet(path).select(
        "Hash_ID", "Source_Year", "Date_of_Submission", "Amount_Kip", "Use")


add("S8_write_typed", _typed,
    """SELECT Hash_ID, CAST(1999 AS BIGINT) AS Source_Year, Date_of_Submission, Amount_Kip, Use
       FROM raw""")


def _pack(ws):
    """Rows of each published table, read back from the pack."""
    path = _out(ws, "pack")
    cubes = ws.cubes()
    sinks.write_payload({n: cubes[n] for n in ("bank", "flags", "size", "source_stats")}, path, True)
    pack = sinks.read_payload(ws.spark, path)
    parsed = F.from_json("row", "n long, usd_m double")
    return pack.groupBy(F.col("table")).agg(
        F.count("*").alias("rows"), F.sum(parsed["n"]).alias("n"))


add("S9_payload", _pack,
    """SELECT 'bank' AS "table", count(*) AS rows, CAST(sum(n) AS BIGINT) AS n FROM (
         SELECT count(*) AS n FROM tx JOIN banks USING (bank) GROUP BY yr, flow_ix, bank_ix, use_ix)
       UNION ALL SELECT 'flags', count(*), CAST(sum(n) AS BIGINT) FROM (
         SELECT count(*) AS n FROM tx GROUP BY yr, flow_ix, use_ix, coalesce(m2_flag, FALSE),
           coalesce(move_flag, FALSE))
       UNION ALL SELECT 'size', count(*), CAST(sum(n) AS BIGINT) FROM (
         SELECT count(*) AS n FROM tx WHERE usd > 0 GROUP BY yr, flow_ix, use_ix,
           CASE WHEN usd < 1e3 THEN 0 WHEN usd < 1e4 THEN 1 WHEN usd < 1e5 THEN 2
             WHEN usd < 1e6 THEN 3 WHEN usd < 1e7 THEN 4 ELSE 5 END)
       UNION ALL SELECT 'source_stats', count(*), CAST(sum(n) AS BIGINT) FROM (
         SELECT count(*) AS n FROM tx GROUP BY Source_File)""")


def _published(ws):
    """Rates as published; an empty second run must leave them alone."""
    path = _out(ws, "rates")
    rates = K.rates_table(ws.rate_pages)
    sinks.write_rates(rates, path)
    sinks.write_rates(rates.filter("code = 'none'"), path)
    return sinks.read_rates(ws.spark, path).select("source", "code", "buy", "sell")


_BUY = "(14000 + (page_id * 137) % 30000)"
_SANE = f"{_BUY} >= 15000 AND {_BUY} + 100 <= 40000"
_USD_THB = f"""SELECT page_id, 'USD' AS code, 'US Dollar' AS name, CAST({_BUY} AS DOUBLE) AS buy,
    CAST({_BUY} + 100 AS DOUBLE) AS sell, 1 AS row_no FROM pages
  UNION ALL SELECT page_id, 'THB', 'Thai Baht', 673.2, 686.07, 3 FROM pages
  UNION ALL SELECT page_id, 'CNY', 'Yuan – Rénminbi', 4, 2900, 4 FROM pages"""
add("S10_write_rates", _published,
    f"""SELECT CAST(page_id AS VARCHAR) AS source, code, buy, sell FROM ({_USD_THB})
        WHERE {_SANE}""")

_FILE = f"""concat('money_transfer_', CASE _flow WHEN 'Payment' THEN 'out' ELSE 'in' END, '_detail_',
  {_YEAR}, CASE WHEN row_no % 5 = 0 THEN '.csv' ELSE '.xlsx' END)"""


def _directions(ws):
    word = F.when(F.col("_flow") == "Payment", "out").otherwise("in")
    suffix = F.when(F.col("row_no") % 5 == 0, ".csv").otherwise(".xlsx")
    rows = ws.raw.select(
        "row_no", "Hash_ID",
        F.concat(F.lit("money_transfer_"), word, F.lit("_detail_"), F.year("Date_of_Transaction"),
                 suffix).alias("file"),
        F.when(F.col("row_no") % 2 == 0, "Recieve").when(F.col("row_no") % 3 == 0, "Payment")
        .otherwise("Notes").alias("sheet"),
    )
    return rows.select("Hash_ID", "file", files.direction_of(F.col("file"), F.col("sheet")).alias("flow"))


add("S11_direction_of", _directions,
    f"""SELECT Hash_ID, {_FILE} AS file, CASE WHEN row_no % 5 <> 0 THEN _flow
          WHEN row_no % 2 = 0 THEN 'Receive' WHEN row_no % 3 = 0 THEN 'Payment' END AS flow FROM raw""")

# -- text and number parsing over whole texts --------------------------------


def _digest(c):
    return F.md5(c.cast("binary"))


add("I1_norm_header",
    lambda ws: ws.table("documents").select("doc_id", _digest(text.norm_header(F.col("text"))).alias("digest")),
    f"SELECT doc_id, md5(lower({collapse('text')})) AS digest FROM documents")
_QUOTED = "concat(chr(9), '''', chr(160), text, chr(12288), chr(10))"


def _quoted():
    return F.concat(F.lit("\t' "), F.col("text"), F.lit("　\n"))


add("I5_clean_text",
    lambda ws: ws.table("documents").select("doc_id", _digest(text.clean_text(_quoted())).alias("digest")),
    f"SELECT doc_id, md5({strip('text')}) AS digest FROM documents")
add("I6_clean_text_plain",
    lambda ws: ws.table("documents").select(
        "doc_id", _digest(text.clean_text(_quoted(), apostrophe=False)).alias("digest")),
    f"SELECT doc_id, md5({strip(_QUOTED)}) AS digest FROM documents")


def _numbers(ws, commas):
    kind = F.col("row_no") % 7
    cell = (
        F.when(kind == 0, F.lit("n/a")).when(kind == 1, F.lit("")).when(kind == 2, F.lit("12d"))
        .when(kind == 3, F.concat(F.lit(" "), F.col("row_no").cast("string"), F.lit(".5 ")))
        .when(kind == 4, F.lit("-1.5e3")).otherwise(F.format_number("Amount_Transferred", 2))
    )
    return ws.raw.select("Hash_ID", numbers.to_num(cell, commas).alias("x"))


_PARSED = """SELECT Hash_ID, CASE row_no % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL
  WHEN 3 THEN row_no + 0.5 WHEN 4 THEN -1500.0 ELSE {rest} END::DOUBLE AS x FROM raw"""
add("I7_to_num", lambda ws: _numbers(ws, True), _PARSED.format(rest="Amount_Transferred"))
add("I8_to_num_plain", lambda ws: _numbers(ws, False),
    _PARSED.format(rest="CASE WHEN Amount_Transferred < 1000 THEN Amount_Transferred END"))

# -- header-matched import ---------------------------------------------------

_ROWS = "raw WHERE NOT Hash_ID LIKE '%-r'"
XLSX = f"concat('money_transfer_', CASE _flow WHEN 'Payment' THEN 'out' ELSE 'in' END, '_detail_', {_YEAR}, '.xlsx')"


def _headers(ws):
    known = I.known_headers(ws.cells)
    return known, I.find_header_row(known)


add("I2_find_header_row", lambda ws: _headers(ws)[1],
    f"SELECT DISTINCT {XLSX} AS file, 'Sheet1' AS sheet, CAST(2 AS BIGINT) AS header_row FROM {_ROWS}")
add("I2_refused_files", lambda ws: I.refused_files(ws.cells, _headers(ws)[1]),
    """SELECT DISTINCT 'five_headers.xlsx' AS file, 'Sheet1' AS sheet FROM raw
       WHERE NOT Hash_ID LIKE '%-r' AND row_no % 100 = 11""")
_PLACES = ", ".join(
    f"('{flow}', '{field}', {pos})"
    for flow, layout in (("Payment", EN_HEADERS), ("Receive", LO_HEADERS))
    for pos, (field, _) in enumerate(layout) if field
)
add("I3_resolve_columns", lambda ws: I.resolve_columns(*_headers(ws)),
    f"""SELECT file, 'Sheet1' AS sheet, CAST(2 AS BIGINT) AS header_row, field, pos
        FROM (SELECT DISTINCT {XLSX} AS file, _flow FROM {_ROWS})
        JOIN (VALUES {_PLACES}) AS places(flow, field, pos) ON flow = _flow""")


def _mapped(ws):
    maps = stage(I.column_maps(I.resolve_columns(*_headers(ws))), "column_maps")
    return I.map_headers(ws.cells, maps)


_UNDATED = "row_no % 13 = 0"
CLEAN_BANK = "nullif(trim(Banks), '')"
KEPT = f"{_ROWS} AND NOT {_UNDATED} AND {CLEAN_BANK} IS NOT NULL"


def _book(ws):
    """Both sheets, mapped by position and brought to common columns."""
    sheets = [I.map_positions(ws.book, s) for s in H.SHEET_POSITIONS]
    return files.union_by_name(sheets)


add("I4_map_positions",
    lambda ws: _book(ws).select(
        "sheet", "row_no", "Banks", "Date_of_Transaction", "Recipient_Name", "LSIC_Code",
        "Amount_USD", "Code_New_Confirm", "Pur_2"),
    f"""SELECT CASE _flow WHEN 'Receive' THEN 'Recieve' ELSE _flow END AS sheet, row_no,
          {CLEAN_BANK} AS Banks, CASE WHEN NOT {_UNDATED} THEN Date_of_Transaction END
            AS Date_of_Transaction, Recipient_Name, LSIC_Code, round(Amount_USD, 2) AS Amount_USD,
          concat(trim(Pur_5), '01') AS Code_New_Confirm,
          CASE WHEN row_no % 3 = 0 THEN nullif(trim(Pur_5[:2]), '') END AS Pur_2 FROM {_ROWS}""")
add("I9_skip_report", lambda ws: I.skip_report(_mapped(ws)),
    f"""SELECT file, 'Sheet1' AS sheet, outcome, count(*) AS n FROM (
          SELECT {XLSX} AS file, CASE WHEN {_UNDATED} THEN 'undated' WHEN {CLEAN_BANK} IS NULL
            THEN 'template' ELSE 'kept' END AS outcome FROM {_ROWS}
          UNION ALL SELECT DISTINCT {XLSX}, 'template' FROM {_ROWS}) GROUP BY ALL""")
_LOW, _HIGH = date(1997, 3, 1), date(1999, 6, 30)
add("I10_date_range",
    lambda ws: I.skip_report(_book(ws), _LOW, _HIGH),
    f"""SELECT 'database.xlsm' AS file, CASE _flow WHEN 'Receive' THEN 'Recieve' ELSE _flow END AS sheet,
          CASE WHEN {_UNDATED} THEN 'undated'
               WHEN Date_of_Transaction::DATE NOT BETWEEN DATE '{_LOW}' AND DATE '{_HIGH}' THEN 'out_of_range'
               WHEN {CLEAN_BANK} IS NULL THEN 'template' ELSE 'kept' END AS outcome, count(*) AS n
        FROM {_ROWS} GROUP BY ALL""")


def _coded(ws):
    return ws.raw.withColumn("Purpose_Code", F.nullif(F.trim("Pur_5"), F.lit(""))).select(
        "Hash_ID", "row_no", "Purpose_Code",
        F.when(F.col("row_no") % 3 == 0, "77").alias("Pur_2"),
        F.concat(F.trim("Pur_5"), F.lit("0305")).alias("Confirmed"),
        F.when(F.col("row_no") % 4 == 0, F.col("Purpose_Name")).alias("Purpose_Name"),
    )


add("I11_derive_purpose",
    lambda ws: I.derive_purpose(_coded(ws)).select("Hash_ID", "Code_New_Confirm", "Pur_5", "Pur_2"),
    """SELECT Hash_ID, trim(Pur_5) AS Code_New_Confirm, nullif(trim(Pur_5), '') AS Pur_5,
         nullif(trim(Pur_5)[:2], '') AS Pur_2 FROM raw""")
add("I11_derive_purpose_confirmed",
    lambda ws: I.derive_purpose(_coded(ws), "Confirmed", keep_pur2=True).select(
        "Hash_ID", "Code_New_Confirm", "Pur_5", "Pur_2"),
    """SELECT Hash_ID, concat(trim(Pur_5), '0305') AS Code_New_Confirm,
         concat(trim(Pur_5), '0305')[:6] AS Pur_5,
         CASE WHEN row_no % 3 = 0 THEN '77' ELSE concat(trim(Pur_5), '0305')[:2] END AS Pur_2
       FROM raw""")
_OFFICIAL = {"010107": {"lo": "ແຮ່ທາດ"}, "020101": {"lo": "ຂົນສົ່ງ"}, "990101": {"en": "x"}}


def _official(ws):
    return loader.purpose_name_frame(ws.spark, loader.Config(purpose_names=_OFFICIAL))


_LO_NAME = "CASE trim(Pur_5) WHEN '010107' THEN 'ແຮ່ທາດ' WHEN '020101' THEN 'ຂົນສົ່ງ' END"
add("I12_purpose_name",
    lambda ws: I.purpose_name(I.derive_purpose(_coded(ws)), _official(ws)).select("Hash_ID", "Purpose_Name"),
    f"""SELECT Hash_ID, coalesce(CASE WHEN row_no % 4 = 0 THEN Purpose_Name END, {_LO_NAME})
          AS Purpose_Name FROM raw""")
add("I12_purpose_name_official",
    lambda ws: I.purpose_name(I.derive_purpose(_coded(ws)), _official(ws), keep_filed=False).select(
        "Hash_ID", "Purpose_Name"),
    f"SELECT Hash_ID, {_LO_NAME} AS Purpose_Name FROM raw")

_VOCAB = """SELECT lower(trim(string_split(Transfer_Method, ':')[1])) AS head,
  min(Transfer_Method) AS canonical FROM raw WHERE Transfer_Method IS NOT NULL GROUP BY 1"""
add("I13_method_vocab", lambda ws: I.method_vocab(ws.raw), _VOCAB)
add("I14_canon_method",
    lambda ws: I.canon_method(
        ws.raw.select("Hash_ID", F.concat(F.initcap("Transfer_Method"), F.lit(" : x")).alias("Transfer_Method")),
        stage(I.method_vocab(ws.raw.filter("NOT Transfer_Method LIKE 'URGENT%'")), "vocab")),
    r"""SELECT Hash_ID, CASE split_part(Transfer_Method, ':', 1) WHEN 'URGENT' THEN
           CASE WHEN Transfer_Method LIKE '%:%' THEN 'Urgent: Note : x' ELSE 'Urgent : x' END
         WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'HIGH' THEN 'HIGH' WHEN 'NOT SPECIFIED' THEN 'NOT SPECIFIED'
         END AS Transfer_Method FROM raw""")
_MODE = """SELECT Pur_5, Move_Fund AS usual FROM raw WHERE Pur_5 IS NOT NULL AND Move_Fund IS NOT NULL
  GROUP BY Pur_5, Move_Fund
  QUALIFY row_number() OVER (PARTITION BY Pur_5 ORDER BY count(*) DESC, Move_Fund) = 1"""


def _history(ws):
    """History in which some codes do not move funds."""
    usual = F.when(F.col("Pur_5").isin("010105", "030101"), "No").otherwise(F.col("Move_Fund"))
    return ws.raw.withColumn("Move_Fund", usual).filter("Pur_5 <> '050206'")


_MODE_HISTORY = """SELECT Pur_5, usual FROM (SELECT Pur_5,
    CASE WHEN Pur_5 IN ('010105', '030101') THEN 'No' ELSE Move_Fund END AS usual
  FROM raw WHERE Pur_5 <> '050206') GROUP BY Pur_5, usual
  QUALIFY row_number() OVER (PARTITION BY Pur_5 ORDER BY count(*) DESC, usual) = 1"""
add("I15_move_fund_map", lambda ws: I.move_fund_map(_history(ws)), _MODE_HISTORY)
add("I16_apply_move_fund",
    lambda ws: I.apply_move_fund(ws.raw.select("Hash_ID", "Pur_5", "Move_Fund"),
                                 stage(I.move_fund_map(_history(ws)), "move_fund")).select("Hash_ID", "Move_Fund"),
    f"""SELECT Hash_ID, coalesce(usual, 'Yes') AS Move_Fund FROM raw
        LEFT JOIN ({_MODE_HISTORY}) m ON m.Pur_5 = raw.Pur_5""")
add("I17_stamp",
    lambda ws: I.stamp(ws.raw, F.col("_flow"), F.lit("a.xlsx")).select(
        "Hash_ID", "Flow", "Source_Year", "Month_Year", "Source_File"),
    f"""SELECT Hash_ID, _flow AS Flow, {_YEAR} AS Source_Year,
          date_trunc('month', Date_of_Transaction)::TIMESTAMP AS Month_Year, 'a.xlsx' AS Source_File
        FROM raw""")


def hash_sql(code: str, bank: str, file: str | None) -> str:
    parts = ["_flow", *([file] if file else []), "CAST(row_no AS VARCHAR)", f"coalesce({bank}, 'None')",
             "Reference_Number", "strftime(Date_of_Transaction, '%Y-%m-%d %H:%M:%S')",
             "CAST(Amount_Transferred AS VARCHAR)", "coalesce(trim(Currency_Code), 'None')", code]
    return f"sha1(concat_ws('|', {', '.join(parts)}))[:24]"


_IDENTITY = """SELECT id, count(*) AS n FROM ({sql}) GROUP BY id"""
add("I18_hash_id",
    lambda ws: I.hash_id(ws.raw.withColumns({
        "Flow": F.col("_flow"), "file": F.col("Source_File"), "Banks": text.blank_to_null(F.col("Banks")),
        "Currency_Code": F.trim("Currency_Code"), "Purpose_Code": F.trim("Pur_5"),
    }).withColumnRenamed("Hash_ID", "was")).groupBy("Hash_ID").agg(F.min("was").alias("was")),
    f"SELECT {hash_sql('trim(Pur_5)', CLEAN_BANK, 'Source_File')} AS Hash_ID, min(Hash_ID) AS was FROM raw GROUP BY 1")
add("I19_conform",
    lambda ws: I.conform(ws.raw.withColumn("Source_Year", F.lit("2001")).drop("M2")).select(
        "Hash_ID", "M2", "Source_Year", "Users", "Transfer_Fee", "Month_Year",
        F.col("`RecipientName_ AccountNumber`").alias("recipient_account")),
    """SELECT Hash_ID, NULL::VARCHAR AS M2, CAST(2001 AS BIGINT) AS Source_Year, NULL::VARCHAR AS Users,
         NULL::DOUBLE AS Transfer_Fee, NULL::TIMESTAMP AS Month_Year, NULL::VARCHAR AS recipient_account
       FROM raw""")

_SHOWN = ["Hash_ID", "Banks", "Date_of_Transaction", "Date_of_Submission", "Reference_Number",
          "Transferor_Name", "Recipient_Name", "Recipient_TIN", "Purpose_Name", "Country_Code",
          "Transfer_Method", "Currency_Code", "Amount_Transferred", "Amount_USD",
          "Code_New_Confirm", "Pur_2", "Pur_5", "Month_Year", "Move_Fund", "Use", "Flow",
          "Source_Year", "Source_File", "Exchange_Rates_Kip"]


def _imported(ws):
    flow = files.direction_of(F.col("file"), F.col("sheet"))
    return I.import_by_header(ws.cells, ws.raw, _official(ws), flow, refuse=False).select(*_SHOWN)


add("I22_import_rejects", lambda ws: I.import_report(ws.cells),
    f"""SELECT file, 'Sheet1' AS sheet, outcome, count(*) AS n FROM (
          SELECT {XLSX} AS file, CASE WHEN {_UNDATED} THEN 'undated' WHEN {CLEAN_BANK} IS NULL
            THEN 'template' ELSE 'kept' END AS outcome FROM {_ROWS}
          UNION ALL SELECT DISTINCT {XLSX}, 'template' FROM {_ROWS}
          UNION ALL SELECT DISTINCT {XLSX}, 'heading' FROM {_ROWS}
          UNION ALL SELECT DISTINCT concat({XLSX}, ''), 'heading' FROM {_ROWS}
          UNION ALL SELECT 'five_headers.xlsx', 'no_header' FROM {_ROWS} AND row_no % 100 = 11
          UNION ALL SELECT DISTINCT 'five_headers.xlsx', 'no_header' FROM {_ROWS} AND row_no % 100 = 11) GROUP BY ALL""")
_METHOD = f"""(SELECT canonical FROM ({_VOCAB}) v
  WHERE v.head = lower(trim(string_split(r.Transfer_Method, ':')[1])))"""
_USUAL = f"coalesce((SELECT usual FROM ({_MODE}) m WHERE m.Pur_5 = {{code}}), 'Yes')"
_COMMON = f"""{CLEAN_BANK} AS Banks, Date_of_Transaction, Date_of_Submission, Reference_Number,
  nullif(trim(Transferor_Name), '') AS Transferor_Name, Recipient_Name, Country_Code,
  {_METHOD} AS Transfer_Method, trim(Currency_Code) AS Currency_Code, Amount_Transferred,
  round(Amount_USD, 2) AS Amount_USD, date_trunc('month', Date_of_Transaction)::TIMESTAMP AS Month_Year, _flow AS Flow,
  {_YEAR} AS Source_Year"""
add("I20_import_by_header", _imported,
    f"""SELECT {hash_sql('trim(Pur_5)', CLEAN_BANK, XLSX)} AS Hash_ID, {_COMMON}, Recipient_TIN,
          coalesce(Purpose_Name, {_LO_NAME}) AS Purpose_Name, trim(Pur_5) AS Code_New_Confirm,
          trim(Pur_5)[:2] AS Pur_2, trim(Pur_5) AS Pur_5, {_USUAL.format(code='trim(r.Pur_5)')} AS Move_Fund,
          NULL::VARCHAR AS Use, {XLSX} AS Source_File,
          CASE WHEN row_no % 17 <> 0 THEN Exchange_Rates_Kip END AS Exchange_Rates_Kip
        FROM (SELECT * FROM {KEPT}) r""")


def _imported_book(ws):
    return I.import_by_position(ws.book, ws.raw, _official(ws), _LOW, _HIGH).select(*_SHOWN)


_CONFIRMED = "concat(trim(Pur_5), '01')"
add("I21_import_by_position", _imported_book,
    f"""SELECT {hash_sql('trim(Pur_5)', CLEAN_BANK, None)} AS Hash_ID, {_COMMON},
          NULL::VARCHAR AS Recipient_TIN,
          CASE {_CONFIRMED}[:6] WHEN '010107' THEN 'ແຮ່ທາດ' WHEN '020101' THEN 'ຂົນສົ່ງ' END AS Purpose_Name,
          {_CONFIRMED} AS Code_New_Confirm,
          coalesce(CASE WHEN row_no % 3 = 0 THEN nullif(trim(Pur_5[:2]), '') END, {_CONFIRMED}[:2]) AS Pur_2,
          {_CONFIRMED}[:6] AS Pur_5, {_USUAL.format(code="concat(trim(r.Pur_5), '01')[:6]")} AS Move_Fund,
          Use, 'database.xlsm' AS Source_File, NULL::DOUBLE AS Exchange_Rates_Kip
        FROM (SELECT * FROM {KEPT}) r
        WHERE Date_of_Transaction::DATE BETWEEN DATE '{_LOW}' AND DATE '{_HIGH}'""")

# -- rate pages --------------------------------------------------------------


def _rows(ws):
    return K.extract_rate_rows(ws.rate_pages)


_SHOW = "CASE WHEN page_id % 2 = 1 THEN {0} ELSE translate({0}, ',.', '.,') END"
_MONEY = _SHOW.format("format('{{:,.2f}}', {0}::DOUBLE)")
_SMALL = "CASE WHEN page_id % 2 = 1 THEN '{0}' ELSE replace('{0}', '.', ',') END"
_EU_EN = "CASE WHEN page_id % 2 = 1 THEN 'en' ELSE 'eu' END AS style"
_CELL_ROWS = f"""
SELECT page_id, 0 AS row_no, concat_ws('|', 'No.', 'BUY', 'SELL') AS cells FROM pages
UNION ALL SELECT page_id, 1, concat_ws('|', '1', 'USD 50-100', 'US Dollar',
  {_MONEY.format(_BUY)}, {_MONEY.format(f'({_BUY} + 100)')}) FROM pages
UNION ALL SELECT page_id, 2, concat_ws('|', '2', 'USD 5-20', 'US Dollar',
  {_MONEY.format(f'({_BUY} - 50)')}, {_MONEY.format(f'({_BUY} + 150)')}) FROM pages
UNION ALL SELECT page_id, 3, concat_ws('|', '3', 'THB', 'Thai Baht',
  {_SMALL.format('673.20')}, {_SMALL.format('686.07')}) FROM pages
UNION ALL SELECT page_id, 4, concat_ws('|', '4', 'CNY', 'Yuan – Rénminbi', {_MONEY.format('2900')}) FROM pages
UNION ALL SELECT page_id, 5, concat_ws('|', 'EUR', 'Euro', {_MONEY.format('24000')}) FROM pages"""
add("K1_extract_rate_rows",
    lambda ws: _rows(ws).select("source", "style", "row_no", F.array_join("cells", "|").alias("cells")),
    f"SELECT CAST(page_id AS VARCHAR) AS source, {_EU_EN}, row_no, cells FROM ({_CELL_ROWS})")
add("K2_locale_numbers",
    lambda ws: ws.raw.select(
        "Hash_ID",
        numbers.num_en(F.concat(F.lit("LAK "), F.format_number("Amount_Transferred", 2))).alias("en"),
        numbers.num_eu(F.concat(F.translate(F.format_number("Amount_Transferred", 2), ",.", ".,"),
                                F.lit(" kip"))).alias("eu"),
        numbers.num_eu(F.format_number("row_no", 0)).alias("no_comma")),
    # Read as European, the commas of an English whole number are decimal points; several are no number.
    """SELECT Hash_ID, Amount_Transferred AS en, Amount_Transferred AS eu,
         CASE WHEN row_no < 1000 THEN row_no WHEN row_no < 1000000 THEN row_no / 1000 END::DOUBLE AS no_comma
       FROM raw""")
_ALL_RATES = f"""SELECT * FROM ({_USD_THB}) UNION ALL
  SELECT page_id, 'USD', 'US Dollar', {_BUY} - 50, {_BUY} + 150, 2 FROM pages"""
add("K3_parse_rate_row", lambda ws: K.parse_rate_row(_rows(ws)),
    f"""SELECT CAST(page_id AS VARCHAR) AS source, {_EU_EN}, row_no, code, name, buy, sell
        FROM ({_ALL_RATES})""")
add("K4_first_per_currency", lambda ws: K.first_per_currency(K.parse_rate_row(_rows(ws))),
    f"SELECT CAST(page_id AS VARCHAR) AS source, {_EU_EN}, row_no, code, name, buy, sell FROM ({_USD_THB})")
add("K5_page_date",
    lambda ws: ws.table("pages").select(
        "page_id", K.page_date(F.concat("html", F.lit(" 7/3/2024 "), F.col("html"))).alias("date")),
    r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '\d{4}-\d{2}-\d{2}'), ''),
         nullif(regexp_extract(html, '\d{1,2}-\d{1,2}-\d{4}'), ''),
         nullif(regexp_extract(html, '\d{1,2}/\d{1,2}/\d{4}'), ''), '7/3/2024') AS date FROM pages""")
add("K6_sane_sources",
    lambda ws: K.sane_sources(K.first_per_currency(K.parse_rate_row(_rows(ws)))).select("source", "code", "buy"),
    f"SELECT CAST(page_id AS VARCHAR) AS source, code, buy FROM ({_USD_THB}) WHERE {_SANE}")
add("K7_rates_table", lambda ws: K.rates_table(ws.rate_pages),
    f"""SELECT CAST(page_id AS VARCHAR) AS source, format('2024-03-{{:02d}}', page_id % 28 + 1) AS date, url,
          code, name, buy, sell FROM ({_USD_THB}) JOIN (SELECT page_id, url FROM pages) USING (page_id)
        WHERE {_SANE}""")
