"""Cleaning, deduplication, dimensions and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitra.checks.inputs import ALIAS_INPUT
from remitra.checks.registry import add
from remitra.checks.sql import bank_key, collapse, named, r2, usd_m
from remitra.config import loader, values
from remitra.functions import dates, numbers, text
from remitra.operators import clean as P
from remitra.operators import cubes as C
from remitra.operators import dedup as W
from remitra.operators import dims as D
from remitra.operators import entities as E
from remitra.operators import fact as J
from remitra.operators import reports as V
from remitra.operators.names import with_clean_names
from remitra.operators.scale import list_position, top_k

# -- projections -------------------------------------------------------------

_TEXT = ["bank", "ref", "pur5", "purpose_name", "country", "currency", "method_raw", "lsic",
         "tr_name", "rc_name", "tr_tin", "rc_tin", "docs"]


def _raw(ws, **columns):
    return P.drop_undated(ws.raw).select(
        "Hash_ID", *[c.alias(name) for name, c in columns.items()]
    )


add("P1_clean_select", lambda ws: ws.tx_all.select("Hash_ID", *_TEXT),
    f"SELECT Hash_ID, {', '.join(_TEXT)} FROM tx_all")
add("P2_upper_code",
    lambda ws: _raw(ws, country=text.upper_code(F.col("Country_Code")),
                    currency=text.upper_code(F.col("Currency_Code"))),
    "SELECT Hash_ID, country, currency FROM tx_all")
add("P3_flow_year", lambda ws: _raw(ws, **P.flow_year_columns()),
    "SELECT Hash_ID, flow, yr FROM tx_all")
add("P4_period_keys",
    lambda ws: _raw(ws, ym=dates.month_key(F.col("Date_of_Transaction")),
                    ymd=dates.day_key(F.col("Date_of_Transaction"))),
    "SELECT Hash_ID, ym, ymd FROM tx_all")
add("P5_lag_days",
    lambda ws: _raw(ws, lag_days=dates.lag_days(
        F.col("Date_of_Transaction"), F.col("Date_of_Submission"))),
    "SELECT Hash_ID, lag_days FROM tx_all")
add("P6_yes_flags", lambda ws: _raw(ws, **P.yes_flags()),
    "SELECT Hash_ID, use_flag, m2_flag, move_flag FROM tx_all")
add("P7_quality_flags", lambda ws: _raw(ws, **P.quality_flags()),
    "SELECT Hash_ID, bad_fx, null_amt, zero_amt, neg_amt, future_dated, late_sub FROM tx_all")
add("P8_drop_undated",
    lambda ws: P.drop_undated(ws.raw.withColumn(
        "Date_of_Transaction", F.when(F.col("row_no") % 13 != 0, F.col("Date_of_Transaction"))
    )).select("Hash_ID", "Date_of_Transaction"),
    "SELECT Hash_ID, Date_of_Transaction FROM raw WHERE row_no % 13 <> 0")
add("P9_flow_use_ix",
    lambda ws: P.with_flow_use_ix(ws.tx_all).select("Hash_ID", "flow_ix", "use_ix"),
    """SELECT Hash_ID, CASE WHEN flow = 'Payment' THEN 0 ELSE 1 END AS flow_ix,
         CASE WHEN use_flag THEN 1 ELSE 0 END AS use_ix FROM tx_all""")
add("P10_size_bucket",
    lambda ws: ws.tx.filter("usd > 0").select(
        "Hash_ID", numbers.size_bucket(F.col("usd"), values.SIZE_BANDS).alias("size_ix")),
    """SELECT Hash_ID, CASE WHEN usd < 1000 THEN 0 WHEN usd < 10000 THEN 1 WHEN usd < 100000 THEN 2
         WHEN usd < 1000000 THEN 3 WHEN usd < 10000000 THEN 4 ELSE 5 END AS size_ix
       FROM tx WHERE usd > 0""")


def _damaged(ws):
    """Documents as they look after UTF-8 was read as code page 1252."""
    wrong = F.translate(
        F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), text.CP1252_BYTES, text.CP1252
    )
    return ws.table("documents").select("doc_id", "text", wrong.alias("damaged"))


# A repair is kept unless the repaired text still holds one of four letters; a text
# with no byte that shows up as a suspect letter is left as it is.
_CP1252 = "".join(
    f"WHEN {b} THEN {ord(c)} " for b, c in zip(map(ord, text.CP1252_BYTES), text.CP1252)
)
add("P11_fix_mojibake",
    lambda ws: _damaged(ws).select(
        "doc_id", F.md5(text.fix_mojibake(F.col("damaged")).cast("binary")).alias("digest")),
    f"""SELECT doc_id, md5(CASE WHEN NOT regexp_matches(damaged, '[ÃÂàáâãäåæçèéêëìíîï]') THEN damaged
          WHEN regexp_matches(text, '[Ãàº»]') THEN damaged ELSE text END) AS digest
        FROM (SELECT doc_id, text, array_to_string(list_transform(range(strlen(hex(encode(text))) // 2),
            lambda i: chr(CASE b[i + 1] {_CP1252} ELSE b[i + 1] END)), '') AS damaged
          FROM (SELECT doc_id, text, list_transform(range(strlen(hex(encode(text))) // 2),
              lambda i: CAST(('0x' || substr(hex(encode(text)), 2 * i + 1, 2)) AS INTEGER)) AS b
            FROM documents))""")
add("P12_norm_text",
    lambda ws: ws.table("documents").select(
        "doc_id", F.md5(text.norm_text(F.col("text")).cast("binary")).alias("digest")),
    f"SELECT doc_id, md5(nfc_normalize({collapse('text')})) AS digest FROM documents")
add("P13_clean_name",
    lambda ws: with_clean_names(
        ws.raw.select("Transferor_Name", "Recipient_Name").distinct(),
        {"name": F.concat(F.lit(" ./"), F.col("Transferor_Name"), F.lit("  &  "),
                          F.col("Recipient_Name"), F.lit("\\_,"))}),
    r"""SELECT DISTINCT Transferor_Name, Recipient_Name,
          concat(Transferor_Name || ' & ', Recipient_Name) AS name
        FROM raw WHERE Transferor_Name IS NOT NULL AND Recipient_Name IS NOT NULL
        UNION ALL
        SELECT DISTINCT Transferor_Name, Recipient_Name, NULL FROM raw
        WHERE Transferor_Name IS NULL OR Recipient_Name IS NULL""")
add("P14_bank_key",
    lambda ws: ws.raw.select("Hash_ID", text.bank_key(F.col("Banks")).alias("key")),
    f"SELECT Hash_ID, {bank_key('Banks')} AS key FROM raw")
add("P15_rounding",
    lambda ws: ws.tx.select("Hash_ID", numbers.r2(F.col("usd") / 1e6).alias("usd_m"),
                            numbers.r2(-F.col("usd") / 1e9, 1).alias("minus")),
    f"SELECT Hash_ID, {r2('usd / 1e6')} AS usd_m, {r2('-usd / 1e9', 1)} AS minus FROM tx")
add("P16_named",
    lambda ws: ws.raw.select(
        "Hash_ID", text.named(F.col("Transferor_Name")).alias("sender_named"),
        text.named(F.translate("Recipient_Name", "- ", "")).alias("receiver_named")),
    f"""SELECT Hash_ID, {named('Transferor_Name')} AS sender_named,
          {named("replace(replace(Recipient_Name, '-', ''), ' ', '')")} AS receiver_named FROM raw""")
add("P17_real_name",
    lambda ws: with_clean_names(
        ws.raw.select("Recipient_Name", "Transferor_Name").distinct(),
        {"_receiver": F.col("Recipient_Name"), "_sender": F.col("Transferor_Name")},
    ).select(
        "Recipient_Name", "Transferor_Name",
        text.real_name(F.col("Recipient_Name"), F.col("_receiver"), ws.config.blocklist).alias("receiver_real"),
        text.real_name(F.col("Transferor_Name"), F.col("_sender"), ws.config.blocklist).alias("sender_real")),
    """SELECT DISTINCT Recipient_Name, Transferor_Name,
         coalesce(regexp_matches(Recipient_Name, '[A-Za-z]'), FALSE) AS receiver_real,
         coalesce(Transferor_Name <> 'NULL', FALSE) AS sender_real FROM raw""")
add("P18_is_missing",
    lambda ws: ws.raw.select(
        "Hash_ID", text.is_missing(F.col("Transferor_TIN")).alias("tin"),
        text.is_missing(F.col("Supporting_Documents")).alias("docs"),
        text.is_missing(F.col("Amount_USD")).alias("usd")),
    """SELECT Hash_ID, Transferor_TIN IS NULL OR trim(Transferor_TIN) = '' AS tin,
         Supporting_Documents IS NULL OR trim(Supporting_Documents) = '' AS docs,
         Amount_USD IS NULL AS usd FROM raw""")
add("P19_norm_purpose_code",
    lambda ws: ws.tx.select(F.substring("Hash_ID", 1, 8).alias("filed")).distinct().select(
        "filed", D.norm_purpose_code(F.col("filed")).alias("code")),
    """SELECT filed, CASE WHEN n IN (2, 4, 6) THEN filed WHEN n > 6 THEN filed[:6]
         WHEN n > 4 THEN filed[:4] ELSE filed[:2] END AS code
       FROM (SELECT DISTINCT Hash_ID[:8] AS filed, length(Hash_ID[:8]) AS n FROM tx)""")
add("P20_parent_code",
    lambda ws: ws.dims.purposes.select(
        "code", D.parent_code(F.col("code")).alias("parent"), D.pur2_of(F.col("code")).alias("pur2")),
    "SELECT code, parent, pur2 FROM purposes")
add("P21_country_names",
    lambda ws: D.country_names(
        _coded_countries(ws),
        loader.pairs_frame(ws.spark, values.COUNTRY_NAMES, "country string, _en string"),
        loader.pairs_frame(ws.spark, {"TH": "ໄທ", "CN": "ຈີນ"}, "country string, lo string"),
    ).select("country", "n", "name", "lo"),
    f"""SELECT country, n, coalesce(en, country) AS name,
          CASE country WHEN 'TH' THEN 'ໄທ' WHEN 'CN' THEN 'ຈີນ' END AS lo
        FROM (SELECT CASE k WHEN 0 THEN 'TH' WHEN 1 THEN 'CN' WHEN 2 THEN 'KR' WHEN 3 THEN 'XK'
                ELSE country END AS country, count(*) AS n
              FROM (SELECT *, CAST(replace(country, 'NATION_', '') AS INTEGER) AS k
                    FROM tx WHERE country IS NOT NULL) GROUP BY 1)
        LEFT JOIN (VALUES {', '.join(f"('{c}', '{n}')" for c, n in values.COUNTRY_NAMES.items())})
          AS names(code, en) ON code = country""")


def _coded_countries(ws):
    codes = {"NATION_0": "TH", "NATION_1": "CN", "NATION_2": "KR", "NATION_3": "XK"}
    code = F.col("country")
    for nation, short in codes.items():
        code = F.when(F.col("country") == nation, short).otherwise(code)
    rows = ws.base.filter("country IS NOT NULL").withColumn("country", code)
    return rows.groupBy("country").agg(F.sum("n").alias("n"))


add("P22_title_case",
    lambda ws: ws.tx.select("tr_name").distinct().select(
        "tr_name", text.title_case(F.concat(F.lit("EDL "), F.upper("tr_name"), F.lit(" COMPANY opd")),
                                   ws.config.acronyms).alias("printed")),
    """SELECT DISTINCT tr_name, concat('EDL ', upper(tr_name[1]) || lower(tr_name[2:]), ' Company opd')
         AS printed FROM tx WHERE tr_name IS NOT NULL
       UNION ALL SELECT DISTINCT NULL, NULL FROM tx WHERE tr_name IS NULL""")

# -- deduplication -----------------------------------------------------------

add("W1_rank_duplicates", lambda ws: W.rank_duplicates(ws.tx_all).select("Hash_ID", "dup_rank", "dup_count"),
    "SELECT Hash_ID, dup_rank, dup_count FROM with_copies")
add("W2_dup_count", lambda ws: W.dup_count(ws.tx_all).select("Hash_ID", "dup_count"),
    "SELECT Hash_ID, dup_count FROM with_copies")
add("W3_dedup", lambda ws: W.dedup(ws.tx_all).select("Hash_ID", "ref", "usd"),
    "SELECT Hash_ID, ref, usd FROM tx")
add("W4_dedup_report", lambda ws: W.dedup_report(ws.tx_all),
    """SELECT count(*) FILTER (WHERE dup_rank = 1) AS kept,
         count(*) FILTER (WHERE dup_rank > 1) AS removed, count(*) AS total FROM with_copies""")
add("W5_rank_by_usd",
    lambda ws: C.rank_by_usd(ws.tx, ws.dims).select(
        "year_ix", "flow_ix", "Hash_ID", "rn", numbers.r2(numbers.millions(F.col("tot"))).alias("tot_m")),
    f"""SELECT year_ix, flow_ix, Hash_ID, rn, {r2('tot / 1e6')} AS tot_m FROM (
          SELECT year_ix, flow_ix, Hash_ID, sum(usd) OVER (PARTITION BY year_ix, flow_ix) AS tot,
            row_number() OVER (PARTITION BY year_ix, flow_ix ORDER BY usd DESC, Hash_ID) AS rn
          FROM tx JOIN years USING (yr) WHERE usd > 0 AND use_ix = 1)""")

_TOPS = f"""
SELECT ix, t.kind, CAST(rn AS INTEGER) AS rn, t.val, pos AS val_ix, {r2('usd / 1e6')} AS usd_m FROM (
  SELECT ix, kind, val, sum(usd) AS usd,
    row_number() OVER (PARTITION BY ix, kind ORDER BY sum(usd) DESC NULLS LAST, val) AS rn
  FROM (SELECT ix, 'ctry' AS kind, country AS val, usd FROM kept
        UNION ALL SELECT ix, 'pur', pur5, usd FROM kept
        UNION ALL SELECT ix, 'curr', currency, usd FROM kept
        UNION ALL SELECT ix, 'bank', label, usd FROM kept LEFT JOIN banks b ON b.bank = kept.bank)
  WHERE val IS NOT NULL GROUP BY ix, kind, val) t
JOIN (SELECT 'ctry' AS kind, country AS val, country_ix AS pos FROM countries
      UNION ALL SELECT 'pur', code, purpose_ix FROM purposes
      UNION ALL SELECT 'curr', currency, currency_ix FROM currencies
      UNION ALL SELECT 'bank', label, bank_ix FROM bank_group) d ON d.kind = t.kind AND d.val = t.val
WHERE rn <= 5"""
_TOP_TX = f"""
SELECT ix, CAST(rn AS INTEGER) AS rn, side, Hash_ID, ymd, flow_ix, coalesce(bank_ix, -1) AS bank_ix,
  coalesce(currency_ix, -1) AS currency_ix, {r2('amt_orig', 2)} AS amt, {r2('k.usd', 2)} AS usd,
  coalesce(country_ix, -1) AS country_ix, coalesce(purpose_ix, -1) AS purpose_ix, other
FROM (SELECT *, row_number() OVER (PARTITION BY ix ORDER BY usd DESC NULLS LAST, Hash_ID, side) AS rn
      FROM kept) k
LEFT JOIN banks b ON b.bank = k.bank LEFT JOIN currencies u ON u.currency = k.currency
LEFT JOIN countries c ON c.country = k.country LEFT JOIN purposes p ON p.code = k.pur5
WHERE rn <= 12"""
add("W6_top_n_per_entity", lambda ws: E.entity_tops(ws.kept, ws.dims, 3),
    _TOPS.replace("rn <= 5", "rn <= 3"))
add("W7_top_tx_per_entity", lambda ws: E.entity_tx(ws.kept, ws.dims, 5),
    _TOP_TX.replace("rn <= 12", "rn <= 5"))
add("W8_list_position",
    lambda ws: list_position(
        ws.tx.select("tr_name").filter("tr_name IS NOT NULL").distinct(), [F.col("tr_name")],
        F.substring("tr_name", 1, 14), "ix"),
    """SELECT tr_name, CAST(row_number() OVER (ORDER BY tr_name) - 1 AS INTEGER) AS ix
       FROM (SELECT DISTINCT tr_name FROM tx WHERE tr_name IS NOT NULL)""")

# -- joins -------------------------------------------------------------------


def _keyed(df, *ix):
    return df.select("Hash_ID", *ix)


add("J1_join_codes",
    lambda ws: _keyed(J.join_codes(ws.tx, ws.dims), "purpose_ix", "pur2", "line_ix", "method_ix",
                      "flow_ix", "use_ix"),
    "SELECT Hash_ID, purpose_ix, pur2, line_ix, method_ix, flow_ix, use_ix FROM coded")
add("J2_join_periods", lambda ws: _keyed(J.join_periods(ws.tx, ws.dims), "month_ix", "year_ix"),
    "SELECT Hash_ID, month_ix, year_ix FROM tx JOIN months USING (ym) JOIN years USING (yr)")
add("J3_join_pur2",
    lambda ws: _keyed(J.join_pur2(J.join_purposes(ws.tx, ws.dims)), "pur2", "pur2_ix"),
    "SELECT Hash_ID, pur2, pur2_ix FROM coded LEFT JOIN pur2_dim USING (pur2)")
add("J4_join_bank_left", lambda ws: _keyed(J.join_bank_left(ws.tx, ws.dims), "bank_ix"),
    "SELECT Hash_ID, coalesce(bank_ix, -1) AS bank_ix FROM tx LEFT JOIN banks USING (bank)")
add("J5_join_bank_inner", lambda ws: _keyed(J.join_bank_inner(ws.tx, ws.dims), "bank_ix"),
    "SELECT Hash_ID, bank_ix FROM tx JOIN banks USING (bank)")
add("J6_join_country_currency",
    lambda ws: _keyed(J.join_currency(J.join_country(ws.tx, ws.dims), ws.dims),
                      "country_ix", "currency_ix"),
    """SELECT Hash_ID, country_ix, currency_ix FROM tx JOIN countries USING (country)
       JOIN currencies USING (currency)""")
add("J7_join_goods", lambda ws: _keyed(J.join_goods(ws.tx), "goods_ix", "side"),
    "SELECT Hash_ID, goods_ix, side FROM tx JOIN goods_dim ON code = pur5")
add("J8_anti_blocklist",
    lambda ws: E.anti_blocklist(
        E.entity_sides(ws.tx), loader.blocklist_frame(ws.spark, ws.config).unionByName(
            ws.tx.limit(1).select(F.lit(None).cast("string").alias("blocked")))
    ).select("Hash_ID", "side", "nm"),
    """SELECT Hash_ID, side, nm FROM sides
       WHERE NOT EXISTS (SELECT 1 FROM block WHERE blocked = upper(nm))""")
add("J9_keep_entities",
    lambda ws: E.keep_entities(ws.ent, E.entity_keep(ws.totals, 200)).select("Hash_ID", "side", "ix"),
    "SELECT Hash_ID, side, ix FROM kept WHERE ix < 200")
add("J10_join_medians",
    lambda ws: ws.judged.select("Hash_ID", F.round("med", 6).alias("med"),
                                F.round("med_fx", 6).alias("med_fx")),
    "SELECT Hash_ID, round(med, 6) AS med, round(med_fx, 6) AS med_fx FROM judged")
add("J11_report_line",
    lambda ws: D.report_line_for(
        ws.tx.filter("pur5 <> ''").select(D.norm_purpose_code(F.col("pur5")).alias("code")).distinct(),
        loader.report_line_frame(ws.spark, ws.config)),
    "SELECT code, line_ix FROM code_line")
add("J12_resolve_alias",
    lambda ws: D.resolve_alias(
        ws.shared(ALIAS_INPUT).withColumn("key", text.bank_key(F.col("spelling"))),
        ws.config.bank_aliases, "key"),
    f"""SELECT spelling, coalesce(to_key, {bank_key('spelling')}) AS key FROM spellings
        LEFT JOIN alias_keys ON from_key = {bank_key('spelling')}""")


def _with_officers(ws):
    config = loader.Config(
        officers={"bank 3": "Officer A", "B.A.N.K-4": "Officer B", "Bank5": ""},
        bank_names_lo={"BANK-3": "ທະນາຄານ 3", "Bank_7": "ທະນາຄານ 7"},
    )
    return V.join_officers(ws.dims.banks, config).select("bank", "officer", "bank_lo")


add("J13_join_officers", _with_officers,
    """SELECT bank, CASE key WHEN 'BANK3' THEN 'Officer A' WHEN 'BANK4' THEN 'Officer B' END AS officer,
         CASE key WHEN 'BANK3' THEN 'ທະນາຄານ 3' WHEN 'BANK7' THEN 'ທະນາຄານ 7' END AS bank_lo
       FROM banks""")

# -- set operations ----------------------------------------------------------

add("U2_entity_sides",
    lambda ws: E.entity_sides(ws.tx).select("Hash_ID", "side", "nm", "other"),
    "SELECT Hash_ID, side, nm, other FROM sides")
add("U3_drop_columns",
    lambda ws: ws.tx.drop(*[c for c in ws.tx.columns if c not in ("Hash_ID", "ymd", "usd")]),
    "SELECT Hash_ID, ymd, usd FROM tx")
add("U4_distinct", lambda ws: ws.raw.select("Banks", "Transfer_Method").distinct(),
    "SELECT DISTINCT Banks, Transfer_Method FROM raw")

# -- dimensions --------------------------------------------------------------

add("D1_months", lambda ws: ws.dims.months, "SELECT ym, month_ix FROM months")
add("D1_years", lambda ws: ws.dims.years, "SELECT yr, year_ix FROM years")
add("D2_purposes", lambda ws: ws.dims.purposes,
    "SELECT code, en, name, parent, pur2, line_ix, purpose_ix FROM purposes")
add("D3_purpose_name_votes", lambda ws: D.purpose_name_votes(ws.names),
    "SELECT pur5, name, CAST(votes AS BIGINT) AS votes FROM votes")
add("D4_countries", lambda ws: ws.dims.countries.select("country", "country_ix", "name"),
    "SELECT country, country_ix, country AS name FROM countries")
add("D5_currencies", lambda ws: ws.dims.currencies.select("currency", "currency_ix"),
    "SELECT currency, currency_ix FROM currencies")
add("D6_banks",
    lambda ws: ws.dims.banks.select(
        "bank", "key", "label", "bank_ix", numbers.r2(numbers.millions(F.col("bank_usd"))).alias("usd_m")),
    f"SELECT bank, key, label, bank_ix, {r2('bank_usd / 1e6')} AS usd_m FROM banks")
add("D7_methods", lambda ws: ws.dims.methods, "SELECT method_raw, method, method_ix FROM methods")
add("D8_pur2_used",
    lambda ws: J.join_purposes(ws.base, ws.dims).groupBy("pur2").agg(F.sum("n").alias("n")).join(
        loader.pur2_frame(ws.spark).withColumnRenamed("code", "pur2"), "pur2"
    ).select("pur2", "pur2_ix", "en", "lo", "account", "n"),
    """SELECT pur2, pur2_ix, en, lo, account, count(*) AS n FROM coded JOIN pur2_dim USING (pur2)
       GROUP BY ALL""")
add("D9_report_lines_used",
    lambda ws: J.join_purposes(ws.base, ws.dims).groupBy("line_ix").agg(F.sum("n").alias("n")).join(
        loader.report_line_frame(ws.spark, ws.config), "line_ix"
    ).select("line_ix", "grp", "bank_own", "catch_all", "n"),
    """SELECT line_ix, grp, bank_own, catch_all, count(*) AS n FROM coded JOIN line_dim USING (line_ix)
       GROUP BY ALL""")
add("D10_goods_used",
    lambda ws: J.join_goods(ws.base).groupBy("goods_ix", F.col("pur5").alias("code"), "side").agg(
        F.sum("n").alias("n")),
    "SELECT goods_ix, code, side, count(*) AS n FROM tx JOIN goods_dim ON code = pur5 GROUP BY ALL")
add("D11_size_bands_used",
    lambda ws: ws.tx.filter("usd > 0").groupBy(
        numbers.size_bucket(F.col("usd"), values.SIZE_BANDS).alias("size_ix")
    ).agg(F.count("*").alias("n")).join(loader.size_band_frame(ws.spark), "size_ix").select(
        "label", "n"),
    """SELECT CASE WHEN usd < 1000 THEN '< $1k' WHEN usd < 10000 THEN '$1k-$10k'
         WHEN usd < 100000 THEN '$10k-$100k' WHEN usd < 1000000 THEN '$100k-$1m'
         WHEN usd < 10000000 THEN '$1m-$10m' ELSE '> $10m' END AS label, count(*) AS n
       FROM tx WHERE usd > 0 GROUP BY 1""")


def _missing_by_field(ws):
    counts = ws.tx.agg(*[
        F.count_if(text.is_missing(F.col(f))).alias(f) for f, _, _ in values.QUALITY_FIELDS
    ])
    fields = [f for f, _, _ in values.QUALITY_FIELDS]
    long = counts.unpivot([], fields, "field", "missing")
    return long.join(loader.quality_field_frame(ws.spark), "field").select("field", "en", "missing")


add("D11_quality_fields_used", _missing_by_field,
    "SELECT field, en, missing FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS field, '{en}' AS en, count(*) FILTER (WHERE {f} IS NULL) AS missing FROM tx"
        for f, en, _ in values.QUALITY_FIELDS) + ")")

# -- sorts and limits --------------------------------------------------------

add("O1_sort_cube",
    lambda ws: C.sort_cube(C.cube(ws.base, ["ym", "country"]), ["ym", "country"]),
    f"SELECT ym, country, count(*) AS n, {usd_m()} AS usd_m FROM tx GROUP BY ym, country ORDER BY ALL")
add("O2_order_by_value",
    lambda ws: ws.totals.orderBy(*E.order_by_value()).select("nm", "n"),
    "SELECT nm, n FROM party_totals ORDER BY usd DESC NULLS LAST, nm")
add("O3_top_k",
    lambda ws: top_k(ws.tx.filter("usd IS NOT NULL"),
                     [F.abs(F.col("usd") - F.col("amt_orig")).desc(), F.col("Hash_ID")], 500
                     ).select("Hash_ID", "usd"),
    """SELECT Hash_ID, usd FROM tx WHERE usd IS NOT NULL
       ORDER BY abs(usd - amt_orig) DESC, Hash_ID LIMIT 500""")
add("O4_top_members",
    lambda ws: J.join_country(ws.base, ws.dims).filter("country_ix < 10").groupBy("country_ix").agg(
        F.sum("n").alias("n")),
    "SELECT country_ix, count(*) AS n FROM tx JOIN countries USING (country) WHERE country_ix < 10 GROUP BY 1")
add("O5_sort_ci", lambda ws: E.sort_ci(E.all_names(ws.totals), "nm").select("nm", "n"),
    "SELECT nm, count(*) AS n FROM ent GROUP BY nm ORDER BY lower(nm), nm")
add("O6_having",
    lambda ws: ws.tx.groupBy("ymd", "flow_ix").agg(F.count("*").alias("n")).filter("n >= 20"),
    "SELECT ymd, flow_ix, count(*) AS n FROM tx GROUP BY ymd, flow_ix HAVING count(*) >= 20")

ENTITY_TOPS, ENTITY_TX = _TOPS, _TOP_TX
