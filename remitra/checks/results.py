"""Cubes, exceptions, counterparties and report views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from remitra.checks.core import ENTITY_TOPS, ENTITY_TX
from remitra.checks.registry import add
from remitra.checks.sql import r2, usd_m
from remitra.config import values
from remitra.config.rules import DUPLICATE_TIERS, PURPOSE_RULES
from remitra.functions.numbers import millions, r2 as rounded
from remitra.operators import cubes as C
from remitra.operators import entities as E
from remitra.operators import exceptions as X
from remitra.operators import ranges as G
from remitra.operators import reports as V
from remitra.operators import rules as R
from remitra.operators import search as N
from remitra.operators.fact import join_purposes
from remitra.session import shared_dir

_BANK = "JOIN banks USING (bank)"
_BANK_LEFT = "LEFT JOIN banks USING (bank)"
_MONTH, _YEAR = "JOIN months USING (ym)", "JOIN years USING (yr)"
_COUNTRY, _CURRENCY = "JOIN countries USING (country)", "JOIN currencies USING (currency)"
_SHORT = "purpose_ix >= 0 AND length(pur5) <= 4"


def cube_sql(keys: str, joins: str = "", where: str = "TRUE", count: bool = True) -> str:
    n = "count(*) AS n, " if count else ""
    keys = keys.replace("bank_ix0", "coalesce(bank_ix, -1) AS bank_ix")
    return f"SELECT {keys}, {n}{usd_m('coded.usd')} AS usd_m FROM coded {joins} WHERE {where} GROUP BY ALL"


# -- cubes -------------------------------------------------------------------

add("C1_month", lambda ws: C.cube_month(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, pur2_ix, use_ix, bank_ix0",
             f"{_MONTH} {_YEAR} JOIN pur2_dim USING (pur2) {_BANK_LEFT}"))
add("C2_country", lambda ws: C.cube_country(ws.base, ws.dims),
    cube_sql("year_ix, flow_ix, country_ix, use_ix, bank_ix0", f"{_YEAR} {_COUNTRY} {_BANK_LEFT}"))
add("C3_currency", lambda ws: C.cube_currency(ws.base, ws.dims),
    cube_sql("year_ix, flow_ix, currency_ix, use_ix, bank_ix0", f"{_YEAR} {_CURRENCY} {_BANK_LEFT}"))
add("C4_bank", lambda ws: C.cube_bank(ws.base, ws.dims),
    cube_sql("year_ix, flow_ix, bank_ix, use_ix", f"{_YEAR} {_BANK}"))
add("C5_purpose", lambda ws: C.cube_purpose(ws.base, ws.dims),
    cube_sql("year_ix, flow_ix, purpose_ix, use_ix, bank_ix0", f"{_YEAR} {_BANK_LEFT}",
             "purpose_ix >= 0"))
add("C6_method", lambda ws: C.cube_method(ws.filed, ws.dims),
    cube_sql("year_ix, flow_ix, method_ix, use_ix", _YEAR, "method_ix >= 0"))
add("C7_size", lambda ws: C.cube_size(ws.filed, ws.dims),
    cube_sql("""year_ix, flow_ix, CASE WHEN coded.usd < 1000 THEN 0 WHEN coded.usd < 10000 THEN 1
      WHEN coded.usd < 100000 THEN 2 WHEN coded.usd < 1000000 THEN 3 WHEN coded.usd < 10000000 THEN 4
      ELSE 5 END AS size_ix, use_ix""", _YEAR, "coded.usd > 0"))
add("C8_ts_bank", lambda ws: C.ts_bank(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, bank_ix, use_ix", f"{_MONTH} {_BANK}"))
add("C9_ts_country", lambda ws: C.ts_country(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, country_ix, use_ix, bank_ix", f"{_MONTH} {_COUNTRY} {_BANK}"))
add("C10_ts_currency", lambda ws: C.ts_currency(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, currency_ix, use_ix, bank_ix", f"{_MONTH} {_CURRENCY} {_BANK}"))
add("C11_ts_purpose", lambda ws: C.ts_purpose(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, purpose_ix, use_ix, bank_ix", f"{_MONTH} {_BANK}", _SHORT))
add("C12_ts_line", lambda ws: C.ts_line(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, line_ix, use_ix, bank_ix", f"{_MONTH} {_BANK}", "line_ix >= 0"))

_DAY_LINE = cube_sql("ymd, flow_ix, line_ix, use_ix, bank_ix", _BANK, "line_ix >= 0")
_DAY_BANK = cube_sql("ymd, flow_ix, bank_ix, use_ix", _BANK)
_DAY_ENTITY = f"""
SELECT ymd, flow_ix, name, use_ix, {usd_m()} AS usd_m FROM (
  SELECT ymd, flow_ix, coalesce(tr_name, rc_name) AS name, use_ix, sum(usd) AS usd FROM tx
  GROUP BY ALL HAVING sum(usd) >= 500000)
WHERE length(name) >= 3 AND name NOT IN (SELECT blocked FROM block)
  AND regexp_matches(name, '[A-Za-z]') GROUP BY ALL"""
_DAY_GOODS = (cube_sql("ymd, flow_ix, goods_ix, use_ix", "JOIN goods_dim ON code = pur5", count=False)
              + " HAVING usd_m <> 0")
add("C13_day_line", lambda ws: C.day_line(ws.day, ws.dims), _DAY_LINE)
add("C14_day_bank", lambda ws: C.day_bank(ws.day, ws.dims), _DAY_BANK)
add("C15_day_entity",
    lambda ws: C.index_entities(ws.day_entity, C.big_entities(ws.day_entity)),
    f"""SELECT ymd, flow_ix, name, use_ix, usd_m, entity_ix FROM ({_DAY_ENTITY}) JOIN (
          SELECT name, CAST(row_number() OVER (ORDER BY f.d, f.f, name) - 1 AS INTEGER) AS entity_ix
          FROM (SELECT name, min(struct_pack(d := ymd, f := flow_ix)) AS f
                FROM ({_DAY_ENTITY}) GROUP BY name)) USING (name)""")
add("C16_day_currency", lambda ws: C.day_currency(ws.day, ws.dims, 3),
    cube_sql("ymd, flow_ix, currency_ix, use_ix", _CURRENCY, "currency_ix < 3", count=False))
add("C17_day_goods", lambda ws: C.day_goods(ws.day), _DAY_GOODS)

add("C18_cross_country_currency", lambda ws: C.cross_country_currency(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, country_ix, currency_ix, use_ix", f"{_MONTH} {_COUNTRY} {_CURRENCY}"))
add("C19_cross_country_sector", lambda ws: C.cross_country_sector(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, country_ix, purpose_ix, use_ix", f"{_MONTH} {_COUNTRY}", _SHORT))
add("C20_cross_country_line", lambda ws: C.cross_country_line(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, country_ix, line_ix, use_ix", f"{_MONTH} {_COUNTRY}", "line_ix >= 0"))
add("C21_cross_currency_sector", lambda ws: C.cross_currency_sector(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, currency_ix, purpose_ix, use_ix", f"{_MONTH} {_CURRENCY}", _SHORT))
add("C22_cross_currency_line", lambda ws: C.cross_currency_line(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, currency_ix, line_ix, use_ix", f"{_MONTH} {_CURRENCY}", "line_ix >= 0"))
add("C23_cross_sector_line", lambda ws: C.cross_sector_line(ws.base, ws.dims),
    cube_sql("month_ix, flow_ix, purpose_ix, line_ix, use_ix", _MONTH, f"{_SHORT} AND line_ix >= 0"))

add("C24_lag", lambda ws: C.lag(ws.tx, ws.dims),
    f"""SELECT year_ix, bank_ix, {r2('median(lag_days)', 1)} AS median_lag,
          {r2('quantile_cont(lag_days, 0.9)', 1)} AS p90_lag,
          count(*) FILTER (WHERE late_sub) AS late, count(*) FILTER (WHERE future_dated) AS future,
          count(*) AS n
        FROM tx {_YEAR} {_BANK} WHERE lag_days IS NOT NULL GROUP BY year_ix, bank_ix""")
add("C25_quality", lambda ws: C.quality(ws.checks, ws.dims),
    f"""SELECT year_ix, bank_ix, count(*) AS n, count(*) FILTER (WHERE bad_fx) AS bad_fx,
          count(*) FILTER (WHERE null_amt) AS null_amt, count(*) FILTER (WHERE zero_amt) AS zero_amt,
          count(*) FILTER (WHERE neg_amt) AS neg_amt,
          count(*) FILTER (WHERE future_dated) AS future_dated,
          count(*) FILTER (WHERE pur2 = '99') AS unclassified,
          count(*) FILTER (WHERE country IS NULL) AS no_country,
          count(*) FILTER (WHERE method_raw IS NULL) AS no_method,
          count(*) FILTER (WHERE lsic IS NULL) AS no_lsic
        FROM coded {_YEAR} {_BANK} GROUP BY year_ix, bank_ix""")
add("C26_completeness", lambda ws: C.completeness(ws.checks, ws.dims),
    "SELECT year_ix, count(*) AS n, " + ", ".join(
        f"count(*) FILTER (WHERE {f} IS NULL OR trim(CAST({f} AS VARCHAR)) = '') AS no_{f}"
        for f, _, _ in values.QUALITY_FIELDS
    ) + f" FROM tx {_YEAR} GROUP BY year_ix")
add("C27_concentration", lambda ws: C.concentration(ws.tx, ws.dims),
    "SELECT year_ix, flow_ix, " + ", ".join(
        f"{r2(f'100 * sum(usd) FILTER (WHERE rn <= {k}) / max(tot)', 2)} AS top{k}" for k in (10, 100, 1000)
    ) + f""" FROM (SELECT year_ix, flow_ix, usd, sum(usd) OVER (PARTITION BY year_ix, flow_ix) AS tot,
              row_number() OVER (PARTITION BY year_ix, flow_ix ORDER BY usd DESC) AS rn
            FROM tx {_YEAR} WHERE usd > 0 AND use_ix = 1) GROUP BY year_ix, flow_ix""")
add("C28_flags", lambda ws: C.flags(ws.filed, ws.dims),
    cube_sql("""year_ix, flow_ix, use_ix, CASE WHEN m2_flag THEN 1 ELSE 0 END AS m2_ix,
      CASE WHEN move_flag THEN 1 ELSE 0 END AS move_ix""", _YEAR))
add("C29_goods_sides", lambda ws: C.goods_sides(ws.base),
    """SELECT code, side, measured, measured IS DISTINCT FROM side AS violates FROM goods_dim
       LEFT JOIN (SELECT pur5, CASE WHEN coalesce(sum(usd) FILTER (WHERE flow_ix = 1), 0)
           > coalesce(sum(usd) FILTER (WHERE flow_ix = 0), 0) THEN 'in' ELSE 'out' END AS measured
         FROM tx GROUP BY pur5) ON pur5 = code""")
add("C30_meta_totals", lambda ws: C.meta_totals(ws.tx),
    f"""SELECT count(*) AS n, count(DISTINCT Hash_ID) AS ids, min(tx_date)::DATE AS first_day,
          max(tx_date)::DATE AS last_day, {usd_m()} AS gross_usd_m FROM tx""")
add("C31_source_stats", lambda ws: C.source_stats(ws.tx),
    """SELECT Source_File, min(flow) AS flow, count(*) AS n, min(tx_date)::DATE AS first_day,
         max(tx_date)::DATE AS last_day FROM tx GROUP BY Source_File""")

# -- exceptions --------------------------------------------------------------

add("X1_fx_by_year_bank", lambda ws: X.fx_by_year_bank(ws.checks, ws.dims),
    f"""SELECT year_ix, bank_ix, count(*) FILTER (WHERE fx IS NULL) AS missing,
          count(*) FILTER (WHERE fx < 7000) AS low, count(*) FILTER (WHERE fx > 25000) AS high
        FROM tx {_YEAR} {_BANK} WHERE bad_fx GROUP BY year_ix, bank_ix""")
add("X2_ccy_rates", lambda ws: X.ccy_rates(ws.medians, ws.dims),
    f"SELECT currency_ix, yr, {r2('med')} AS rate FROM med {_CURRENCY}")
add("X3_usd_rates", lambda ws: ws.fx_medians.select("yr", F.round("med_fx", 3).alias("med_fx")),
    "SELECT yr, round(med_fx, 3) AS med_fx FROM usd_medians")
add("X4_fx_counts", lambda ws: X.fx_counts(ws.judged),
    """SELECT count(*) FILTER (WHERE usd IS NULL) AS missing, count(*) FILTER (WHERE usd <= 0) AS nonpos,
         count(*) FILTER (WHERE wrong) AS wrongrate, count(*) FILTER (WHERE usd > 0 AND off) AS band
       FROM judged""")
add("X5_fx_rows", lambda ws: X.fx_rows(ws.judged, ws.dims),
    f"""SELECT Hash_ID, ymd, coalesce(bank_ix, -1) AS bank_ix, flow_ix,
          coalesce(currency_ix, -1) AS currency_ix, {r2('amt_orig', 2)} AS amt,
          round(fxkip, 3) AS rate, round(med, 3) AS expected, {r2('j.usd', 2)} AS usd, ref,
          CASE WHEN j.usd IS NULL THEN 'missing' WHEN j.usd <= 0 THEN 'nonpos'
               WHEN wrong THEN 'wrongrate' ELSE 'band' END AS kind
        FROM judged j LEFT JOIN banks USING (bank) LEFT JOIN currencies USING (currency)
        WHERE j.usd IS NULL OR j.usd <= 0 OR wrong OR off
        ORDER BY CASE WHEN med IS NOT NULL AND fxkip > 0
            THEN abs(coalesce(j.usd, 0) * (med / fxkip) - coalesce(j.usd, 0))
            ELSE coalesce(j.usd, 0) END DESC, ymd, Hash_ID LIMIT 300""")

_KEYS = {t: ", ".join(DUPLICATE_TIERS[t]["keys"]) for t in DUPLICATE_TIERS}
for _number, _tier in (("X6", "A"), ("X7", "B"), ("X8", "C")):
    _extra = ", country, nm" if _tier == "A" else ""
    add(f"{_number}_dup_tier_{_tier.lower()}",
        lambda ws, t=_tier: ws.tiers[t].withColumn("usd", rounded(F.col("usd"), 2)),
        f"SELECT {_KEYS[_tier]}{_extra}, c, {r2('usd', 2)} AS usd FROM tier_{_tier}")


def _every_tier(ws, make):
    whole = None
    for tier, groups in ws.tiers.items():
        part = make(groups).withColumn("tier", F.lit(tier))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def _tier_sql(body: str) -> str:
    return " UNION ALL BY NAME ".join(body.format(t=t) for t in DUPLICATE_TIERS)


_EXCESS = "usd * (c - 1) / c"
add("X9_dup_summary", lambda ws: _every_tier(ws, X.dup_summary),
    _tier_sql(f"""SELECT '{{t}}' AS tier, count(*) AS groups, CAST(coalesce(sum(c - 1), 0) AS BIGINT)
      AS extra, {usd_m(_EXCESS)} AS usd_m FROM tier_{{t}}"""))
add("X10_dup_by_year_bank",
    lambda ws: _every_tier(ws, lambda g: X.dup_by_year_bank(g, ws.dims)),
    _tier_sql(f"""SELECT '{{t}}' AS tier, year_ix, bank_ix, CAST(sum(c - 1) AS BIGINT) AS extra,
      {usd_m('d.usd * (c - 1) / c')} AS usd_m FROM tier_{{t}} d {_YEAR} {_BANK}
      GROUP BY year_ix, bank_ix"""))


def _dup_rows(ws, tier):
    return X.dup_rows(ws.tiers[tier], DUPLICATE_TIERS[tier]["keys"], ws.dims)


_EDGE = " .,-_/\"''"


def _printed(column: str) -> str:
    """Names without white space and marks at their ends."""
    if column not in ("nm", "tr_name", "rc_name"):
        return f"d.{column}"
    return f"nullif(trim(regexp_replace(d.{column}, '[[:space:]]+', ' ', 'g'), '{_EDGE}'), '') AS {column}"


for _tier, _detail in (("A", "ref, nm, country"), ("B", "tr_name, rc_name, country, pur5"),
                       ("C", "country, pur5")):
    _order = ", ".join(f"d.{k}" for k in DUPLICATE_TIERS[_tier]["keys"])
    _shown = ", ".join(map(_printed, _detail.split(", ")))
    add(f"X11_dup_rows_{_tier.lower()}", lambda ws, t=_tier: _dup_rows(ws, t),
        f"""SELECT ymd, coalesce(bank_ix, -1) AS bank_ix,
              CASE WHEN flow = 'Payment' THEN 0 ELSE 1 END AS flow_ix,
              coalesce(currency_ix, -1) AS currency_ix, {r2('amt_orig', 2)} AS amt, c AS n,
              {r2('d.usd', 2)} AS usd, {_shown}
            FROM tier_{_tier} d LEFT JOIN banks b ON b.bank = d.bank
            LEFT JOIN currencies u ON u.currency = d.currency
            ORDER BY d.usd * (c - 1) / c DESC, {_order} LIMIT 300""")
add("X12_rate_band_check", lambda ws: X.rate_band_check(ws.tx),
    """SELECT Hash_ID, ymd, currency, fxkip, CASE WHEN fxkip = 0 THEN 'zero' WHEN fxkip < low
         THEN 'low' ELSE 'high' END AS kind FROM tx JOIN bands USING (currency)
       WHERE fxkip = 0 OR fxkip < low OR fxkip > high""")

# -- counterparties ----------------------------------------------------------

add("E1_entities_filtered",
    lambda ws: ws.ent.select("Hash_ID", "side", "nm", "other", "usd"),
    "SELECT Hash_ID, side, nm, other, usd FROM ent")
add("E2_placeholder_removed",
    lambda ws: E.placeholder_removed(E.entity_sides(ws.tx), ws.totals),
    f"""SELECT CAST((SELECT count(*) FROM sides) - (SELECT count(*) FROM ent) AS BIGINT) AS removed,
          {r2('((SELECT sum(usd) FROM sides) - (SELECT sum(usd) FROM ent)) / 1e6')} AS removed_usd_m""")
_TOTALS = ", ".join(f"{r2(f'{c} / 1e6')} AS {c}" for c in ("usd", "usd_in", "usd_out"))


def _totals(df):
    rows = df.withColumns({c: rounded(millions(F.col(c))) for c in ("usd", "usd_in", "usd_out")})
    return rows.drop("received", "sent")


add("E3_entity_totals", lambda ws: _totals(ws.totals),
    f"SELECT nm, n, {_TOTALS}, y0, y1 FROM party_totals")
add("E4_entity_keep", lambda ws: _totals(ws.keep),
    f"SELECT nm, ix, n, {_TOTALS}, y0, y1 FROM main_parties")
add("E5_entity_by_year", lambda ws: E.entity_by_year(ws.kept),
    f"SELECT ix, yr, flow_ix, count(*) AS n, {usd_m()} AS usd_m FROM kept GROUP BY ix, yr, flow_ix")
add("E6_entity_tops", lambda ws: E.entity_tops(ws.kept, ws.dims), ENTITY_TOPS)
add("E7_entity_tx", lambda ws: E.entity_tx(ws.kept, ws.dims), ENTITY_TX)


def _documents(ws):
    """The nested documents, described by their sizes and sums."""
    docs = E.entity_documents(ws.entity_parts)
    add_up = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, i: a + i[f])
    return docs.select(
        "ix", "nm", "n", "usd", "in", "out", "y0", "y1",
        *[F.size(c).alias(f"{c}_items") for c in ("years", "ctry", "pur", "bank", "curr", "tx")],
        rounded(add_up("tx", "usd"), 2).alias("tx_usd"),
        F.get("tx", F.lit(0))["other"].alias("first_other"),
        F.get("ctry", F.lit(0))["val_ix"].alias("first_country"),
    )


_COUNTS = ", ".join(
    f"coalesce((SELECT count(*) FROM tops t WHERE t.ix = k.ix AND t.kind = '{kind}'), 0) AS {kind}_items"
    for kind in ("ctry", "pur", "bank", "curr")
)
add("E8_entity_documents", _documents,
    f""", tops AS ({ENTITY_TOPS}), largest AS ({ENTITY_TX}),
    years_n AS (SELECT ix, count(*) AS c FROM (SELECT DISTINCT ix, yr, flow_ix FROM kept) GROUP BY ix),
    tx_n AS (SELECT ix, count(*) AS c, {r2('sum(usd)', 2)} AS s, max(CASE WHEN rn = 1 THEN other END) AS o
             FROM largest GROUP BY ix),
    tops_n AS (SELECT ix, kind, count(*) AS c, max(CASE WHEN rn = 1 THEN val_ix END) AS v
               FROM tops GROUP BY ix, kind)
    SELECT k.ix, k.nm, k.n, {r2('k.usd / 1e6')} AS usd, {r2('k.usd_in / 1e6')} AS "in",
      {r2('k.usd_out / 1e6')} AS out, y0, y1, CAST(y.c AS INTEGER) AS years_items,
      CAST(coalesce(c.c, 0) AS INTEGER) AS ctry_items, CAST(coalesce(p.c, 0) AS INTEGER) AS pur_items,
      CAST(coalesce(b.c, 0) AS INTEGER) AS bank_items, CAST(coalesce(u.c, 0) AS INTEGER) AS curr_items,
      CAST(t.c AS INTEGER) AS tx_items, t.s AS tx_usd, t.o AS first_other, c.v AS first_country
    FROM main_parties k JOIN years_n y ON y.ix = k.ix JOIN tx_n t ON t.ix = k.ix
    LEFT JOIN tops_n c ON c.ix = k.ix AND c.kind = 'ctry'
    LEFT JOIN tops_n p ON p.ix = k.ix AND p.kind = 'pur'
    LEFT JOIN tops_n b ON b.ix = k.ix AND b.kind = 'bank'
    LEFT JOIN tops_n u ON u.ix = k.ix AND u.kind = 'curr'""")
add("E9_entity_coverage",
    lambda ws: E.entity_coverage(ws.totals, E.entity_keep(ws.totals, 100)),
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE ix < 100) AS kept,
          {r2(f"100 * sum({r2('usd / 1e6')}) FILTER (WHERE ix < 100) / sum(usd / 1e6)", 1)} AS cover_pct
        FROM (SELECT usd, row_number() OVER (ORDER BY usd DESC NULLS LAST, nm) - 1 AS ix FROM party_totals)""")
_NAMES = f"""SELECT nm, count(*) AS n, {usd_m('CASE WHEN side = 1 THEN usd ELSE 0 END')} AS received,
  {usd_m('CASE WHEN side = 0 THEN usd ELSE 0 END')} AS sent FROM ent GROUP BY nm"""
add("E10_all_names", lambda ws: E.all_names(ws.totals), _NAMES)

# -- report views ------------------------------------------------------------

_LOW, _HIGH = "1997-03-15", "1999-10-02"
_RANGE = f"ymd BETWEEN '{_LOW}' AND '{_HIGH}'"
add("V1_period_report",
    lambda ws: V.period_report(C.day_line(ws.day, ws.dims), _LOW, _HIGH, banks=[0, 2, 5], uses=[1]),
    f"""SELECT flow_ix, line_ix, CAST(sum(n) AS BIGINT) AS n, {r2('sum(usd_m)')} AS usd_m
        FROM ({_DAY_LINE}) WHERE {_RANGE} AND bank_ix IN (0, 2, 5) AND use_ix = 1
        GROUP BY flow_ix, line_ix""")
add("V1_period_report_goods",
    lambda ws: V.period_report(C.day_goods(ws.day), _LOW, _HIGH),
    f"""SELECT flow_ix, goods_ix, {r2('sum(usd_m)')} AS usd_m FROM ({_DAY_GOODS})
        WHERE {_RANGE} GROUP BY flow_ix, goods_ix""")
add("V2_bank_shares",
    lambda ws: V.bank_shares(C.day_bank(ws.day, ws.dims), _LOW, _HIGH),
    f"""SELECT flow_ix, bank_ix, {r2('usd')} AS usd_m,
          {r2('100 * usd / sum(usd) OVER (PARTITION BY flow_ix)', 2)} AS share_pct
        FROM (SELECT flow_ix, bank_ix, sum(usd_m) AS usd FROM ({_DAY_BANK}) WHERE {_RANGE}
              GROUP BY flow_ix, bank_ix)""")
# The same reports from running totals: sums of a range as the difference of two rows per key.
_DAILY = {"line": lambda ws: C.day_line(ws.day, ws.dims), "goods": lambda ws: C.day_goods(ws.day), "bank": lambda ws: C.day_bank(ws.day, ws.dims)}


def _running(ws, name, grain=G.MONTH):
    return G.write_totals(G.running_totals(_DAILY[name](ws), grain))


add("V1_range_of_totals",
    lambda ws: G.period_report(_running(ws, "line"), _LOW, _HIGH, banks=[0, 2, 5], uses=[1]),
    f"""SELECT flow_ix, line_ix, CAST(sum(n) AS BIGINT) AS n, {r2('sum(usd_m)')} AS usd_m
        FROM ({_DAY_LINE}) WHERE {_RANGE} AND bank_ix IN (0, 2, 5) AND use_ix = 1
        GROUP BY flow_ix, line_ix""")
add("V1_range_of_totals_goods",
    lambda ws: G.period_report(_running(ws, "goods"), _LOW, _HIGH),
    f"""SELECT flow_ix, goods_ix, {r2('sum(usd_m)')} AS usd_m FROM ({_DAY_GOODS})
        WHERE {_RANGE} GROUP BY flow_ix, goods_ix""")
add("V2_shares_of_totals",
    lambda ws: G.bank_shares(_running(ws, "bank"), _LOW, _HIGH),
    f"""SELECT flow_ix, bank_ix, {r2('usd')} AS usd_m,
          {r2('100 * usd / sum(usd) OVER (PARTITION BY flow_ix)', 2)} AS share_pct
        FROM (SELECT flow_ix, bank_ix, sum(usd_m) AS usd FROM ({_DAY_BANK}) WHERE {_RANGE}
              GROUP BY flow_ix, bank_ix)""")
_TS_BANK = cube_sql("ym, flow_ix, bank_ix, use_ix", _BANK)
for _grain, _label in (
    ("quarter", "concat(ym[:4], '-Q', CAST(ceil(CAST(ym[6:] AS INTEGER) / 3) AS INTEGER))"),
    ("year", "ym[:4]"),
):
    add(f"V3_rollup_{_grain}",
        lambda ws, g=_grain: V.rollup_period(C.ts_bank(ws.base, ws.dims), ws.dims.months, g),
        f"""SELECT {_label} AS period, flow_ix, bank_ix, use_ix, CAST(sum(n) AS BIGINT) AS n,
              {r2('sum(usd_m)')} AS usd_m FROM ({_TS_BANK}) GROUP BY ALL""")
_CROSS = cube_sql("month_ix, flow_ix, country_ix, currency_ix, use_ix",
                  f"{_MONTH} {_COUNTRY} {_CURRENCY}")
add("V4_matrix",
    lambda ws: V.matrix(C.cross_country_currency(ws.base, ws.dims), "country_ix", "currency_ix",
                        range(5)),
    "SELECT country_ix, " + ", ".join(
        f"{r2(f'sum(usd_m) FILTER (WHERE currency_ix = {c})')} AS c{c}" for c in range(5)
    ) + f" FROM ({_CROSS}) GROUP BY country_ix")
add("V5_top_movers", lambda ws: V.top_movers(ws.day_entity, _LOW, _HIGH, 50),
    f"""SELECT flow_ix, name, {r2('usd')} AS usd_m FROM (
          SELECT flow_ix, name, sum(usd_m) AS usd FROM ({_DAY_ENTITY}) WHERE {_RANGE}
          GROUP BY flow_ix, name) ORDER BY usd DESC, flow_ix, name LIMIT 50""")
add("V5_movers_of_totals",
    lambda ws: G.top_movers(G.write_totals(G.running_totals(ws.day_entity, G.YEAR)), _LOW, _HIGH, 50),
    f"""SELECT flow_ix, name, {r2('usd')} AS usd_m FROM (
          SELECT flow_ix, name, sum(usd_m) AS usd FROM ({_DAY_ENTITY}) WHERE {_RANGE}
          GROUP BY flow_ix, name) ORDER BY usd DESC, flow_ix, name LIMIT 50""")


def _searched(ws, text):
    path = f"{shared_dir(ws.spark)}/names-{uuid.uuid4().hex}"
    N.write_index(E.all_names(ws.totals), path)
    return N.search(ws.spark, path, text)


for _name, _text in (("name", "Er#00000001"), ("part", "R#"), ("digits", "0000")):
    add(f"V6_indexed_{_name}", lambda ws, t=_text: _searched(ws, t),
        f"SELECT * FROM ({_NAMES}) WHERE contains(lower(nm), '{_text.lower()}')")
add("V6_search_names", lambda ws: V.search_names(E.all_names(ws.totals), "ER#00000001"),
    f"SELECT * FROM ({_NAMES}) WHERE contains(lower(nm), 'er#00000001')")
add("V7_summary_split",
    lambda ws: V.summary_split(C.day_line(ws.day, ws.dims), ws.config),
    f"""SELECT flow_ix, grp, {r2('sum(usd_m)')} AS usd_m,
          {r2('sum(usd_m) FILTER (WHERE NOT bank_own)')} AS business_usd_m
        FROM ({_DAY_LINE}) JOIN line_dim USING (line_ix) GROUP BY flow_ix, grp""")

# -- rules -------------------------------------------------------------------

_P = "coalesce(purpose, '')"
_M = "upper(coalesce(remark, ''))"


def _starts(x: str, *prefixes: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in prefixes) + ")"


_DEPOSIT = _starts(_P, "050104", "050204")
_PURPOSE_CASE = f"""CASE
  WHEN bank IN ('ICBCV', 'ICBC') AND {_DEPOSIT} THEN purpose
  WHEN bank IS DISTINCT FROM 'BCEL' AND flow = 'Receive' AND starts_with({_P}, '05020401') THEN purpose
  WHEN bank IN ('BOC', 'ICBC') AND flow = 'Receive' AND starts_with({_P}, '050105') THEN purpose
  WHEN bank IN ('BOC', 'ICBC') AND flow = 'Payment' AND purpose = '050105' THEN '02020'
  WHEN starts_with({_P}, '050203') THEN '050103'
  WHEN bank = 'BCEL' AND country = 'KR' AND {_DEPOSIT} THEN '0301'
  WHEN contains({_M}, 'MOVE FUND') THEN purpose
  WHEN {_DEPOSIT} THEN '0404' ELSE purpose END"""
_F = "coalesce(final_purpose, '')"
_SECTOR = _starts("coalesce(sector, '')", "02", "03")
_MONEYGRAM = "bank = 'BCEL' AND contains(upper(coalesce(name, '')), 'MONEYGRAM')"
_FINAL = f"(SELECT *, {_PURPOSE_CASE} AS final_purpose FROM rules)"
_CLEARING = f"(contains({_M}, 'CLEARING') OR contains({_M}, 'EXCHANGE'))"
_M2_CASE = f"""CASE WHEN flow = 'Payment' AND {_CLEARING} THEN 'Yes'
  WHEN {_starts(_F, '050105', '050205', '050204')} AND {_SECTOR} THEN 'No'
  WHEN {_starts(_F, '050103', '050104')} OR final_purpose = '07' OR bank = 'OPD' THEN 'No'
  WHEN {_MONEYGRAM} THEN 'No' WHEN flow = 'Receive' AND {_starts(_F, '05020301')} THEN 'No'
  ELSE 'Yes' END"""
_USE_CASE = f"""CASE
  WHEN bank IN ('ICBCV', 'ICBC') AND {_starts(_F, '050104', '050204')}
    THEN CASE flow WHEN 'Receive' THEN 'Deposit' ELSE 'Re_Deposit' END
  WHEN final_purpose IN ('050103', '05010302') THEN 'FX'
  WHEN contains({_M}, 'FORFEITING') THEN 'Repayment_ICBCV'
  WHEN bank IN ('ICBCV', 'BOC') AND {_SECTOR} AND (contains({_M}, 'REPAY') OR contains({_M}, 'PRINCIPAL'))
    THEN concat('Repayment_', bank)
  WHEN bank IN ('ICBCV', 'BOC') AND {_SECTOR} AND contains({_M}, 'LOAN') THEN concat('Loan_', bank)
  WHEN {_CLEARING} THEN 'Yes'
  WHEN {_starts(_F, '050105', '050205')} AND {_SECTOR} THEN 'No'
  WHEN {_starts(_F, '050103', '050104', '050204')} OR final_purpose = '07' THEN 'No'
  WHEN {_MONEYGRAM} THEN 'No'
  WHEN bank IN ('ICBCV', 'BOC') AND {_starts(_F, '05010504', '05010502', '05020503')} THEN 'No'
  WHEN {_starts(_F, '05020401')} THEN 'No'
  WHEN bank = 'OPD' AND {_starts(_F, '0302010301', '010302')} THEN 'No' ELSE 'Yes' END"""


def _ruled(ws):
    return R.purpose_transform(ws.rules)


add("R1_rule_hits",
    lambda ws: R.rule_hit(ws.rules, PURPOSE_RULES).select("id", "rule"),
    "SELECT id, " + _PURPOSE_CASE.replace("ELSE purpose END", "END")
    .replace("'02020'", "'boc_icbc_050105_to_02020'").replace("THEN '050103'", "THEN '050203_to_050103'")
    .replace("'0301'", "'bcel_kr_to_0301'").replace("'0404'", "'deposit_to_0404'")
    .replace("THEN purpose", "THEN 'icbc_deposit_keep'", 1)
    .replace("THEN purpose", "THEN 'nonbcel_05020401_keep'", 1)
    .replace("THEN purpose", "THEN 'boc_icbc_050105_keep'", 1)
    .replace("THEN purpose", "THEN 'move_fund_keep'", 1) + " AS rule FROM rules")
add("R2_purpose_transform", lambda ws: _ruled(ws).select("id", "final_purpose"),
    f"SELECT id, final_purpose FROM {_FINAL}")
add("R3_m2_flag", lambda ws: R.m2_flag(_ruled(ws)).select("id", "m2_rule"),
    f"SELECT id, {_M2_CASE} AS m2_rule FROM {_FINAL}")
add("R4_use_flag", lambda ws: R.use_flag(_ruled(ws)).select("id", "use_rule"),
    f"SELECT id, {_USE_CASE} AS use_rule FROM {_FINAL}")
add("R5_overrides",
    lambda ws: R.apply_overrides(_ruled(ws), ws.overrides).select("id", "final_purpose", "amount"),
    f"""SELECT id, coalesce(o.purpose, final_purpose) AS final_purpose,
          coalesce(o.amount, r.amount) AS amount
        FROM {_FINAL} r LEFT JOIN overrides o ON o.flow = r.flow AND o.row_no = r.row_no""")


def _own(ws):
    name = F.when(F.col("purpose_ix") % 3 == 0, F.concat("tr_name", F.lit(" boc LTD"))).when(
        F.col("purpose_ix") % 3 == 1, F.concat(F.lit("ທະນາຄານ "), F.col("tr_name"))).otherwise(
        F.col("tr_name"))
    rows = join_purposes(ws.tx, ws.dims)
    line_own = F.col("line_ix").isin(
        *[ix for ix, line in enumerate(ws.config.report_lines) if line[3]]
    )
    return rows.select("Hash_ID", R.bank_own(name, ws.config.own_patterns).alias("by_name"),
                       R.bank_own(name, ws.config.own_patterns, line_own).alias("own"))


add("R6_bank_own", _own,
    """SELECT Hash_ID, by_name, by_name OR coalesce(bank_own, FALSE) AS own FROM (
         SELECT Hash_ID, line_ix,
           tr_name IS NOT NULL AND purpose_ix % 3 IN (0, 1) AS by_name FROM coded)
       LEFT JOIN line_dim USING (line_ix)""")
add("R7_dup_tier_config",
    lambda ws: X.dup_summary(X.dup_tier(ws.tx_all, ["bank", "ref", "currency"], min_reference=3)),
    f"""SELECT count(*) AS groups, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS extra,
          {usd_m(_EXCESS)} AS usd_m
        FROM (SELECT count(*) AS c, sum(usd) AS usd FROM tx_all WHERE length(ref) >= 3
              GROUP BY bank, ref, currency HAVING count(*) > 1)""")
