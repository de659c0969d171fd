"""The fixture has the measured profile, and the cubes agree with each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitra.checks.inputs import CODES
from remitra.operators import cubes as C
from remitra.operators import dedup as W
from remitra.operators import exceptions as X


def test_codes_have_twenty_slots():
    assert len(CODES) == 120


def test_measured_profile(ws):
    tx = ws.tx.agg(
        F.count("*").alias("n"), F.count_if(F.col("bank").isNull()).alias("no_bank"),
        F.count_if("null_amt").alias("null_usd"), F.count_if("future_dated").alias("future"),
        F.count_if("late_sub").alias("late"), F.count_if("bad_fx").alias("fx"),
        F.count_if(F.col("pur5") == "02020").alias("odd"),
    ).first()
    assert tuple(tx) == (6185, 39, 39, 428, 1372, 39, 312)
    assert ws.tx_all.count() == 6258
    assert ws.tx_all.select("Hash_ID").distinct().count() == 6258
    counts = X.fx_counts(ws.judged).first()
    assert (counts["wrongrate"], counts["band"]) == (65, 0)
    name = F.coalesce("tr_name", "rc_name")
    days = ws.tx.filter(name.isNotNull()).groupBy("ymd", "flow_ix", name, "use_ix").agg(F.sum("usd").alias("usd"))
    assert days.filter("usd >= 500000").count() == 4140
    extra = {t: X.dup_summary(g).first()["extra"] for t, g in ws.tiers.items()}
    assert extra == {"A": 73, "B": 250, "C": 0}


def test_removed_copies_are_the_extra_rows_of_tier_a(ws):
    report = W.dedup_report(ws.tx_all).first()
    assert report["removed"] == X.dup_summary(ws.tiers["A"]).first()["extra"]
    assert report["kept"] == ws.tx.count()


def test_no_goods_code_runs_the_wrong_way(ws):
    assert C.goods_side_violations(ws.base).count() == 0


def test_cubes_share_their_totals(ws):
    base, dims = ws.base, ws.dims
    total = lambda df: df.agg(F.sum("n")).first()[0]
    assert total(C.cube_month(base, dims)) == ws.tx.count()
    assert total(C.ts_bank(base, dims)) == total(C.cube_bank(base, dims))
    assert total(C.day_bank(ws.day, dims)) == total(C.cube_bank(base, dims))
    assert total(C.day_line(ws.day, dims)) == total(C.ts_line(base, dims))
    assert total(C.cube_country(base, dims)) == ws.tx.filter("country IS NOT NULL").count()


def test_odd_code_lengths_stay_unmatched(ws):
    from remitra.operators.fact import join_codes

    odd = join_codes(ws.tx.filter("pur5 = '02020'"), ws.dims)
    assert {tuple(r) for r in odd.select("purpose_ix", "pur2", "line_ix").distinct().collect()} == {
        (-1, "99", -1)
    }
