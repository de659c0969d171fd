"""Building blocks against brute force, with one group that holds most rows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from remitra.checks.inputs import Workspace
from remitra.config.loader import Config
from remitra.operators import dedup as W
from remitra.operators import dims as D
from remitra.operators import entities as E
from remitra.operators import exceptions as X
from remitra.operators import rules as R
from remitra.operators import scale as S
from remitra.session import stage


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 40, n).astype(str))
    frame = pd.DataFrame({
        "k": key, "id": [f"{v:06d}" for v in rng.permutation(n)],
        "x": np.round(np.exp(rng.normal(8, 2, n)), 2), "w": rng.integers(1, 5, n),
    })
    frame.loc[frame.index % 50 == 0, "k"] = None
    return frame


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, id string, x double, w long")


def test_running_total(df, rows):
    got = S.running_total(df, ["k"], F.substring("id", 1, 3), [F.col("id")], F.col("w"), "upto")
    expected = rows.sort_values("id").assign(
        upto=lambda d: d.groupby("k", dropna=False)["w"].cumsum()
    ).set_index("id")["upto"].to_dict()
    assert {r["id"]: r["upto"] for r in got.collect()} == expected


def test_list_position(df, rows):
    order = [F.col("x").desc_nulls_last(), F.col("id")]
    got = S.list_position(df, order, S.value_bucket(F.col("x")), "ix").collect()
    expected = rows.sort_values(["x", "id"], ascending=[False, True])["id"].tolist()
    assert [r["id"] for r in sorted(got, key=lambda r: r["ix"])] == expected
    assert sorted(r["ix"] for r in got) == list(range(len(rows)))


def test_value_bucket_follows_the_order(spark):
    items = [5e9, 3.0, 1.0, 0.01, 0.0, -0.01, -3.0, -5e9, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v double")
    buckets = [r[0] for r in df.orderBy("i").select(S.value_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_exact_percentile(df, rows, share):
    got = S.exact_percentile(df.filter("k IS NOT NULL"), ["k"], "x", share, 20).collect()
    groups = rows.dropna(subset=["k"]).groupby("k")["x"]
    expected = {k: np.quantile(v, share) for k, v in groups if len(v) >= 20}
    assert {r["k"] for r in got} == set(expected)
    for r in got:
        assert r["result"] == pytest.approx(expected[r["k"]], rel=1e-12)


def test_median_needs_thirty_rows(spark):
    data = [("a", float(v)) for v in range(1, 30)] + [("b", float(v)) for v in range(1, 31)]
    df = spark.createDataFrame(data, "k string, x double")
    got = S.exact_percentile(df, ["k"], "x", 0.5, 30).collect()
    assert [(r["k"], r["n"], r["result"]) for r in got] == [("b", 30, 15.5)]


def test_group_size(df, rows):
    got = S.with_group_size(df, ["k"], "c").collect()
    sizes = rows["k"].value_counts(dropna=False)
    expected = {i: sizes[k] if k is not None else rows["k"].isna().sum() for i, k in zip(rows["id"], rows["k"])}
    assert {r["id"]: r["c"] for r in got} == expected
    assert len(got) == len(rows)


def test_even_slices_ascend(spark):
    ids = [f"bank-2024-{k:05d}" for k in range(3000)]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id string")
    got = [r[1] for r in df.select("id", S.even_slices(df, "id").alias("s")).orderBy("id").collect()][1:]
    assert got == sorted(got) and len(set(got)) > 50
    assert max(got.count(s) for s in set(got)) < 200


def test_top_k_per_group_cuts_before_the_shuffle(df, rows):
    got = S.top_k_per_group(df, ["k"], [F.desc("x"), F.col("id")], 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    expected = rows.sort_values(["x", "id"], ascending=[False, True]).groupby("k", dropna=False).head(5)
    assert {r["id"] for r in got.collect()} == set(expected["id"])
    spread = S.top_k_per_group(df, ["k"], [F.desc("x"), F.col("id")], 5, spread_by="id")
    assert {tuple(r) for r in spread.collect()} == {tuple(r) for r in got.collect()}


COPIES = [
    # id, bank, ref, currency: equal keys, a NULL currency, short and missing references, a NULL id.
    ("3", "A", "12345", "USD"), ("1", "A", "12345", "USD"), (None, "A", "12345", "USD"),
    ("2", "A", "12345", None), ("4", "A", "12345", None),
    ("5", "A", "123", "USD"), ("6", "A", "123", "USD"), ("7", "A", None, "USD"), ("8", "A", None, "USD"),
    ("9", None, "9999", "USD"), ("0", None, "9999", "USD"),
]


def test_repeat_submissions(spark):
    df = spark.createDataFrame(COPIES, "Hash_ID string, bank string, ref string, currency string")
    tx = df.withColumns({"flow": F.lit("Payment"), "ymd": F.lit("2020-01-01"), "amt_orig": F.lit(1.0)})
    ranks = {r["Hash_ID"]: r["dup_rank"] for r in W.rank_duplicates(tx).collect()}
    assert ranks == {"1": 1, "3": 2, None: 3, "2": 1, "4": 2, "5": 1, "6": 1, "7": 1, "8": 1, "0": 1, "9": 2}
    sizes = {r["Hash_ID"]: r["dup_count"] for r in W.rank_duplicates(tx).collect()}
    counts = {r["Hash_ID"]: r["dup_count"] for r in W.dup_count(tx).collect()}
    assert counts == sizes
    assert counts == {"1": 3, "3": 3, None: 3, "2": 2, "4": 2, "5": 1, "6": 1, "7": 1, "8": 1, "0": 2, "9": 2}
    kept = {r["Hash_ID"] for r in W.dedup(tx).collect()}
    assert kept == {"1", "2", "5", "6", "7", "8", "0"}
    assert tuple(W.dedup_report(tx).first()) == (7, 4, 11)


def test_dedup_drops_copies_before_the_shuffle(ws):
    plan = W.dedup(ws.tx_all)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("bits", [W.ROW_BITS, W.BITS])
def test_only_keys_that_repeat_are_shuffled_whole(spark, bits):
    amounts = [0.0, -0.0, float("nan"), None, 2.5]
    rows = [(f"{k:04d}", f"{k % 700:05d}" if k % 7 else f"9{k:05d}", amounts[k % 5]) for k in range(2100)] + [("0003", "00003", None)] * 2
    df = spark.createDataFrame(rows, "Hash_ID string, ref string, amt_orig double").withColumns({
        "bank": F.lit("A"), "currency": F.lit(None).cast("string"), "flow": F.lit("P"), "ymd": F.lit("2020-01-01")})
    groups = defaultdict(list)
    for name, ref, amount in rows:
        groups[ref, "nan" if amount != amount else amount].append(name)
    assert sorted(r.Hash_ID for r in W.dedup(df, bits).collect()) == sorted(min(names) for names in groups.values())
    marked = {r.ref for r in W.with_copy_mark(df, bits).filter("_copies").collect()}
    alone = {ref for (ref, _), names in groups.items() if len(names) == 1}
    assert marked >= {ref for (ref, _), names in groups.items() if len(names) > 1}
    assert bits < W.BITS or not marked & {ref for ref in alone if ref.startswith("9")}


def test_rows_without_copies_are_written_once(spark, ws):
    df = spark.createDataFrame(COPIES, "Hash_ID string, bank string, ref string, currency string")
    tx_all = stage(df.withColumns({"flow": F.lit("Payment"), "ymd": F.lit("2020-01-01"), "amt_orig": F.lit(1.0)}), "tx_all")
    view = W.dedup_view(tx_all)
    assert sorted(r.Hash_ID for r in view.collect()) == ["0", "1", "2", "5", "6", "7", "8"]
    written = [f for f in view.inputFiles() if "/kept-" in f]
    assert sorted(r.Hash_ID for r in spark.read.parquet(*written).collect()) == ["0", "1", "2"]
    assert set(ws.tx_all.inputFiles()) < set(ws.tx.inputFiles())


def test_dimensions_need_no_aggregate_by_all_keys(spark):
    rows = [(f"2020-{k % 3 + 1:02d}" if k % 11 else None, 2020 + k % 2, k % 2, 0, ["A.", "a", None, "B"][k % 4], ["LA", "TH", None][k % 3],
             ["USD", None][k % 2], ["010101", "", "02020"][k % 3], float(k) if k % 5 else None) for k in range(60)]
    tx = spark.createDataFrame(rows, "ym string, yr long, flow_ix int, use_ix int, bank string, country string, currency string, pur5 string, usd double")
    sums, by_all = D.key_sums(tx), D.base_month(tx)
    assert sums.count() == 4 + 2 + 4 + 3 + 2 + 3
    assert not sums.filter(" + ".join(f"cast({k} is not null as int)" for k in ("ym", "yr", "bank", "country", "currency", "pur5")) + " > 1").count()
    for make in (D.dim_months, D.dim_years, D.dim_currencies, lambda b: D.dim_countries(b, Config()), lambda b: D.dim_banks(b, Config())):
        assert sorted(map(str, make(sums).collect())) == sorted(map(str, make(by_all).collect()))
    built = Workspace(spark, "/root/testdata/sf0.001")
    assert built.dims.banks.count() > 0 and "base" not in vars(built)


def test_rows_of_an_entity_are_dropped_before_the_shuffle(spark, ws):
    plan = E.entity_tx(ws.kept, ws.dims, 5)._jdf.queryExecution().executedPlan().toString()
    assert "_slice" not in plan and plan.count("WindowGroupLimit") == 2  # one before the shuffle, one behind it


def test_staged_tables_are_packed_well(spark):
    assert all(f.endswith(".zstd.parquet") for f in stage(spark.range(5), "small").inputFiles())


def test_ranks_take_one_shuffle_and_one_read(ws):
    plan = W.rank_duplicates(ws.tx_all)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_groups_too_large_for_a_task_are_cut(spark):
    rows = [(f"{(k * 7919) % 5000:04d}" if k % 50 else None, "A" if k % 3 else f"B{k % 40}") for k in range(5000)]
    df = spark.createDataFrame(rows, "Hash_ID string, bank string").withColumns({
        "ref": F.lit("12345"), "currency": F.lit("USD"), "flow": F.lit("P"), "ymd": F.lit("2020-01-01"), "amt_orig": F.lit(1.0)})
    assert W.hot_groups(df, 100, 2).count() == 1
    got = W.rank_duplicates(df, 100, 2).select("bank", "Hash_ID", "dup_rank", "dup_count").collect()
    groups = defaultdict(list)
    for name, bank in rows:
        groups[bank].append(name)
    want = []
    for bank, names in groups.items():
        order = sorted(names, key=lambda n: (n is None, n or ""))
        want += [(bank, n, k + 1, len(order)) for k, n in enumerate(order)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicate_tiers_shuffle_only_rows_that_may_repeat(spark):
    amounts = [0.0, -0.0, float("nan"), None, 2.5]
    rows = [(f"{k % 700:05d}" if k % 7 else f"9{k:05d}", None if k % 11 == 0 else "A", amounts[k % 5], float(k)) for k in range(2100)]
    df = spark.createDataFrame(rows, "ref string, bank string, amt_orig double, usd double").withColumns({
        "country": F.lit("X"), "tr_name": F.lit("n"), "rc_name": F.lit(None).cast("string")})
    groups = defaultdict(list)
    for ref, bank, amount, usd in rows:
        groups[ref, bank, "nan" if amount != amount else amount].append(usd)
    want = sorted((ref, str(bank), str(amount + 0.0 if isinstance(amount, float) else amount), len(v), sum(v))
                  for (ref, bank, amount), v in groups.items() if len(v) > 1)
    found = X.dup_tier(df, ["ref", "bank", "amt_orig"], min_reference=4)
    got = sorted((r.ref, str(r.bank), str(r.amt_orig if r.amt_orig is None else r.amt_orig + 0.0), r.c, r.usd) for r in found.collect())
    assert got == want and len(want) > 100
    plan = plan_of(found)
    assert "_words" in plan and "BroadcastHashJoin" in plan
    assert X.dup_tier(df.limit(0), ["ref", "bank", "amt_orig"]).count() == 0


def test_corrections_move_only_corrected_rows(spark):
    df = spark.createDataFrame(
        [("P", k if k % 50 else None, f"c{k}", float(k)) for k in range(300)] + [(None, 7, "n", 1.0), ("P", 8, "again", 8.0)],
        "flow string, row_no int, final_purpose string, amount double")
    given = spark.createDataFrame(
        [("P", 8, "x", None), ("P", 9, None, 99.0), ("P", 10, "y", 1.0), ("P", 10, "z", 2.0), ("R", 11, "r", 0.0), (None, 7, "no", 0.0), ("P", None, "no", 0.0)],
        "flow string, row_no long, purpose string, amount double")
    want = []
    for r in df.collect():
        hits = [g for g in given.collect() if None not in (g.flow, g.row_no) and (g.flow, g.row_no) == (r.flow, r.row_no)]
        for g in hits or [None]:
            want.append((r.flow, r.row_no, g.purpose if g and g.purpose is not None else r.final_purpose, g.amount if g and g.amount is not None else r.amount))
    got = R.apply_overrides(df, given)
    assert got.columns == ["flow", "row_no", "final_purpose", "amount"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "_words" in plan_of(got)


def test_corrections_are_not_broadcast_by_their_files_size(spark):
    given = spark.range(20_000).select(
        F.lit("P").alias("flow"), F.col("id").alias("row_no"), F.lit("0601").alias("purpose"), F.lit(None).cast("double").alias("amount"))
    df = spark.range(100).select(F.lit("P").alias("flow"), F.col("id").alias("row_no"), F.lit("x").alias("final_purpose"), F.lit(1.0).alias("amount"))
    got = R.apply_overrides(df, given)
    plan = plan_of(got)
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2  # the bits, in either part
    assert {r.final_purpose for r in got.collect()} == {"0601"}


def test_tiers_write_their_input_once(spark, ws, monkeypatch):
    from remitra.plans import build

    made, stage = [], build.stage
    monkeypatch.setattr(build, "stage", lambda df, name: made.append(name) or stage(df, name))
    tiers = build.Build(ws.raw, ws.config).tiers
    assert sorted(tiers) == ["A", "B", "C"] and made == ["tx_all"]
