"""Ranges of days from running totals, and names by n-grams, against plain sums and scans."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from remitra.operators import ranges as G
from remitra.operators import search as N


@pytest.fixture(scope="module")
def cube(spark):
    draw = random.Random(4)
    days = [f"{y}-{m:02d}-{d:02d}" for y in (2019, 2020, 2022) for m in (1, 2, 5, 12) for d in (1, 2, 15, 28)]
    rows = {(draw.choice(days), draw.randrange(3), draw.randrange(4)): (draw.randint(1, 9), draw.choice([-1, 1]) * draw.randint(0, 5000) / 1000) for _ in range(150)}
    rows[("2020-05-15", 0, 9)], rows[("2020-05-28", 0, 9)] = (1, 2.5), (1, -2.5)  # values that add up to nothing
    data = [(*key, *value) for key, value in rows.items()]
    return spark.createDataFrame(data, "ymd string, flow_ix int, bank_ix int, n long, usd_m double"), data


RANGES = [
    ("2019-01-01", "2022-12-31"), ("2020-05-15", "2020-05-15"), ("2020-05-02", "2020-05-28"), ("2019-02-02", "2020-12-01"), ("2021-01-01", "2021-12-31"),
    ("2000-01-01", "2018-12-31"), ("2019-12-28", "2022-01-01"), ("2023-01-01", "2024-01-01"), ("2021-06-01", "2030-01-01"), ("1990-01-01", "2019-01-01"),
]


@pytest.mark.parametrize("grain", [G.MONTH, G.YEAR])
def test_any_range(cube, grain):
    df, data = cube
    totals = G.write_totals(G.running_totals(df.repartition(3), grain))
    for low, high in RANGES:
        want = defaultdict(lambda: [0, 0.0])
        for day, flow, bank, n, usd in data:
            if low <= day <= high:
                want[flow, bank][0] += n
                want[flow, bank][1] += usd
        got = {(r.flow_ix, r.bank_ix): (r.n, round(r.usd_m, 3)) for r in G.between(totals, low, high).collect()}
        assert got == {k: (n, round(usd, 3) + 0.0) for k, (n, usd) in want.items()}, (low, high)
    plan = G.between(totals, "2019-02-02", "2020-12-01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("PartitionFilters: [isnotnull(period") == 2


def test_names_by_grams(spark, tmp_path):
    draw = random.Random(7)
    names = sorted({"".join(draw.choices("abAB cÉé国0.%_", k=draw.randint(1, 12))) for _ in range(600)} | {"x" * 300, "İstanbul", "a"})
    df = spark.createDataFrame([(n, k) for k, n in enumerate(names)] + [(None, -1)], "nm string, n int")
    path = f"file://{tmp_path}/names"
    N.write_index(df, path)
    lower = {r.nm: r.low for r in df.filter("nm is not null").select("nm", F.lower("nm").alias("low")).collect()}
    for text in ["a", "AB", "ab ", "é国", "aba", "b.%_", "c É", "xxxxxx", "zzz", "", "İ", "a" * 20, "国"]:
        want = sorted(n for n in names if text.lower() in lower[n])
        assert sorted(r.nm for r in N.search(spark, path, text).collect()) == want, text
    plan = N.search(spark, path, "b.%_")._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: [")
    assert any(part.startswith(("list#", "(list#", "((list#")) for part in folders[1:]), plan
