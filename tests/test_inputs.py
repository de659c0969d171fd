"""The test inputs, whose Spark side joins in an order of its own."""

from __future__ import annotations

import glob
import gzip
import os

from pyspark.sql import functions as F

from remitra.checks import inputs
from remitra.checks.inputs import RAW, Workspace
from remitra.session import stage
from remitra.sources import files


def small(spark, folder):
    rows = {
        "nation": ([(1, "NATION_1"), (1, "TWICE"), (None, "NONE")], "n_nationkey int, n_name string"),
        "supplier": ([(5, "S5", 1), (5, "S5b", 1), (6, "S6", None), (7, "S7", 1), (None, "S", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": ([(1, "C1"), (1, "C1"), (2, None), (None, "C")], "c_custkey long, c_name string"),
        "orders": ([(10, 1, "5-LOW"), (10, 2, None), (11, 2, "1-URGENT"), (12, None, "2-HIGH"), (None, 1, "x")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": (
            [(o, p, s, n, 3.0, 10.0 * n, 0.05, flag, "F", "1998-05-01") for o in (10, 11, 12, None) for p in (3, None) for s in (5, 6, 7, None) for n, flag in ((1, "R"), (2, None))],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
            "l_returnflag string, l_linestatus string, _day string",
        ),
    }
    for name, (data, schema) in rows.items():
        df = spark.createDataFrame(data, schema)
        if name == "lineitem":
            df = df.selectExpr("* except (_day)", "cast(_day as timestamp_ntz) l_shipdate")
        df.write.parquet(f"{folder}/{name}.parquet")
    return Workspace(spark, str(folder))


def test_raw_rows_are_those_of_the_statement(spark, tmp_path):
    ws = small(spark, tmp_path)
    want = ws.shared(RAW)
    assert ws.raw.schema.names == want.schema.names and ws.raw.dtypes == want.dtypes
    show = lambda df: sorted(map(str, df.collect()))
    assert show(ws.raw) == show(want) and ws.raw.count() > 40 and ws.raw.filter("Hash_ID like '%-r'").count() > 0


def test_raw_rows_move_narrow_and_once(spark, tmp_path):
    """Lines are read once, and nothing is shuffled after the columns are made."""
    plan = small(spark, tmp_path).raw._jdf.queryExecution().executedPlan().toString()
    first = plan.index("Exchange hashpartitioning")
    assert "RoundRobin" not in plan and plan.count("FileScan parquet [l_") == 1
    assert 0 < plan.index("AS Hash_ID#") < first and "AS Hash_ID#" not in plan[first:]


def test_filed_extracts_are_zipped_in_bounded_files_and_read_whole(spark, tmp_path, monkeypatch):
    """As plain text they were the largest part of what the queries on rejects keep on disk."""
    monkeypatch.setattr(inputs, "ZIPPED_ROWS", 5)
    ws = small(spark, tmp_path)
    ws.written = stage(ws.raw.withColumn("row_no", F.monotonically_increasing_id()), "numbered")
    parts = glob.glob(f"{ws.filed_root.removeprefix('file://')}/*/all.csv/part-*")
    texts = [gzip.open(p).read() if p.endswith(".gz") else open(p, "rb").read() for p in parts]
    assert all(p.endswith(".csv.gz") for p in parts) and sum(map(len, texts)) > 2 * sum(os.path.getsize(p) for p in parts)
    assert max(t.count(b"\n\"") for t in texts) <= 5 and len(parts) >= ws.raw.count() / 5
    read = files.read_flows(spark, ws.filed_root)
    raw = ws.written.collect()
    rows = read.rows.select("Hash_ID", F.col("row_no").cast("long")).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str((r.Hash_ID, r.row_no)) for r in raw)
    lost = {(r.field, r.filed): r["count"] for r in read.rejects.groupBy("field", "filed").count().collect()}
    tests = {("Exchange_Rates_Kip", "n/a\n(see note)"): lambda n: n % 17 == 0, ("Source_Year", "FY98"): lambda n: n % 19 == 0,
             ("Date_of_Transaction", "pending"): lambda n: n % 13 == 0, ("Amount_USD", "1,234.50"): lambda n: n % 10 == 3}
    for key, test in tests.items():
        assert lost.get(key, 0) == sum(test(r.row_no) for r in raw)
    assert sum(lost.values()) > 10
