"""Versioned publication and the store of years."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from remitra.operators import cubes as C
from remitra.operators.clean import clean, with_flow_use_ix
from remitra.operators.dedup import dedup
from remitra.plans.yearly import AGGREGATES, YearStore
from remitra.session import splits_of, stage
from remitra.sources import sinks
from remitra.sources.pack import Pack


def files_below(root):
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            if name.startswith("part-"):
                path = os.path.join(folder, name)
                found[path] = os.stat(path).st_mtime_ns
    return found


def test_a_failed_publication_leaves_the_last_one(spark, tmp_path):
    pack = Pack(spark, f"file://{tmp_path}/pack")
    assert pack.current() == []
    old = {"a": spark.range(3).toDF("k"), "b": spark.range(0).toDF("k")}
    assert pack.publish(old) == 1
    fails = spark.range(4).select(F.raise_error(F.lit("half way")).cast("long").alias("k"))
    for _ in range(2):
        with pytest.raises(Exception, match="half way"):
            pack.publish({"a": spark.range(9).toDF("k"), "b": fails})
        assert pack.read("a").count() == 3 and pack.read("b").count() == 0
        assert len(os.listdir(tmp_path / "pack" / "versions")) == 1
    with pytest.raises(ValueError, match="holds no c"):
        pack.read("c")


def test_versions_that_no_manifest_names_are_dropped(spark, tmp_path):
    pack = Pack(spark, f"file://{tmp_path}/pack")
    opened = None
    for k in range(1, 5):
        assert pack.publish({"a": spark.range(k).toDF("k")}) == k
        if opened is not None:
            assert opened.count() == k - 1  # who opened the one before can still read
        opened = pack.read("a")
        assert len(os.listdir(tmp_path / "pack" / "manifest")) <= 2
    assert len(files_below(tmp_path / "pack" / "versions")) <= 16 and pack.read("a").count() == 4
    assert sum(bool(os.listdir(tmp_path / "pack" / "versions" / v)) for v in os.listdir(tmp_path / "pack" / "versions")) == 2


def test_published_tables_are_sorted(spark, tmp_path):
    names = spark.range(3000).select(F.concat(F.lit("Nm"), (F.col("id") * 7919 % 3000).cast("string")).alias("nm"), F.lit(1).alias("n")).repartition(5)
    cube = spark.range(2000).select((F.col("id") * 31 % 50).cast("int").alias("month_ix"), (F.col("id") % 40).cast("int").alias("bank_ix"), F.lit(1.0).alias("usd_m"))
    sinks.write_payload({"all_names": names, "cube": cube}, f"file://{tmp_path}/pack")
    pack = Pack(spark, f"file://{tmp_path}/pack")
    for table, keys in (("all_names", ["lower(nm)", "nm"]), ("cube", ["month_ix", "bank_ix"])):
        ends = []
        path = next(p.path for p in pack.current() if p.table == table)
        for file in sorted(os.listdir(tmp_path / "pack" / path)):
            if file.startswith("part-"):
                rows = [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/pack/{path}/{file}").selectExpr(*keys).collect()]
                assert rows == sorted(rows)
                ends += [rows[0], rows[-1]] if rows else []
        assert ends == sorted(ends)


def rows_of(ws):
    return ws.raw.withColumns({"Flow": F.col("_flow"), "Source_Year": F.year("Date_of_Transaction").cast("long")})


def test_a_replaced_year_leaves_the_files_of_others(spark, ws, tmp_path):
    store = YearStore(spark, f"file://{tmp_path}/store")
    rows = rows_of(ws)
    years = sorted(r[0] for r in rows.select("Source_Year").distinct().collect())
    assert store.replace(rows) == years
    month = lambda: {tuple(r) for r in store.build().additive_cubes()["month"].collect()}
    whole, before = month(), files_below(tmp_path / "store" / "versions")
    assert store.replace(rows.filter("Source_Year = 1996 AND Flow = 'Payment' AND row_no % 2 = 0")) == [1996]
    after = files_below(tmp_path / "store" / "versions")
    assert all(after.get(path) == when for path, when in before.items())
    added = [path for path in after if path not in before]
    assert added and all("1996" in path for path in added)
    assert month() != whole
    assert store.replace(rows.filter("Source_Year = 1996 AND Flow = 'Payment'")) == [1996]
    assert month() == whole


def test_days_of_another_year_follow_their_extract(spark, ws, tmp_path):
    """Rows filed under a year they do not lie in are counted once, and go when their extract is replaced."""
    store = YearStore(spark, f"file://{tmp_path}/store")
    rows = rows_of(ws).filter("Source_Year IN (1996, 1997)")
    strays = rows.filter("Source_Year = 1997 AND row_no % 5 = 0").withColumn("Source_Year", F.lit(1996).cast("long"))
    store.replace(rows.unionByName(strays))
    count = lambda: store.build().base.filter("ym LIKE '1997%'").agg(F.sum("n")).first()[0]
    own = rows.filter("Source_Year = 1997 AND Date_of_Transaction IS NOT NULL").count()
    assert own <= count() <= own + strays.count()
    assert store.replace(rows.filter("Source_Year = 1996")) == [1996, 1997]
    assert count() == counted_apart(spark, tmp_path, rows)
    assert store.replace(rows.filter("Source_Year = 1997").withColumn("Date_of_Transaction", F.lit(None).cast("timestamp_ntz"))) == [1997]
    assert count() is None


def counted_apart(spark, tmp_path, rows):
    other = YearStore(spark, f"file://{tmp_path}/other")
    other.replace(rows.filter("Source_Year = 1997"))
    return other.build().base.agg(F.sum("n")).first()[0]


def test_raw_parts_are_written_without_moving_rows(ws, tmp_path):
    rows = ws.raw.withColumns({"Flow": F.col("_flow"), "Source_Year": F.year("Date_of_Transaction").cast("long")})
    spark, written = ws.spark, stage(rows, "test-raw")
    plans = []
    write = type(written.write).parquet

    def noted(self, path, *more, **options):
        plans.append((path, self._df._jdf.queryExecution().executedPlan().toString()))
        return write(self, path, *more, **options)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(written.write), "parquet", noted)
        store = YearStore(spark, str(tmp_path / "plain"))
        store.replace(written)
    raw = [plan for path, plan in plans if path.endswith("/raw")]
    assert len(raw) == 1 and "Exchange hashpartitioning" not in raw[0] and "REBALANCE" not in raw[0]
    stored = store.pack.read("raw")
    assert sorted(r.Hash_ID for r in stored.select("Hash_ID").collect()) == sorted(r.Hash_ID for r in written.select("Hash_ID").collect())


def test_aggregates_read_narrow_rows_and_move_them_once(ws, tmp_path):
    """Staged rows hold what the aggregates read, and an aggregate isn't shuffled again to be written by year."""
    rows = rows_of(ws).unionByName(rows_of(ws).filter("row_no % 3 = 0").withColumn("Hash_ID", F.concat(F.col("Hash_ID"), F.lit("!"))))
    spark, plans = ws.spark, []
    write = type(rows.write).parquet

    def noted(self, path, *more, **options):
        plans.append((path.rsplit("/", 1)[-1], self._df.columns, self._df._jdf.queryExecution().executedPlan().toString()))
        return write(self, path, *more, **options)

    store = YearStore(spark, f"file://{tmp_path}/store")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(rows.write), "parquet", noted)
        store.replace(rows)
    staged = {name: columns for name, columns, _ in plans if name.startswith(("tx-years", "marked", "kept"))}
    assert staged and all(not {"Hash_ID", "ref", "kip", "docs", "tr_tin", "Source_File"} & set(columns) for columns in staged.values())
    made = {name: plan for name, _, plan in plans if name in (*AGGREGATES, "checks")}
    assert len(made) == 6 and all("REBALANCE" not in plan and plan.count("Exchange hashpartitioning") == 1 for plan in made.values())
    tx = with_flow_use_ix(dedup(clean(rows.withColumn("_flow", F.col("Flow")))))
    show = lambda df: sorted(str([round(v, 3) if isinstance(v, float) else v for v in r]) for r in df.collect())
    stored = store.build()
    for name, make in {**AGGREGATES, "checks": C.base_checks}.items():
        got = stored.names if name == "names" else getattr(stored, name)
        assert show(got.select(make(tx).columns)) == show(make(tx))


def test_splits_are_bounded_for_a_while(spark):
    key = "spark.sql.files.maxPartitionBytes"
    read = lambda: spark.conf.get(key)
    usual = read()
    with splits_of(spark, "32m"):
        assert read() == "32m"
        with splits_of(spark, "64m"):  # smaller ones stay
            assert read() == "32m"
    assert read() == usual
    with pytest.raises(ValueError), splits_of(spark, "32m"):
        raise ValueError
    assert read() == usual
