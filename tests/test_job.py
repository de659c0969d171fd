"""Steps of a job, and what they leave behind."""

from __future__ import annotations

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from remitra.plans.job import Step, run
from remitra.plans.whole import Exports, import_and_publish
from remitra.session import shared_dir, stage
from remitra.sources.files import direction_of
from remitra.sources.pack import Pack


def jobs(spark):
    return {name for name in os.listdir(shared_dir(spark)) if name.startswith("job-")}


def test_results_go_with_their_last_reader(spark):
    seen = {}

    def root():
        return f"{shared_dir(spark)}/{next(iter(jobs(spark)))}"

    def look(name):
        seen[name] = {step for step in os.listdir(root()) if os.path.isdir(f"{root()}/{step}/result")}

    def first(_):
        stage(spark.range(3), "aside")
        return spark.range(5)

    def second(found):
        look("second")
        return found["first"].selectExpr("id * 2 AS id")

    def last(found):
        look("last")
        return found["second"].agg(F.sum("id")).first()[0]

    steps = {"last": Step(last, ("second",)), "first": Step(first), "second": Step(second, ("first",)), "other": Step(lambda found: found["first"].count(), ("first",))}
    assert run(spark, steps, at_once=1) == {"last": 20, "other": 5}
    assert "first" in seen["second"] and seen["last"] >= {"second"}
    assert not jobs(spark)


def test_a_failed_job_leaves_nothing(spark):
    def fails(found):
        stage(found["first"], "half")
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError, match="stop"):
        run(spark, {"first": Step(lambda _: spark.range(5)), "second": Step(fails, ("first",))})
    assert not jobs(spark)
    with pytest.raises(ValueError, match="no step x"):
        run(spark, {"a": Step(lambda _: 1, ("x",))})
    with pytest.raises(ValueError, match="wait for each other: a, b"):
        run(spark, {"a": Step(lambda _: 1, ("b",)), "b": Step(lambda _: 1, ("a",))})


def test_the_whole_run_stages_nothing_outside_its_folder(spark, ws, tmp_path):
    ws.cells, ws.book  # written before
    staged = set(os.listdir(f"{shared_dir(spark)}/staged"))
    out = f"file://{tmp_path}/out"
    exports = Exports(ws.cells, ws.book, ws.raw, date(1999, 1, 1), date(2000, 12, 31), refuse=False)
    flow = direction_of(F.col("file"), F.col("sheet"))
    assert import_and_publish(exports, flow, ws.config, out, ("flags", "banks_with_officers", "rules_in_force")) == 1
    pack = Pack(spark, out)
    assert pack.read("flags").filter("use_ix = 1").count() > 0 and pack.read("flags").select("flow_ix").distinct().count() == 2
    assert "officer" in pack.read("banks_with_officers").columns and pack.read("rules_in_force").count() > 20
    assert set(os.listdir(f"{shared_dir(spark)}/staged")) == staged and not jobs(spark)
    with pytest.raises(ValueError, match="five_headers.xlsx"):
        import_and_publish(Exports(ws.cells, ws.book, ws.raw, date(1999, 1, 1), date(2000, 12, 31)), flow, ws.config, out, ("flags",))
    assert Pack(spark, out).current()[0].path == pack.current()[0].path and not jobs(spark)
