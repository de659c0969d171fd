"""Wall time of the full build and its parts, as one JSON line.

The folder is $BENCH_SF_DIR (default sf0.1), the cores $BENCH_CPUS (default 8).
The value is the whole job, from raw extracts to the last written table, with
independent tables under way side by side. Each part is then timed alone, on
tables made anew and into a sink that drops the rows; imports and rate pages
are timed the same way but are not part of the whole.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from remitra.checks.catalog import QUERIES  # noqa: E402
from remitra.checks.inputs import Workspace  # noqa: E402
from remitra.session import local_session, shared_dir  # noqa: E402
from remitra.sources.files import union_flows  # noqa: E402
from remitra.sources.sinks import write_payload  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
INTAKE = ["I20_import_by_header", "I21_import_by_position", "S12_kept_beside_rejects", "K7_rates_table", "R4_use_flag",
          "W1_rank_duplicates", "W2_dup_count", "W4_dedup_report", "P11_fix_mojibake"]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def fresh(spark) -> Workspace:
    """The job starts from yearly extracts in two formats, which are made beforehand; reading them is part of it."""
    ws = Workspace(spark, FOLDER)
    ws.root
    return ws


def read(ws: Workspace) -> None:
    ws.raw = union_flows(ws.spark, ws.root)


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS))
    drain(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    times: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    ws = fresh(spark)
    start = time.perf_counter()
    read(ws)
    write_payload(ws.tables(), f"{shared_dir(spark)}/bench")
    total = round(time.perf_counter() - start, 3)

    ws = fresh(spark)
    timed("stage_read", lambda: read(ws))
    for part in ("tx_all", "tx", "base", "day", "filed", "checks", "names", "entity_days", "dims", "medians", "fx_medians", "tiers",
                 "day_entity", "day_names", "totals", "keep", "entity_parts"):
        timed(f"stage_{part}", lambda p=part: getattr(ws, p))
    for name, df in {**ws.cubes(), **ws.exceptions(), **ws.entities()}.items():
        timed(name, lambda d=df: drain(d))
    ws = Workspace(spark, FOLDER)
    ws.cells, ws.book, ws.tx_all, ws.filed_root
    for name in INTAKE:
        timed(name, lambda n=name: drain(QUERIES[n](ws)))
    print(json.dumps({
        "metric": "full build: clean, deduplicate, dimensions, cubes, exceptions, counterparties",
        "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
