"""Raw extracts and base aggregates by year: an extract that is sent again recomputes its own years.

Copies of a report share the day of the transaction, so deduplication, and with it
every base aggregate, falls apart by calendar year of that day. A direction and
year that is replaced touches the calendar years that its old and its new rows lie
in, mostly one; those are cleaned, deduplicated and aggregated again from the
raw parts that hold them, and all other years' files stay as they are. Cubes are
sums over all parts. Raw parts and aggregates become visible together, by one
manifest.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitra.config.loader import Config
from remitra.operators import cubes as C
from remitra.operators import dims as D
from remitra.operators.clean import clean, with_flow_use_ix
from remitra.operators.dedup import dedup_columns
from remitra.operators.imports import conform
from remitra.plans.build import Build
from remitra.session import side_by_side, splits_of
from remitra.sources.pack import Pack, Part

#: What a calendar year keeps of its transactions.
AGGREGATES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "base": D.base_month, "day": C.base_day, "filed": C.base_filed, "names": D.name_counts, "entity_days": C.entity_days,
}
#: What those read of a transaction; tests on other columns are kept by their outcome.
READ = [
    "ym", "ymd", "yr", "flow_ix", "use_ix", "bank", "country", "currency", "pur5", "purpose_name", "method_raw", "usd", "m2_flag", "move_flag",
    "tr_name", "rc_name",
]
#: Of those columns some two million rows, which may be as many groups of an aggregate.
SPLITS = "32m"
RAW = "raw"


def with_part(rows: DataFrame) -> DataFrame:
    """Canonical columns, and the direction and year that a raw part is named by."""
    return conform(rows).withColumns({
        "_f": F.coalesce("Flow", F.lit("none")), "_y": F.coalesce(F.col("Source_Year").cast("string"), F.lit("none")),
    })


class YearStore:
    """A folder of raw parts by direction and year, and of aggregates by calendar year."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.pack, self.config = spark, Pack(spark, root), config or Config()

    def replace(self, rows: DataFrame) -> list[int]:
        """Store canonical ``rows``, each direction and year in place of what was there; the calendar years computed anew.

        Rows need ``Flow`` and ``Source_Year``. Undated rows are kept raw and count nowhere.
        """
        before, folder = self.pack.current(), self.pack.new_folder()
        try:
            new = self._write_raw(rows, folder)
            names = {p.part for p in new}
            old = [p for p in before if p.table == RAW and p.part in names]
            raw = [p for p in before if p.table == RAW and p.part not in names] + new
            touched = sorted({year for p in old + new for year in json.loads(p.note)})
            stays = [p for p in before if p.table != RAW and int(p.part) not in touched]
            made = self._aggregate([p for p in raw if set(json.loads(p.note)) & set(touched)], touched, folder) if touched else []
        except BaseException:
            self.pack.drop([folder])
            raise
        self.pack.commit(raw + stays + made)
        return touched

    def _write_raw(self, rows: DataFrame, folder: str) -> list[Part]:
        keys = ["_f", "_y"]
        keyed = with_part(rows)
        # Whole rows aren't shuffled for this: each task writes what it holds of a direction and year.
        keyed.write.partitionBy(*keys).parquet(f"{self.pack.root}/{folder}/{RAW}", compression="zstd")
        written = self.spark.read.schema(keyed.schema).parquet(f"{self.pack.root}/{folder}/{RAW}")
        years = F.sort_array(F.collect_set(F.year("Date_of_Transaction")))
        schema = keyed.drop(*keys).schema.json()
        return [
            Part(RAW, f"{r['_f']}/{r['_y']}", f"{folder}/{RAW}/_f={r['_f']}/_y={r['_y']}", schema, json.dumps(r.years))
            for r in written.groupBy(*keys).agg(years.alias("years")).collect()  # a row per direction and year
        ]

    def _aggregate(self, raw: list[Part], years: list[int], folder: str) -> list[Part]:
        """Aggregates of whole calendar years, from all raw parts that hold their days; a year left without rows has none."""
        if not raw:
            return []
        rows = self.pack.read(RAW, raw).filter(F.year("Date_of_Transaction").isin(years)).withColumn("_flow", F.col("Flow"))
        tests = C.failed_tests(self.config.rules.usd_band)
        outcomes = [test.alias(f"test {name}") for name, test in tests.items()]
        tx_all = with_flow_use_ix(clean(rows, self.config.rules.usd_band))
        tx = dedup_columns(tx_all, [*READ, *outcomes, F.year("tx_date").alias("_cal")])
        known = {name: F.col(f"`test {name}`") for name in tests}
        makers = {**AGGREGATES, "checks": lambda tx, year: C.counted_tests(tx, known, year)}

        def write(name: str) -> list[Part]:
            whole = makers[name](tx, "_cal")
            # A task of the aggregation writes what it holds of each year; its rows aren't shuffled again for that.
            whole.write.partitionBy("_cal").parquet(f"{self.pack.root}/{folder}/{name}", compression="zstd")
            schema = whole.drop("_cal").schema.json()
            held = self.spark.read.schema(whole.schema).parquet(f"{self.pack.root}/{folder}/{name}").select("_cal").distinct().collect()
            return [Part(name, str(r[0]), f"{folder}/{name}/_cal={r[0]}", schema) for r in held]

        with splits_of(self.spark, SPLITS):
            written = side_by_side(self.spark, {name: partial(write, name) for name in makers})
        return [part for parts in written.values() for part in parts]

    def build(self) -> StoredBuild:
        return StoredBuild(self)


class StoredBuild(Build):
    """The build as far as it is sums of stored aggregates: dimensions and the additive cubes."""

    def __init__(self, store: YearStore):
        super().__init__(raw=None, config=store.config)
        self.store, self.parts = store, store.pack.current()

    def _stored(self, name: str) -> DataFrame:
        """All parts of an aggregate; none has a row where the store holds no dated transaction."""
        return self.store.pack.read(name, self.parts)

    base = cached_property(lambda self: self._stored("base"))
    key_sums = cached_property(lambda self: self.base)  # dimensions come from either
    day = cached_property(lambda self: self._stored("day"))
    filed = cached_property(lambda self: self._stored("filed"))
    names = cached_property(lambda self: self._merged_names())
    checks = cached_property(lambda self: self._stored("checks"))
    entity_days = cached_property(lambda self: self._stored("entity_days"))

    def _merged_names(self) -> DataFrame:
        return self._stored("names").groupBy("pur5", "purpose_name").agg(F.sum("n").alias("n"))
