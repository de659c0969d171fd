"""Lookup tables as DataFrames, with an optional folder of JSON files that override them."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from remitra.config import declared, values


@dataclass
class Config:
    """All declared lookups. Files absent from the folder leave the built-in values."""

    report_lines: list[tuple] = field(default_factory=lambda: list(values.REPORT_LINES))
    own_patterns: list[str] = field(default_factory=lambda: list(values.OWN_PATTERNS))
    bank_aliases: dict[str, str] = field(default_factory=lambda: dict(values.BANK_ALIASES))
    blocklist: list[str] = field(default_factory=lambda: sorted(values.PLACEHOLDER_NAMES))
    acronyms: list[str] = field(default_factory=lambda: list(values.ACRONYMS))
    purpose_names: dict[str, dict] = field(default_factory=dict)
    country_names_lo: dict[str, str] = field(default_factory=dict)
    officers: dict[str, str] = field(default_factory=dict)
    bank_names_lo: dict[str, str] = field(default_factory=dict)
    rules: declared.Rules = field(default_factory=declared.Rules)

    def __post_init__(self) -> None:
        self.report_lines = sorted(self.report_lines, key=lambda line: line[1])


def _documents(folder: str, spark: SparkSession | None) -> dict[str, dict]:
    """The JSON files of a folder by name, read by Spark where a session is given, so from any store it reaches."""
    if spark is None:
        texts = {}
        for name in os.listdir(folder):
            if name.endswith(".json"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    texts[name] = f.read()
    else:
        files = spark.read.option("wholetext", True).text(f"{folder}/*.json").select("_metadata.file_path", "value")
        texts = {}
        for path, text in files.orderBy("file_path").collect():  # bounded lookups, written by hand
            name = next(part for part in unquote(path).split("/")[::-1] if part.endswith(".json"))
            texts[name] = texts.get(name, "") + text
    return {name: json.loads(text) for name, text in texts.items()}


def load_config(folder: str | None = None, spark: SparkSession | None = None) -> Config:
    """Lookups and rules of an override folder, each file holding one bounded list; on the driver's disk without a session."""
    if folder is None:
        return Config()
    documents = _documents(folder, spark)
    _read = lambda name, key: documents.get(name, {}).get(key)
    given: dict = {
        "bank_aliases": _read("bank_aliases.json", "aliases"),
        "purpose_names": _read("purpose_names.json", "names"),
        "country_names_lo": _read("country_names_lo.json", "names"),
        "officers": _read("bank_officers.json", "officers"),
        "bank_names_lo": _read("bank_officers.json", "names_lo"),
    }
    if "bop_rules.json" in documents:
        given["rules"] = declared.parse(documents["bop_rules.json"])
    acronyms = _read("name_acronyms.json", "acronyms")
    if acronyms is not None:
        given["acronyms"] = [a.strip().upper() for a in acronyms if a.strip()]
    # The built-in placeholders can be added to, never shrunk.
    extra = _read("name_blocklist.json", "names") or []
    given["blocklist"] = sorted(
        {*values.PLACEHOLDER_NAMES, *(n.strip().upper() for n in extra if n.strip())}
    )
    lines = _read("report_lines.json", "lines")
    if lines is not None:
        given["report_lines"] = [
            (x["id"], x["order"], x.get("group", "financial"), bool(x.get("bankOwn")),
             list(x["codes"]), bool(x.get("catchAll")), x["lo"], x["en"])
            for x in lines
        ]
    rule = _read("report_lines.json", "bankOwnRule")
    if rule is not None:
        given["own_patterns"] = rule.get("namePatterns", [])
    return Config(**{k: v for k, v in given.items() if v is not None})


def _frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    # An Arrow table becomes a local relation: no Python worker, and the planner knows its size.
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [()] * len(arrow)
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow))


def pur2_frame(spark: SparkSession) -> DataFrame:
    rows = [(ix, *row) for ix, row in enumerate(sorted(values.PUR2))]
    return _frame(spark, rows, "pur2_ix int, code string, en string, lo string, account string")


def report_line_frame(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(ix, *row) for ix, row in enumerate(config.report_lines)]
    return _frame(
        spark, rows,
        "line_ix int, id string, ord int, grp string, bank_own boolean,"
        " codes array<string>, catch_all boolean, lo string, en string",
    )


def goods_frame(spark: SparkSession) -> DataFrame:
    rows = [(ix, code, side) for ix, (code, side) in enumerate(values.GOODS)]
    return _frame(spark, rows, "goods_ix int, code string, side string")


def size_band_frame(spark: SparkSession) -> DataFrame:
    rows = [
        (ix, float(low), None if high is None else float(high), label)
        for ix, (low, high, label) in enumerate(values.SIZE_BANDS)
    ]
    return _frame(spark, rows, "size_ix int, low double, high double, label string")


def quality_field_frame(spark: SparkSession) -> DataFrame:
    rows = [(ix, *row) for ix, row in enumerate(values.QUALITY_FIELDS)]
    return _frame(spark, rows, "field_ix int, field string, en string, lo string")


def rate_band_frame(spark: SparkSession, config: Config) -> DataFrame:
    return _frame(spark, config.rules.rate_bands, "currency string, low double, high double")


def rules_frame(spark: SparkSession, config: Config) -> DataFrame:
    """Every rule in force, in its order."""
    return _frame(spark, declared.in_force(config.rules), "section string, position int, name string, declared string")


def limits_frame(spark: SparkSession) -> DataFrame:
    """The numbers that tables are cut and judged by."""
    limits = {
        "late_days": values.LATE_DAYS, "exception_rows": values.EXCEPTION_LIMIT, "median_rows": values.MEDIAN_MIN_ROWS,
        "reference_length": values.MIN_REFERENCE_LENGTH,
    }
    return _frame(spark, [(k, float(v)) for k, v in limits.items()], "name string, value double")


def blocklist_frame(spark: SparkSession, config: Config) -> DataFrame:
    return _frame(spark, [(n,) for n in config.blocklist], "blocked string")


def pairs_frame(spark: SparkSession, pairs: dict[str, str], schema: str) -> DataFrame:
    return _frame(spark, pairs.items(), schema)


def list_frame(spark: SparkSession, items: list[str], column: str) -> DataFrame:
    return _frame(spark, [(ix, item) for ix, item in enumerate(items)], f"{column}_ix int, {column} string")


def purpose_name_frame(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(c, n.get("lo"), n.get("en")) for c, n in config.purpose_names.items()]
    return _frame(spark, rows, "code string, official_lo string, official_en string")
