"""Transaction files of any year to one raw table."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitra.config import headers as H
from remitra.schema import CANONICAL
from remitra.session import stage
from remitra.sources import records

DATA_SUFFIXES = (".parquet", ".csv")
SHEET_SUFFIXES = (".xlsx", ".xlsm", ".xls")
REJECTS = "file string, line long, field string, filed string"
_TYPES = {f.name: f.dataType for f in CANONICAL}
_MALFORMED = "_malformed"


def discover(spark: SparkSession, root: str, flow: str) -> list[str]:
    """Data sets directly inside a flow folder, in name order.

    An entry is one yearly extract: a file, or a folder of part files. Lock files
    are skipped. A year present in two formats is listed twice, and read twice.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{flow}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [status.getPath() for status in fs.listStatus(folder)]
    return sorted(
        p.toString() for p in found
        if p.getName().lower().endswith(DATA_SUFFIXES) and not p.getName().startswith("~$")
    )


def unread_files(spark: SparkSession, root: str) -> list[str]:
    """Spreadsheets in the flow folders, which hold rows that no reader here decodes."""
    jvm, found = spark.sparkContext._jvm, []
    for flow in ("Payment", "Receive"):
        folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{flow}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(folder):
            found += [status.getPath() for status in fs.listStatus(folder)]
    return sorted(
        p.toString() for p in found if p.getName().lower().endswith(SHEET_SUFFIXES) and not p.getName().startswith("~$")
    )


def overlapping_stems(paths: Sequence[str]) -> list[str]:
    """Names present under more than one suffix, whose rows would count twice."""
    stems = [p.rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in paths]
    return sorted({s for s in stems if stems.count(s) > 1})


def _value(filed: Column, kind: T.DataType, wanted: T.DataType, date_formats: Sequence[str]) -> Column:
    """A column of type ``kind`` in its canonical type."""
    if isinstance(wanted, T.TimestampNTZType) and isinstance(kind, T.LongType):
        # Nanoseconds, which Spark hands over as a number.
        return F.timestamp_micros(F.call_function("div", filed, F.lit(1000).cast("long"))).cast(wanted)
    if kind == wanted:
        return filed
    if not isinstance(kind, T.StringType):
        return filed.cast(wanted)
    value = filed.try_cast(wanted)
    if isinstance(wanted, T.TimestampNTZType):
        value = F.coalesce(value, *[F.try_to_timestamp(filed, F.lit(x)).cast(wanted) for x in date_formats])
    return value


def _typed(fields: Sequence[T.StructField], of: Callable[[str], Column], date_formats: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Every field in its canonical type, unknown ones as text; and what was filed where a typed cell is filled but holds no such value.

    Dates filed as text are ISO, or else in the first of ``date_formats`` that fits.
    """
    values, lost = [], []
    for f in fields:
        wanted, filed = _TYPES.get(f.name, T.StringType()), of(f.name)
        value = _value(filed, f.dataType, wanted, date_formats)
        values.append(value.alias(f.name))
        if isinstance(f.dataType, T.StringType) and not isinstance(wanted, T.StringType):
            refused = value.isNull() & (F.trim(filed) != "")
            lost.append(F.when(refused, F.struct(F.lit(f.name).alias("field"), filed.alias("filed"))))
    return values, lost


def _no_rejects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REJECTS)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """One table of all columns that occur anywhere; absent ones are NULL."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


@dataclass(frozen=True)
class Read:
    """Rows in canonical types, and the cells that were lost on the way: (file, line, field, filed)."""

    rows: DataFrame
    rejects: DataFrame

    def counted(self) -> DataFrame:
        """(file, field, rejected)"""
        return self.rejects.groupBy("file", "field").agg(F.count("*").alias("rejected"))


def _together(reads: Sequence[Read]) -> Read:
    rejects = reads[0].rejects
    for read in reads[1:]:
        rejects = rejects.unionByName(read.rejects)
    return Read(union_by_name([read.rows for read in reads]), rejects)


def read_parquet_canonical(spark: SparkSession, paths: Sequence[str]) -> Read:
    """Yearly parquet extracts, each read in its own physical types and then cast.

    Merging the files' schemas would fail: a column that is empty for a whole
    year is stored under another type. Extracts of one layout share a scan.
    Typed columns stored as text may hold cells that are lost; the line is that of the row.
    """
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    layouts: dict[str, list[str]] = {}
    for path in paths:
        layouts.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    reads = []
    for group in layouts.values():
        df = spark.read.parquet(*group)
        values, lost = _typed(df.schema.fields, lambda name: F.col(f"`{name}`"), ())
        rejects = _no_rejects(spark)
        if lost:
            found = F.filter(F.array(*lost), lambda x: x.isNotNull())
            line = (F.col("_metadata.row_index") + 1).alias("line")
            rejects = df.select(_file_name(F.col("_metadata.file_path"), group).alias("file"), line, F.inline(found))
        reads.append(Read(df.select(*values), rejects))
    return _together(reads)


def _file_name(path: Column, paths: Sequence[str]) -> Column:
    """The name of a data set, and of the part if it is a folder."""
    folders = {p.rstrip("/").rsplit("/", 1)[-1] for p in paths}
    last = F.regexp_extract(path, "([^/]*)/([^/]*)$", 2)
    above = F.regexp_extract(path, "([^/]*)/([^/]*)$", 1)
    return F.when(above.isin(*folders), F.concat(above, F.lit("/"), last)).otherwise(last)


def _csv_columns(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Names in the header of a CSV extract; only its beginning is read."""
    return tuple(spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').columns)


def _parsed(records: DataFrame, names: Sequence[str], date_formats: Sequence[str]) -> DataFrame:
    """Add ``cells``, typed, and ``lost``, what could not be kept, to records (text, torn); nothing where there is no text."""
    text = F.regexp_replace("text", "\r$", "")
    fields = [T.StructField(name, T.StringType()) for name in names]
    schema = ", ".join("`{}` string".format(name.replace("`", "``")) for name in [*names, _MALFORMED])
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED}
    values, lost = _typed(fields, lambda name: F.col("_filed").getField(name), date_formats)
    whole = F.struct(F.lit(None).cast("string").alias("field"), text.alias("filed"))
    lost.append(F.when(F.col("_filed").getField(_MALFORMED).isNotNull() | F.col("torn"), whole))
    return records.withColumn("_filed", F.from_csv(text, schema, options)).select(
        "*", F.struct(*values).alias("cells"), F.filter(F.array(*lost), lambda x: x.isNotNull()).alias("lost")
    ).drop("_filed", "text")


def read_csv_canonical(spark: SparkSession, paths: Sequence[str], date_formats: Sequence[str] = ()) -> Read:
    """CSV extracts with a header, all cells read as text and then cast, in two passes of any number of tasks.

    Extracts of one header share their passes. The second writes rows and rejects
    to the shared folder, so that the text is parsed once whatever is read later.
    A record with fewer or more cells than the header, or with a cell that is
    never closed, is a reject without a field; its cells are read as far as they go.
    """
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        layouts.setdefault(_csv_columns(spark, path), []).append(path)
    reads = []
    for names, group in layouts.items():
        with records.same_splits(spark):
            notes = records.notes_of(spark, group)
            if len(set(records.headers(notes).values())) > 1:
                raise ValueError("part files of one extract differ in their headers: " + ", ".join(group))
            pieces = records.pieces_of(spark, group, notes)
            crossing = F.col("piece").isNotNull()
            cut = pieces.withColumn("part", F.when(crossing, F.col("text"))).withColumn("text", F.when(~crossing, F.col("text")))
            once = stage(_parsed(cut, names, date_formats), "csv")
        found = once.filter("piece IS NULL").select("file", "line", "cells", "lost")
        crossing = once.filter("piece IS NOT NULL").select("file", "line", "piece", "torn", F.col("part").alias("text"))
        if not crossing.isEmpty():
            found = found.unionByName(stage(_parsed(records.assembled(crossing), names, date_formats).drop("torn"), "csv-crossing"))
        rejects = found.select(_file_name(F.col("file"), group).alias("file"), "line", F.inline("lost"))
        reads.append(Read(found.select("cells.*"), rejects))
    return _together(reads)


def read_flow(spark: SparkSession, paths: Sequence[str], date_formats: Sequence[str] = ()) -> Read | None:
    reads = []
    parquet = [p for p in paths if p.lower().endswith(".parquet")]
    csv = [p for p in paths if p.lower().endswith(".csv")]
    if parquet:
        reads.append(read_parquet_canonical(spark, parquet))
    if csv:
        reads.append(read_csv_canonical(spark, csv, date_formats))
    return _together(reads) if reads else None


def warn_of_doubles(flow: str, paths: Sequence[str]) -> None:
    twice = overlapping_stems(paths)
    if twice:
        warnings.warn(f"{flow} holds {', '.join(twice)} in more than one format; their rows count twice", stacklevel=4)


def read_flows(spark: SparkSession, root: str, date_formats: Sequence[str] = ()) -> Read:
    """All extracts of both directions with their rejects; the direction comes from the folder."""
    reads = []
    for flow in ("Payment", "Receive"):
        paths = discover(spark, root, flow)
        warn_of_doubles(flow, paths)
        read = read_flow(spark, paths, date_formats)
        if read is not None:
            reads.append(Read(read.rows.withColumn("_flow", F.lit(flow)), read.rejects))
    if not reads:
        raise FileNotFoundError(f"no data files under {root}/Payment or {root}/Receive")
    whole = _together(reads)
    absent = [
        F.lit(None).cast(f.dataType).alias(f.name) for f in CANONICAL if f.name not in whole.rows.columns
    ]
    return Read(whole.rows.select("*", *absent), whole.rejects)


def refuse_losses(read: Read) -> Read:
    """The same, unless a cell or record was lost on the way."""
    lost = read.counted().orderBy("file", "field").collect()  # a row per file and typed field
    if lost:
        named = ", ".join(f"{r.file} {r.field or 'records'} ({r.rejected})" for r in lost)
        raise ValueError(f"cells or records in no known format: {named}")
    return read


def union_flows(spark: SparkSession, root: str, date_formats: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """All extracts of both directions; the direction comes from the folder.

    Nothing is left out in silence: a spreadsheet, or a filled cell that is no
    date, amount, rate or year where one belongs, is an error, and a name present
    in two formats a warning. With ``strict=False`` the caller looks at
    ``unread_files`` and at the rejects of ``read_flows``.
    """
    if not strict:
        return read_flows(spark, root, date_formats).rows
    unread = unread_files(spark, root)
    if unread:
        raise ValueError("spreadsheets are not read; convert or remove " + ", ".join(unread))
    return refuse_losses(read_flows(spark, root, date_formats)).rows


def load_reference(raw: DataFrame, year: int) -> DataFrame:
    """The historical columns that vocabularies are taken from."""
    return raw.filter(F.col("Source_Year") == year).select("Transfer_Method", "Pur_5", "Move_Fund")


def direction_of(file: Column, sheet: Column) -> Column:
    """Direction by the export's file name, else by its sheet; NULL if neither tells."""
    by_file = None
    for pattern, flow in H.FILE_FLOW:
        holds = file.rlike(pattern)
        by_file = F.when(holds, flow) if by_file is None else by_file.when(holds, flow)
    for name, flow in H.SHEET_FLOW.items():
        by_file = by_file.when(sheet == name, flow)
    return by_file
