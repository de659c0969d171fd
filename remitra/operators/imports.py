"""Bulk extracts to the canonical schema.

Workbook cells come as a table ``(file, sheet, row_no, cells)``; which cell is
which column is itself a small table, found from the header rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.config import headers as H
from remitra.config import loader
from remitra.functions.numbers import python_number, to_num
from remitra.functions.text import clean_text, head_token, norm_header
from remitra.operators.scale import top_k_per_group
from remitra.schema import CANONICAL, MONEY_COLUMNS
from remitra.session import stage, stage_all

SOURCE = ["file", "sheet"]
ROW = [*SOURCE, "row_no"]
_DATE_CELL = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?$"
HEADER_FIELDS = sorted(set(H.HEADER_MAP.values()))
_DATES = ("Date_of_Transaction", "Date_of_Submission")


def known_headers(cells: DataFrame) -> DataFrame:
    """Cells of the first rows that name a canonical column, as (file, sheet, row_no, pos, field)."""
    names = loader.pairs_frame(cells.sparkSession, H.HEADER_MAP, "header string, field string")
    return (
        cells.filter(F.col("row_no") <= H.HEADER_ROWS)
        .select(*ROW, F.posexplode("cells").alias("pos", "cell"))
        .withColumn("header", norm_header(F.col("cell")))
        .join(F.broadcast(names), "header").drop("header", "cell")
    )


def find_header_row(known: DataFrame) -> DataFrame:
    """The first row of each sheet that resolves at least six columns."""
    hits = known.groupBy(*ROW).agg(F.count("*").alias("hits"))
    return hits.filter(F.col("hits") >= H.HEADER_MIN_COLUMNS).groupBy(*SOURCE).agg(
        F.min("row_no").alias("header_row")
    )


def resolve_columns(known: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Position of each field; the leftmost column wins."""
    on_row = known.join(header_rows, SOURCE).filter(F.col("row_no") == F.col("header_row"))
    return on_row.groupBy(*SOURCE, "header_row", "field").agg(F.min("pos").alias("pos"))


def refused_files(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Sheets in which no header row was found; the caller must not go on without them."""
    seen = cells.filter(F.col("row_no") <= H.HEADER_ROWS).select(*SOURCE).distinct()
    return seen.join(header_rows, SOURCE, "left_anti")


def column_maps(columns: DataFrame) -> DataFrame:
    """One row per sheet, with the position of each field or NULL."""
    return columns.groupBy(*SOURCE, "header_row").agg(*[
        F.min(F.when(F.col("field") == f, F.col("pos"))).alias(f"at {f}") for f in HEADER_FIELDS
    ])


def is_date(cell: Column) -> Column:
    return F.coalesce(cell.rlike(_DATE_CELL), F.lit(False))


def _date(cell: Column) -> Column:
    return F.when(is_date(cell), cell).try_cast("timestamp_ntz")


def _typed(name: str, cell: Column, apostrophe: bool) -> Column:
    if name in MONEY_COLUMNS:
        value = to_num(cell, commas=apostrophe)
    elif name in _DATES:
        value = _date(cell)
    else:
        value = clean_text(cell, apostrophe)
    return value.alias(name)


def map_headers(cells: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows below the header, by resolved column. ``maps`` is a staged table."""
    rows = cells.join(maps, SOURCE).filter(F.col("row_no") > F.col("header_row"))
    cell = lambda f: F.get("cells", F.col(f"`at {f}`"))
    return rows.select(*ROW, *[_typed(f, cell(f), True) for f in HEADER_FIELDS])


def map_book(cells: DataFrame) -> DataFrame:
    """Rows of both sheets of the positional workbook in one scan."""
    by_field: dict[str, list[tuple[str, int]]] = {}
    for sheet, own in H.SHEET_POSITIONS.items():
        for position, field in {**H.COMMON_POSITIONS, **own}.items():
            by_field.setdefault(field, []).append((sheet, position))
    rows = cells.filter(F.col("sheet").isin(*H.SHEET_POSITIONS) & (F.col("row_no") > 1))

    def cell(places: list[tuple[str, int]]) -> Column:
        where = F.lit(None).cast("int")
        for sheet, position in places:
            where = F.when(F.col("sheet") == sheet, position).otherwise(where)
        return F.get("cells", where)

    return rows.select(*ROW, *[_typed(f, cell(places), False) for f, places in by_field.items()])


def map_positions(cells: DataFrame, sheet: str) -> DataFrame:
    """Rows of one sheet of the positional workbook; the two sheets differ in columns H to L."""
    positions = {**H.COMMON_POSITIONS, **H.SHEET_POSITIONS[sheet]}
    rows = cells.filter((F.col("sheet") == sheet) & (F.col("row_no") > 1))
    return rows.select(
        *ROW, *[_typed(f, F.get("cells", F.lit(i)), False) for i, f in positions.items()]
    )


def skip_reason(bank: Column, done: Column, low: date | None = None, high: date | None = None) -> Column:
    """Why a row is left out, or NULL: undated, template, or outside the date range."""
    reason = F.when(done.isNull(), "undated")
    if low is not None:
        reason = reason.when(~date_range(done, low, high), "out_of_range")
    template = bank.isNull() | (F.lower(bank) == H.TEMPLATE_BANK)
    return reason.when(template, "template")


def filter_rows(df: DataFrame, low: date | None = None, high: date | None = None) -> DataFrame:
    return df.filter(
        skip_reason(F.col("Banks"), F.col("Date_of_Transaction"), low, high).isNull()
    )


def skip_report(df: DataFrame, low: date | None = None, high: date | None = None) -> DataFrame:
    """Rows kept and skipped per sheet and reason; they add up to the rows read."""
    reason = skip_reason(F.col("Banks"), F.col("Date_of_Transaction"), low, high)
    return df.groupBy(*SOURCE, F.coalesce(reason, F.lit("kept")).alias("outcome")).agg(
        F.count("*").alias("n")
    )


def date_range(c: Column, low: date, high: date) -> Column:
    return c.cast("date").between(F.lit(low), F.lit(high))


def derive_purpose(df: DataFrame, source: str = "Purpose_Code", keep_pur2: bool = False) -> DataFrame:
    """Six- and two-character codes. The positional sheets file the confirmed code, and Pur_2."""
    code = F.coalesce(source, F.lit(""))
    first = lambda n: F.nullif(F.substring(code, 1, n), F.lit(""))
    pur2 = F.coalesce("Pur_2", first(2)) if keep_pur2 else first(2)
    # The header path files an empty confirmed code where none was given.
    confirmed = F.col(source) if keep_pur2 else code
    return df.withColumns({"Code_New_Confirm": confirmed, "Pur_5": first(6), "Pur_2": pur2})


def purpose_name(df: DataFrame, names: DataFrame, keep_filed: bool = True) -> DataFrame:
    """The filed name if there is one, else the official Lao name of the six-character code."""
    official = names.select(F.col("code").alias("Pur_5"), "official_lo")
    df = df.join(official, "Pur_5", "left")
    name = F.coalesce("Purpose_Name", "official_lo") if keep_filed else F.col("official_lo")
    return df.withColumn("Purpose_Name", name).drop("official_lo")


def method_vocab(history: DataFrame) -> DataFrame:
    """Historical method per head word; of several the lowest, so that runs agree."""
    filed = history.filter("Transfer_Method IS NOT NULL")
    return filed.groupBy(head_token(F.col("Transfer_Method")).alias("head")).agg(
        F.min("Transfer_Method").alias("canonical")
    )


def canon_method(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Methods in the wording of history. ``vocab`` is a staged table."""
    head = head_token(F.col("Transfer_Method"))
    return df.withColumn("_head", head).join(
        vocab.withColumnRenamed("head", "_head"), "_head", "left"
    ).withColumn("Transfer_Method", F.coalesce("canonical", "Transfer_Method")).drop(
        "_head", "canonical"
    )


def history_counts(history: DataFrame) -> DataFrame:
    """Distinct combinations of what the vocabularies read, with their number: one scan serves both."""
    return history.groupBy("Transfer_Method", "Pur_5", "Move_Fund").agg(F.count("*").alias("rows"))


def move_fund_map(history: DataFrame) -> DataFrame:
    """The most frequent flag of each code; of equally frequent ones the lower.

    Counted first, so no task holds the values of a code. ``history`` may be
    its rows or their ``history_counts``.
    """
    weight = F.sum("rows") if "rows" in history.columns else F.count("*")
    votes = (
        history.filter("Pur_5 IS NOT NULL AND Move_Fund IS NOT NULL")
        .groupBy("Pur_5", "Move_Fund").agg(weight.alias("votes"))
    )
    best = top_k_per_group(votes, ["Pur_5"], [F.desc("votes"), F.col("Move_Fund")], 1)
    return best.select("Pur_5", F.col("Move_Fund").alias("usual"))


def apply_move_fund(df: DataFrame, usual: DataFrame) -> DataFrame:
    """``usual`` is a staged table; codes without history count as moving funds."""
    return df.join(usual, "Pur_5", "left").withColumn(
        "Move_Fund", F.coalesce("usual", F.lit("Yes"))
    ).drop("usual")


def stamp(df: DataFrame, flow: Column, file: Column) -> DataFrame:
    done = F.col("Date_of_Transaction")
    return df.withColumns({
        "Flow": flow,
        "Source_Year": F.year(done).cast("long"),
        "Month_Year": F.date_trunc("month", done).cast("timestamp_ntz"),
        "Source_File": file,
    })


def _date_text(c: Column) -> Column:
    """To the second, with six more digits where there is a fraction of one."""
    whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.when(c == F.date_trunc("second", c), whole).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def hash_id(df: DataFrame, with_file: bool = True) -> DataFrame:
    """Row id from origin and content. The row number keeps genuine repeats apart."""
    text = lambda c: F.coalesce(c, F.lit("None"))
    parts = [F.col("Flow")]
    if with_file:
        parts.append(F.col("file"))
    parts += [
        F.col("row_no").cast("string"), F.col("Banks"), F.col("Reference_Number"),
        _date_text(F.col("Date_of_Transaction")),
        python_number(F.col("Amount_Transferred")), F.col("Currency_Code"), F.col("Purpose_Code"),
    ]
    joined = F.concat_ws("|", *[text(p) for p in parts])
    return df.withColumn("Hash_ID", F.substring(F.sha1(joined.cast("binary")), 1, 24))


def conform(df: DataFrame) -> DataFrame:
    """Exactly the canonical columns, in order and typed; absent ones are NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CANONICAL
    ])


def _vocabularies(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    counts = stage(history_counts(history), "history")
    made = stage_all(history.sparkSession, {
        "method_vocab": lambda: method_vocab(counts), "move_fund": lambda: move_fund_map(counts),
    })
    return made["method_vocab"], made["move_fund"]


def _located(cells: DataFrame) -> DataFrame:
    """Staged column maps of all sheets with a header row."""
    known = stage(known_headers(cells), "headers")
    return stage(column_maps(resolve_columns(known, find_header_row(known))), "column_maps")


def import_report(cells: DataFrame, low: date | None = None, high: date | None = None) -> DataFrame:
    """What becomes of every row of a header-matched import, as counts that add up to the rows read.

    Rows of a sheet without a header row are ``no_header``, those down to the
    header row ``heading``; for the rest see ``skip_reason``.
    """
    maps = _located(cells)
    rows = cells.join(maps, SOURCE, "left")
    cell = lambda f: _typed(f, F.get("cells", F.col(f"`at {f}`")), True)
    rows = rows.select(*ROW, "header_row", cell("Banks"), cell("Date_of_Transaction"))
    outcome = (
        F.when(F.col("header_row").isNull(), "no_header")
        .when(F.col("row_no") <= F.col("header_row"), "heading")
        .otherwise(F.coalesce(skip_reason(F.col("Banks"), F.col("Date_of_Transaction"), low, high), F.lit("kept")))
    )
    return rows.groupBy(*SOURCE, outcome.alias("outcome")).agg(F.count("*").alias("n"))


def rows_by_header(
    cells: DataFrame, history: DataFrame, purpose_names: DataFrame, flow: Column, refuse: bool = True,
) -> DataFrame:
    """Extracts whose columns are found by their headers, whatever their order, with file, sheet and row number.

    A sheet without a header row stops the import. Pass ``refuse=False`` to go
    on without it; ``import_report`` then tells how many rows that leaves out.
    """
    maps = _located(cells)
    if refuse:
        lost = refused_files(cells, maps.select(*SOURCE)).orderBy(*SOURCE).take(20)
        if lost:
            raise ValueError("no header row in " + ", ".join(f"{r.file} [{r.sheet}]" for r in lost))
    vocab, usual = _vocabularies(history)
    rows = filter_rows(map_headers(cells, maps))
    df = purpose_name(derive_purpose(rows), purpose_names)
    df = apply_move_fund(canon_method(df, vocab), usual)
    # Use and M2 are not in this export and stay NULL for the rules to fill.
    return hash_id(stamp(df, flow, F.col("file")))


def import_by_header(
    cells: DataFrame, history: DataFrame, purpose_names: DataFrame, flow: Column, refuse: bool = True,
) -> DataFrame:
    """``rows_by_header`` in the canonical columns."""
    return conform(rows_by_header(cells, history, purpose_names, flow, refuse))


def rows_by_position(
    cells: DataFrame, history: DataFrame, purpose_names: DataFrame, low: date, high: date,
) -> DataFrame:
    """Both sheets of the positional workbook, within an inclusive range of dates, with file, sheet and row number."""
    vocab, usual = _vocabularies(history)
    flow = F.lit(None).cast("string")
    for sheet, name in H.SHEET_FLOW.items():
        flow = F.when(F.col("sheet") == sheet, name).otherwise(flow)
    df = derive_purpose(filter_rows(map_book(cells), low, high), "Code_New_Confirm", keep_pur2=True)
    df = purpose_name(df, purpose_names, keep_filed=False)
    df = apply_move_fund(canon_method(df, vocab), usual)
    return hash_id(stamp(df, flow, F.col("file")), with_file=False)


def import_by_position(
    cells: DataFrame, history: DataFrame, purpose_names: DataFrame, low: date, high: date,
) -> DataFrame:
    """``rows_by_position`` in the canonical columns."""
    return conform(rows_by_position(cells, history, purpose_names, low, high))
