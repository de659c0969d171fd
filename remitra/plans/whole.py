"""From bulk exports to published tables in one run: imports, declared rules, corrections, the build."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.config import loader
from remitra.config.loader import Config
from remitra.operators import imports as I
from remitra.operators import reports as V
from remitra.operators import rules as R
from remitra.plans.build import Build
from remitra.plans.job import Step, run
from remitra.sources.pack import Pack
from remitra.sources.sinks import order_of

@dataclass(frozen=True)
class Exports:
    """Cells of header-matched exports and of the positional workbook, and the rows of years before."""

    cells: DataFrame
    book: DataFrame
    history: DataFrame
    low: date
    high: date
    refuse: bool = True


def classified(rows: DataFrame, config: Config, overrides: DataFrame | None = None) -> DataFrame:
    """Imported rows in canonical columns, with the purpose the rules settle on, and with flags where none was filed.

    Manual corrections, by direction and row number, win over the rules; a
    corrected amount replaces the dollar amount.
    """
    tested = {
        "bank": F.col("Banks"), "country": F.col("Country_Code"), "purpose": F.col("Code_New_Confirm"),
        "sector": F.col("LSIC_Code"), "name": F.coalesce("Transferor_Name", "Recipient_Name"), "remark": F.col("Additional_Information"),
        "amount": F.col("Amount_USD"),
    }
    df = R.classify(rows.withColumnRenamed("Flow", "flow").withColumns(tested), config.rules, overrides)
    code = F.coalesce("final_purpose", F.lit(""))
    part = lambda n: F.nullif(F.substring(code, 1, n), F.lit(""))
    return I.conform(df.withColumnRenamed("flow", "Flow").withColumns({
        "Code_New_Confirm": F.col("final_purpose"), "Pur_5": part(6), "Pur_2": part(2), "Amount_USD": F.col("amount"),
        "M2": F.coalesce("M2", "m2_rule"), "Use": F.coalesce("Use", "use_rule"),
    }))


def _with_columns(rows: DataFrame) -> DataFrame:
    """Columns that an export may lack, NULL."""
    absent = [f for f in I.CANONICAL if f.name not in rows.columns]
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent})


def import_and_publish(
    exports: Exports, flow: Column, config: Config, out: str, tables: Sequence[str] | None = None, overrides: DataFrame | None = None,
) -> int:
    """Import both kinds of export, classify, build and publish under ``out``; the version published.

    ``tables`` names the tables wanted, all by default. Use and M2, which the
    header-matched export lacks, are filled by the rules, so its rows count in
    the cubes as the positional ones do.
    """
    spark = exports.cells.sparkSession
    names = loader.purpose_name_frame(spark, config)

    def headed(_):
        return I.rows_by_header(exports.cells, exports.history, names, flow, exports.refuse)

    def placed(_):
        return I.rows_by_position(exports.book, exports.history, names, exports.low, exports.high)

    def joined(found):
        parts = [classified(_with_columns(found[name]), config, overrides) for name in ("by_header", "by_position")]
        return parts[0].unionByName(parts[1])

    def published(found):
        build = Build(found["classified"].withColumn("_flow", F.col("Flow")), config)
        made = build.tables() | {"banks_with_officers": V.join_officers(build.dims.banks, config)}
        wanted = made if tables is None else {name: made[name] for name in tables}
        return Pack(spark, out).publish(wanted, {name: keys for name, df in wanted.items() if (keys := order_of(df))})

    steps = {
        "by_header": Step(headed), "by_position": Step(placed), "classified": Step(joined, ("by_header", "by_position")),
        "published": Step(published, ("classified",)),
    }
    return run(spark, steps)["published"]
