"""Name repair on distinct names, joined back to the rows that bear them.

Names repeat far more often than they differ, and repair is the one place
where text goes through Python, so each distinct name is repaired once, and
only names that come out otherwise are joined. Meant for aggregates and capped
lists, in which no name can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.functions.text import fix_mojibake, real_name, without_edge
from remitra.session import stage


def composed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with its string ``columns`` in Unicode normal form C.

    Whole batches go through Python and come back, so no row waits for an
    answer: a scalar function queues its input and, once memory is short,
    writes all further rows of the task to disk. Only texts with a character
    from U+0300 on are looked at.
    """
    # A local function travels by value, so tasks need not import this package.
    def normalize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import unicodedata

        import pyarrow.compute as pc

        for batch in batches:
            for name in columns:
                at = batch.schema.get_field_index(name)
                affected = pc.fill_null(pc.match_substring_regex(batch.column(at), r"[^\x00-\x{2FF}]"), False)
                if affected.true_count:
                    forms = [unicodedata.normalize("NFC", v) for v in batch.column(at).filter(affected).to_pylist()]
                    column = pc.replace_with_mask(batch.column(at), affected, pa.array(forms, batch.schema.field(at).type))
                    batch = batch.set_column(at, batch.schema.field(at), column)
            yield batch

    return df.mapInArrow(normalize, df.schema)


def with_clean_names(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Add ``clean_name`` of each of ``made``, by its new name; for tables of any length."""
    fixed = composed(df.withColumns({name: fix_mojibake(c) for name, c in made.items()}), list(made))
    return fixed.withColumns({name: without_edge(F.col(name)) for name in made})


def renamed(df: DataFrame, source: str, block: Sequence[str]) -> DataFrame:
    """Each distinct name that repair changes or that is not fit to print, once: as filed, repaired, and whether it is fit.

    Most names are fit as they are, so the list is short and its join moves no
    rows of ``df`` unless it is too long to broadcast. Written down, because the
    optimizer would otherwise copy the test from here to the other side of the
    join and repair every row after all.
    """
    names = df.filter(F.col(source).isNotNull()).select(F.col(source).alias("_filed")).distinct()
    names = with_clean_names(names, {"_clean": F.col("_filed")})
    names = names.withColumn("_real", real_name(F.col("_filed"), F.col("_clean"), block))
    return stage(names.filter(~F.col("_clean").eqNullSafe(F.col("_filed")) | ~F.col("_real")), "names")


def with_clean_name(df: DataFrame, source: str, name: str) -> DataFrame:
    """Add the repaired form of a name column."""
    names = renamed(df, source, []).drop("_real")
    joined = df.join(names, F.col(source) == F.col("_filed"), "left")
    return joined.withColumn(name, F.when(F.col("_filed").isNull(), F.col(source)).otherwise(F.col("_clean"))).drop("_filed", "_clean")


def only_real_names(df: DataFrame, source: str, name: str, block: Sequence[str]) -> DataFrame:
    """Rows whose name is one, with its repaired form."""
    joined = df.filter(F.col(source).isNotNull()).join(renamed(df, source, block), F.col(source) == F.col("_filed"), "left")
    return joined.filter("_filed is null or _real").withColumn(name, F.coalesce("_clean", source)).drop("_filed", "_clean", "_real")
