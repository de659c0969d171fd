"""Repeat submissions: the same report sent twice must count once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from remitra.config import values
from remitra.operators.scale import BITS, ROW_BITS, grouped, shared_keys, with_bit, with_group_size  # noqa: F401
from remitra.session import stage

KEYS = ["bank", "flow", "ymd", "ref", "currency", "amt_orig"]

#: Rows of a group that one task ranks, and one in how many rows tells which groups have more.
SLICE_ROWS, SAMPLED = 2_000_000, 500
#: The part of a cut group that holds rows without an id.
SLICES_END = 1 << 30


def identifies(ref: Column) -> Column:
    """A missing or short reference cannot establish identity."""
    return F.coalesce(F.length(ref) >= values.MIN_REFERENCE_LENGTH, F.lit(False))


def hot_groups(tx_all: DataFrame, rows: int = SLICE_ROWS, one_in: int = SAMPLED) -> DataFrame:
    """Staged (``_hot``, ``_borders``) of groups too large for one task, with ids that cut them into parts of about ``rows``.

    Read from one in ``one_in`` rows, picked by a hash of the id, of the key
    columns alone. A group that the sample misses stays whole; results are the same.
    """
    picked = F.pmod(F.xxhash64("Hash_ID"), F.lit(one_in)) == 0
    sample = grouped(tx_all.filter(identifies(F.col("ref")) & picked).select(*KEYS, "Hash_ID"), KEYS)
    step = max(1, rows // one_in)
    ids = F.array_sort(F.collect_list("Hash_ID"))
    large = sample.groupBy(F.col("_group").alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > step)
    cut = sample.join(stage(large, "large"), F.col("_group") == F.col("_hot")).groupBy("_hot").agg(ids.alias("_ids"))
    return stage(cut.select("_hot", F.filter("_ids", lambda _, k: k % step == step - 1).alias("_borders")), "hot")


def rank_duplicates(tx_all: DataFrame, rows: int = SLICE_ROWS, one_in: int = SAMPLED) -> DataFrame:
    """``dup_rank`` of every row among its copies, by row id, and ``dup_count``, how many there are.

    One shuffle by group gives both; rows that cannot be copies are spread by
    their id. A group too large for one task is cut along the id, and what each
    part has before it is added to its local ranks.
    """
    is_copy = identifies(F.col("ref"))
    marked = tx_all.withColumns({"_group": F.when(is_copy, F.struct(*KEYS)), "_alone": F.when(~is_copy, F.xxhash64("Hash_ID"))})
    hot = hot_groups(tx_all, rows, one_in)
    cut = not hot.isEmpty()
    marked = _sliced(marked, hot) if cut else marked.withColumn("_slice", F.lit(0))
    part = W.partitionBy("_group", "_alone", "_slice")
    ranked = marked.withColumns({
        "dup_rank": F.row_number().over(part.orderBy(F.col("Hash_ID").asc_nulls_last())).cast("long"), "dup_count": F.count("*").over(part),
    })
    if cut:
        ranked = _carried(ranked, _sliced(tx_all.filter(is_copy).select(F.struct(*KEYS).alias("_group"), "Hash_ID"), hot, "inner"))
    one = F.lit(1).cast("long")
    ranks = {name: F.when(is_copy, F.col(name)).otherwise(one) for name in ("dup_rank", "dup_count")}
    return ranked.withColumns(ranks).drop("_group", "_alone", "_slice")


def _sliced(df: DataFrame, hot: DataFrame, how: str = "left") -> DataFrame:
    """Add the part of its group that a row is in."""
    part = (
        F.when(F.col("_borders").isNull(), 0).when(F.col("Hash_ID").isNull(), SLICES_END)
        .otherwise(F.size(F.filter("_borders", lambda border: border < F.col("Hash_ID"))))
    )
    return df.join(hot, F.col("_group") == F.col("_hot"), how).withColumn("_slice", part).drop("_hot", "_borders")


def _carried(ranked: DataFrame, of_cut_groups: DataFrame) -> DataFrame:
    """Ranks and sizes within parts become those within groups."""
    counts = of_cut_groups.groupBy("_group", "_slice").agg(F.count("*").alias("_n"))
    group = W.partitionBy("_group")
    before = F.sum("_n").over(group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    carry = counts.select(
        F.struct("_group", "_slice").alias("_match"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_all")
    )
    joined = ranked.join(stage(carry, "carry"), F.struct("_group", "_slice") == F.col("_match"), "left")
    return joined.withColumns({
        "dup_rank": F.col("dup_rank") + F.coalesce("_before", F.lit(0)), "dup_count": F.coalesce("_all", "dup_count"),
    }).drop("_match", "_before", "_all")


def dup_count(tx_all: DataFrame) -> DataFrame:
    """``dup_count``: how many copies each row has, itself included."""
    rows = tx_all.filter(identifies(F.col("ref")))
    alone = tx_all.filter(~identifies(F.col("ref"))).withColumn("dup_count", F.lit(1).cast("long"))
    return with_group_size(rows, KEYS, "dup_count").unionByName(alone)


def with_copy_mark(tx_all: DataFrame, bits: int = BITS) -> DataFrame:
    """Add ``_copies``: whether a row may have copies; never false for one that has."""
    is_copy = identifies(F.col("ref"))
    shared = shared_keys(tx_all.filter(is_copy), KEYS, bits)
    return with_bit(tx_all, F.when(is_copy, F.xxhash64(*KEYS)), shared, "_copies", bits)


def dedup(tx_all: DataFrame, bits: int = BITS) -> DataFrame:
    """Keep the copy with the lowest id.

    Digests of the keys, counted first, tell which rows may have copies. Only
    those are shuffled whole; a limit of one per group runs before that too.
    """
    marked = with_copy_mark(tx_all, bits)
    return _lowest_ids(marked).unionByName(marked.filter("not _copies")).drop("_copies")


def _lowest_ids(marked: DataFrame) -> DataFrame:
    first = W.partitionBy(*KEYS).orderBy(F.col("Hash_ID").asc_nulls_last())
    return marked.filter("_copies").withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def dedup_view(tx_all: DataFrame, bits: int = BITS) -> DataFrame:
    """What ``dedup`` keeps of a written ``tx_all``, for many readers, without a second copy of it.

    Only what is kept of rows that may have copies is written. All other rows
    are read from ``tx_all``, where the bits of their keys tell them apart.
    """
    marked = with_copy_mark(tx_all, bits)
    kept = stage(_lowest_ids(marked), "kept")
    return kept.unionByName(marked.filter("not _copies")).drop("_copies")


def dedup_columns(tx_all: DataFrame, columns: Sequence[str | Column], bits: int = BITS) -> DataFrame:
    """``columns`` of what ``dedup`` keeps, written for many readers by one pass over ``tx_all`` after the count of digests.

    Rows that may have copies carry their keys until the kept ones of them,
    which are few, are told apart; other rows aren't read again for that.
    """
    copy = F.struct(*KEYS, "Hash_ID")
    once = stage(with_copy_mark(tx_all, bits).select(*columns, "_copies", F.when(F.col("_copies"), copy).alias("_copy")), "marked")
    first = W.partitionBy(*[F.col("_copy")[key] for key in KEYS]).orderBy(F.col("_copy")["Hash_ID"].asc_nulls_last())
    ranked = once.filter("_copies").withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    kept = stage(ranked.drop("_copies", "_copy", "_rank"), "kept")
    return kept.unionByName(once.filter("not _copies").drop("_copies", "_copy"))


def dedup_report(tx_all: DataFrame) -> DataFrame:
    """Kept, removed and total rows, from counts alone."""
    groups = tx_all.groupBy(*KEYS).agg(F.count("*").alias("n"))
    kept = F.sum(F.when(identifies(F.col("ref")), F.lit(1)).otherwise(F.col("n")))
    return groups.agg(kept.alias("kept"), F.sum("n").alias("total")).select(
        "kept", (F.col("total") - F.col("kept")).alias("removed"), "total"
    )
