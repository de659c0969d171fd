"""Building blocks that keep one hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from remitra.session import stage

SLICES = 128
#: Bits that tell which keys may be in a set (16 MB), and those of one row of their table.
BITS, ROW_BITS = 1 << 27, 1 << 12


def grouped(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Add ``_group``, one struct of all keys.

    Structs are equal if their fields are, NULL fields included, so a join on
    them needs no NULL-safe rewriting and keeps the partitioning of a window
    or an aggregate on the same struct.
    """
    return df.withColumn("_group", F.struct(*keys, *more))


def running_total(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
    weight: Column, name: str, total: str | None = None,
) -> DataFrame:
    """Running sum of ``weight`` per group, with each group split along ``bucket``.

    ``bucket`` must not decrease along ``order`` and take a bounded number of
    values. The sort then runs per (group, bucket); what crosses buckets is one
    subtotal each, so a group of any size is spread over as many tasks as it
    has buckets. ``total`` names a column for the sum of the whole group.
    """
    df = grouped(df, keys, bucket.alias("_bucket"))
    local = (
        W.partitionBy("_group").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    subtotals = df.groupBy(F.col("_group").alias("_match")).agg(F.sum(weight).alias("_sum"))
    group = W.partitionBy(*[F.col("_match")[key] for key in keys])
    before = group.orderBy(F.col("_match")["_bucket"].asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = subtotals.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    if total is not None:
        offsets = offsets.withColumn(total, F.sum("_sum").over(group))
    return (
        df.withColumn("_local", F.sum(weight).over(local))
        .join(offsets, F.col("_group") == F.col("_match"), "left")
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_group", "_match", "_local", "_sum", "_offset")
    )


def list_position(df: DataFrame, order: Sequence[Column], bucket: Column, name: str) -> DataFrame:
    """Zero-based position of each row in the whole ordered table."""
    return running_total(df, [], bucket, order, F.lit(1), name).withColumn(
        name, (F.col(name) - 1).cast("int")
    )


def value_bucket(value: Column) -> Column:
    """Ascending bucket for an order by ``value`` descending, NULLs last."""
    step = lambda v: F.floor(F.ln(v) * 8)
    return (
        F.when(value > 0, -step(value))
        .when(value == 0, F.lit(1_000_000))
        .when(value < 0, F.lit(2_000_000) + step(-value))
        .otherwise(F.lit(4_000_000))
    )


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, share: float, min_rows: int = 1,
) -> DataFrame:
    """Interpolated percentile of positive values per group, as (keys, n, result).

    The built-in exact percentile holds every distinct value of a group in one
    task. Here equal values are counted first, map side, and the counts are
    ranked in slices of a thousandth, so the largest group is still spread out.
    """
    counts = df.filter(F.col(value) > 0).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_total(
        counts, keys, F.floor(F.ln(value) * 1000), [F.col(value)], F.col("_n"), "_upto", total="n"
    ).filter(F.col("n") >= min_rows)
    at = F.lit(share) * (F.col("n") - 1)
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
    low = F.max(F.when(holds(F.floor(at)), F.col(value)))
    high = F.max(F.when(holds(F.ceil(at)), F.col(value)))
    return (
        ranked.groupBy(*keys, "n")
        .agg(low.alias("_low"), high.alias("_high"))
        .withColumn("result", F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at)))
        .drop("_low", "_high")
    )


def larger_groups(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Staged (``_match``, ``name``) of the groups with more than one row; counted on the map side first."""
    sizes = grouped(df, keys).groupBy(F.col("_group").alias("_match")).agg(F.count("*").alias(name))
    return stage(sizes.filter(F.col(name) > 1), "groups")


def with_group_size(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows per group, attached to every row.

    Only groups of more than one row are joined. They are a written table, so a
    small one is broadcast by its size, and a large group of a shuffle join can be split.
    """
    sizes = larger_groups(df, keys, name)
    return (
        grouped(df, keys).join(sizes, F.col("_group") == F.col("_match"), "left")
        .withColumn(name, F.coalesce(name, F.lit(1).cast("long"))).drop("_group", "_match")
    )


def digest_bits(digests: DataFrame, bits: int = BITS) -> DataFrame:
    """Staged (``_at``, ``_words``): one of ``bits`` is set for each ``_digest``.

    A set bit may also stand for other keys, an unset one for none of these.
    The table has at most ``bits / ROW_BITS`` rows, however many digests there are.
    """
    bit = digests.select(F.pmod("_digest", F.lit(bits)).alias("_bit"))
    words = bit.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_set"))
    held = F.map_from_entries(F.collect_list(F.struct((F.col("_word") % (ROW_BITS // 64)).alias("k"), "_set")))
    tables = words.groupBy(F.floor(F.col("_word") / (ROW_BITS // 64)).alias("_at")).agg(held.alias("_held"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(ROW_BITS // 64 - 1).cast("long"))
    return stage(tables.select("_at", F.transform(every, lambda k: F.coalesce(F.col("_held")[k], F.lit(0).cast("long"))).alias("_words")), "bits")


def with_bit(df: DataFrame, digest: Column, held: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """Add ``name``: whether the bit of ``digest`` is set in ``held``; false for a NULL digest."""
    marked = df.withColumn("_bit", F.pmod(digest, F.lit(bits))).join(F.broadcast(held), F.floor(F.col("_bit") / ROW_BITS) == F.col("_at"), "left")
    word = F.get("_words", F.floor(F.col("_bit") % ROW_BITS / 64).cast("int"))
    is_set = F.expr("shiftleft(1L, cast(_bit & 63 as int))").bitwiseAND(word) != 0
    return marked.withColumn(name, F.coalesce(is_set, F.lit(False))).drop("_bit", "_at", "_words")


def shared_keys(rows: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """Bits of the digests of ``keys`` that several rows have; only digests are shuffled."""
    several = rows.groupBy(F.xxhash64(*keys).alias("_digest")).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    return digest_bits(several, bits)


def that_may_repeat(rows: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """``rows`` without those that no other is alike in ``keys``, but for a few that share a bit. Reads ``rows`` twice."""
    return with_bit(rows, F.xxhash64(*keys), shared_keys(rows, keys, bits), "_copies", bits).filter("_copies").drop("_copies")


def even_slices(df: DataFrame, column: str, slices: int = SLICES) -> Column:
    """Number of the slice that ``column`` falls in, ascending with it.

    The boundaries are values of the table, picked by hash, so slices are about
    even whatever the values look like; any boundaries give right results.
    """
    spread = df.filter(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column), column)
    bounds = sorted({r[0] for r in spread.limit(slices * 8).collect()})[::8]
    if not bounds:
        return F.lit(0)
    # NULL is in no slice and comes last
    return F.when(F.col(column).isNotNull(), F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column))))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows; each task keeps its own ``k`` before the merge."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rn",
    spread_by: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group; each map task drops what cannot be among them.

    That leaves up to ``k`` rows per map task and group. Where ``k`` times the
    number of map tasks is itself much for one task, name a column that varies
    within a group: the rows are then cut in slices of it first.
    """
    def first(rows: DataFrame, parts: Sequence) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*parts).orderBy(*order))
        return rows.withColumn(name, rank).filter(F.col(name) <= k)

    if spread_by is not None:
        df = df.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(SLICES)))
        df = first(df, [*keys, "_slice"]).drop("_slice", name)
    return first(df, keys)
