"""Merkle manifest of a table: a tree per group, a tree over the groups' roots, and proofs of every row.

H is the lowercase hex SHA-256 of its inputs one after the other, digests as hex
text. A leaf is H of a row's fields, each ``-`` if null, else its UTF-8 byte
count, a colon and the value. Within a group leaves ascend by the order column
(nulls first, then by leaf). While a level has several nodes, every ``arity``
consecutive ones become their H, the last run having fewer, even one; what
remains is the group's subroot, a lone leaf itself. Subroots, ordered by group
(null first, then bytewise), give the root in the same way.

Positions come from one range partitioning of digests, with running counts per
partition. A tree is cut into aligned blocks of ``arity ** LEVELS`` nodes. A
block keeps each of its levels as one string of 64 characters a node: parents are
hashes of its fixed-width substrings, and what flanks a node within its run's
substring is its siblings' segment of the proof. Roots of blocks are the nodes of
the next pass, so a tree of any size takes a few passes, each a fraction of the
one before, and no task holds more than a block. Going down again, a block's rows
add their segments to the path of the block.

Rows of equal fields are leaves of their own with equal digests; which of them
comes first cannot be seen. Rows without an order value come first. Other columns
are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from remitra.llm.common import if_small, staged

WIDTH = 64
#: Levels that a block rises at once.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def positions(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Add ``position`` of each row in its group, from 0, and ``size`` of the group.

    The table is range-partitioned once, equal rows too, and written; each
    partition's rows of a group are shifted by those in the partitions before.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "_row")]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    written = staged(ranged.drop("_row").select("*", F.spark_partition_id().alias("_part"), place.alias("_at")), name)
    runs = written.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = W.partitionBy("_group")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shifts = runs.select(
        F.col("_part").alias("_run"), "_group", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"),
    )
    shifts = if_small(staged(shifts, f"{name}-shifts"))
    same = (F.col("_part") == F.col("_run")) & F.col(group).eqNullSafe(F.col("_group"))
    return written.join(shifts, same).withColumn("position", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_run", "_group", "_shift")


def _rise(level: Column, arity: int) -> Column:
    """The next level's string: hashes of fixed-width substrings."""
    run = arity * WIDTH
    runs = F.ceil(F.octet_length(level) / run).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), runs - 1), lambda k: F.sha2(F.substring(level, k * run + 1, F.lit(run)), 256))
    return F.array_join(hashes, "").cast("binary")


def blocks(nodes: DataFrame, arity: int) -> DataFrame:
    """Aligned blocks of ``nodes`` (tree, position, size, digest, payload) with their levels, rows in order."""
    width = arity**LEVELS
    height = sum((F.col("size") > arity**k).cast("int") for k in range(LEVELS))
    grouped = (
        nodes.groupBy("tree", F.floor(F.col("position") / width).alias("block"), "size")
        .agg(F.sort_array(F.collect_list(F.struct("position", "digest", "payload"))).alias("rows"))
        .withColumn("lowest", F.array_join(F.col("rows.digest"), "").cast("binary"))
    )
    levels = F.aggregate(
        F.array_repeat(F.lit(0), height), F.array("lowest"),
        lambda found, _: F.concat(found, F.array(_rise(F.element_at(found, -1), arity))),
    )
    return grouped.select("tree", "block", "size", F.col("rows.payload").alias("payloads"), levels.alias("levels"))


def rise(nodes: DataFrame, largest: int, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All passes over trees of up to ``largest`` nodes, lowest first, and (tree, digest) of what remains."""
    width, passes = arity**LEVELS, []
    while True:
        passes.append(staged(blocks(nodes, arity), f"{name}-{len(passes)}"))
        top = passes[-1].select("tree", "block", "size", F.element_at("levels", -1).cast("string").alias("digest"))
        if largest <= width:
            return passes, top.select("tree", "digest")
        largest = -(-largest // width)
        nodes = top.select(
            "tree", F.col("block").alias("position"), F.ceil(F.col("size") / width).alias("size"), "digest", F.lit(None).cast("string").alias("payload"),
        )


def _segments(levels: Column, place: Column, arity: int) -> Column:
    """Left and right siblings, level by level, of the node at ``place`` of a block."""
    powers = F.array(*[F.lit(arity**k) for k in range(LEVELS + 1)])

    def flanks(level, k):
        at = F.floor(place / F.get(powers, k)).cast("int")
        first = F.floor(at / arity).cast("int") * arity
        left = F.substring(level, first * WIDTH + 1, (at - first) * WIDTH)
        right = F.substring(level, (at + 1) * WIDTH + 1, (first + arity - 1 - at) * WIDTH)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), flanks)


def descend(passes: list[DataFrame], paths: DataFrame, arity: int) -> DataFrame:
    """(tree, block, subroot, path) of the trees' roots becomes (tree, position, subroot, payload, leaf, path) of the lowest nodes."""
    width = arity**LEVELS
    low = F.get("levels", F.lit(0))

    def row(payload, place):
        return F.struct(
            payload.alias("payload"), (F.col("block") * width + place).alias("position"),
            F.substring(low, place * WIDTH + 1, F.lit(WIDTH)).cast("string").alias("leaf"),
            F.concat(_segments(F.col("levels"), place, arity), F.col("path")).alias("path"),
        )

    for level in reversed(passes):
        found = level.join(paths, ["tree", "block"]).select("tree", "subroot", F.inline(F.transform("payloads", row)))
        paths = found.select("tree", F.col("position").alias("block"), "subroot", "path")
    return found


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda digest, at: F.sha2(F.concat(at["left"], digest, at["right"]), 256))


def proofs(
    docs: DataFrame, claimed: Mapping[str, Column] | None = None, fields: Sequence[str] = FIELDS,
    group: str = "lang", order: str = "doc_id", arity: int = 2,
) -> DataFrame:
    """Every row's leaf, subroot, root, path to the root and the root that its claimed fields fold to.

    ``claimed`` gives fields as someone else holds them, by columns of ``docs``;
    a row whose fields are as claimed folds from its own leaf. The result has the
    order column, leaf, subroot, root, path (left and right siblings by level),
    folded_root, and verified: whether folded_root is root.
    """
    claims = claimed or {}
    changed = F.lit(False)
    for name, value in claims.items():
        changed = changed | ~value.eqNullSafe(F.col(name))
    other = F.when(changed, leaf([claims.get(name, F.col(name)) for name in fields]))
    leaves = staged(
        docs.select(F.col(group).alias("group"), F.col(order).alias("order"), leaf([F.col(name) for name in fields]).alias("digest"), other.alias("claim")),
        "leaves",
    )
    groups = positions(leaves.select("group").distinct().withColumn("one", F.lit(1)), "one", ["group"], "groups")
    groups = if_small(staged(groups.select(F.col("group").alias("of"), F.col("position").alias("tree"), F.col("size").alias("groups")), "trees"))
    placed = positions(leaves, "group", ["order", "digest"], "ordered").join(groups, F.col("group").eqNullSafe(F.col("of")))
    nodes = placed.select("tree", "position", "size", "digest", F.struct("order", "claim").alias("payload"))
    counted = leaves.groupBy("group").count().agg(F.max("count"), F.count("*")).first()
    passes, subroots = rise(nodes, counted[0] or 1, arity, "blocks")
    subroots = staged(subroots, "subroots")
    tops = subroots.join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), F.col("groups").alias("size"), "digest", F.col("digest").alias("payload"))
    upper, root = rise(tops, counted[1] or 1, arity, "roots")
    start = root.select("tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), F.array().cast(_PATH).alias("path"))
    tree_paths = descend(upper, start, arity).select(
        F.col("position").alias("tree"), F.lit(0).cast("long").alias("block"), F.struct(F.col("payload").alias("own"), F.col("subroot").alias("root")).alias("subroot"), "path",
    )
    found = descend(passes, staged(tree_paths, "tree-paths"), arity)
    folded = fold(F.coalesce("payload.claim", "leaf"), F.col("path"))
    return found.select(
        F.col("payload.order").alias(order), "leaf", F.col("subroot.own").alias("subroot"), F.col("subroot.root").alias("root"), "path", folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
