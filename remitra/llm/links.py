"""Connected groups of nodes that share buckets, without forming all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.llm.common import if_small, staged, unstaged

STAR_ROUNDS = 3
#: Rows that a task of the steps on links takes at least; a few links aren't dealt over as many tasks as a corpus.
TASK_ROWS, LEAST_TASKS = 50_000, 6


def _tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, whose rows are at most about ``rows``, in no more tasks than they need."""
    return df.coalesce(max(LEAST_TASKS, rows // TASK_ROWS))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Large-star and small-star steps take turns until nothing changes. Each is a
    minimum per node, written, and an equi-join with it, so that a node with
    very many links is aggregated on the map side and its join can be split.
    """
    def step(edges: DataFrame, large: bool) -> DataFrame:
        pairs = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if large:
            pairs = pairs.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = staged(_tasks(pairs.groupBy(F.col("x").alias("_x")).agg(F.min("y").alias("_m")), rows), "least")
        low = F.least("_x", "_m")
        near = pairs.join(if_small(least), F.col("x") == F.col("_x"))
        if large:
            return near.filter("y > x").select(F.col("y").alias("u"), low.alias("v")).filter("u > v").distinct()
        down = near.select(F.col("y").alias("u"), low.alias("v"))
        own = least.select(F.col("_x").alias("u"), F.col("_m").alias("v"))
        return down.unionByName(own).filter("u > v").distinct()

    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links"
    )
    state, rows = None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state, rows = now, now[0]
        for large in (True, False):
            before, edges = edges, staged(_tasks(step(edges, large), rows), "links")
            unstaged(before)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def shared_buckets(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (bucket, node, ...) whose bucket holds more than one; a node is once in a bucket.

    Only bucket numbers are shuffled, to be counted; few hold more than one node.
    """
    counts = members.groupBy(F.col("bucket").alias("_bucket")).agg(F.count("*").alias("_n"))
    several = staged(counts.filter("_n > 1").select("_bucket"), "several")
    return members.join(if_small(several), F.col("bucket") == F.col("_bucket"), "left_semi")


def grouped_by_links(
    members: DataFrame, fits: Callable[[Column, Column], Column], confirmed: Callable[[DataFrame], DataFrame],
    rounds: int = STAR_ROUNDS, sharper: tuple[Callable[[DataFrame], DataFrame], Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """(node, root) of the groups that confirmed links between nodes of one bucket form.

    ``members`` has bucket, node and mark; ``fits`` tells by two marks whether a
    pair can be linked at all, ``confirmed`` keeps the linked ones of (a, b).

    Each round compares one member of every bucket, that with the most buckets,
    with the others, which is linear in the size of the bucket, and takes it
    out. Buckets that have become one group are done. What a bucket still holds
    of different groups after the last round is compared in full, so no link is
    lost. ``sharper`` may give new marks to the nodes that are left, and a
    condition on those, that rules out pairs which ``fits`` alone does not.
    """
    seen = members.groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("weight"))
    members = staged(members.join(if_small(staged(seen, "seen")), F.col("node") == F.col("_node")).drop("_node"), "members")
    rows = members.count()
    links, left = None, members.select("bucket", "node", "mark", "weight", F.col("node").alias("group"))
    for turn in range(rounds):
        first = F.min(F.struct((-F.col("weight")).alias("w"), F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node"), F.col("mark"), F.col("group")))
        heads = staged(_tasks(
            left.groupBy(F.col("bucket").alias("_bucket")).agg(first.alias("_f"))
            .select("_bucket", F.col("_f.node").alias("_node"), F.col("_f.mark").alias("_mark"), F.col("_f.group").alias("_group")), rows),
            "heads",
        )
        star = left.join(if_small(heads), F.col("bucket") == F.col("_bucket"))
        pairs = (
            star.filter((F.col("group") != F.col("_group")) & fits(F.col("mark"), F.col("_mark")))
            .select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
        )
        found = staged(confirmed(pairs), "confirmed")
        if links is None:
            links, roots = found, staged(_tasks(connected(found), rows), "roots")
        elif not found.isEmpty():
            links = links.unionByName(found)
            roots = staged(_tasks(connected(links), rows), "roots")
        rest = (
            star.filter(F.col("node") != F.col("_node")).select("bucket", "node", "mark", "weight")
            .join(if_small(roots.withColumnRenamed("node", "_n")), F.col("node") == F.col("_n"), "left")
            .select("bucket", "node", "mark", "weight", F.coalesce("root", "node").alias("group"))
        )
        rest = staged(_tasks(rest, rows), "members")
        open_ = (
            rest.groupBy(F.col("bucket").alias("_bucket")).agg(F.min("group").alias("_l"), F.max("group").alias("_h"))
            .filter("_l < _h").select("_bucket")
        )
        before = [heads] if turn == 0 else [heads, left]
        left = staged(rest.join(if_small(staged(_tasks(open_, rows), "open")), F.col("bucket") == F.col("_bucket"), "left_semi"), "members")
        unstaged(rest, *before)
        if left.isEmpty():
            return roots
    if sharper is not None:
        again, fits = sharper
        marks = again(left.select("node").distinct()).select(F.col("node").alias("_n"), F.col("mark").alias("_m"))
        left = left.drop("mark").join(if_small(staged(marks, "marks")), F.col("node") == F.col("_n")).select("bucket", "node", "group", F.col("_m").alias("mark"))
    left = left.select("bucket", "node", "mark", "group")
    other = left.select(*[F.col(c).alias(f"_{c}") for c in left.columns])
    pairs = (
        left.join(other, (F.col("bucket") == F.col("_bucket")) & (F.col("node") < F.col("_node"))
                  & (F.col("group") != F.col("_group")) & fits(F.col("mark"), F.col("_mark")))
        .select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct()
    )
    return staged(_tasks(connected(staged(links.unionByName(confirmed(pairs)), "confirmed")), rows), "roots")


