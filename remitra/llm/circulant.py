"""Near-duplicate documents by circulant MinHash, confirmed on whole shingle sets.

Two permutations make all coordinates of a signature: one spreads the shingles
over the positions of a circle, the other gives each position a value, and the
k-th coordinate is the smallest value when the second is shifted by k. A
position's values for all shifts are a contiguous slice of one table, so a
document's signature is the elementwise minimum of its shingles' slices.

Documents with the same set form one class. Classes that agree in all rows of
a band share a bucket; links between them are confirmed by the exact Jaccard
similarity of their sets. 48 bands of 7 rows leave out a pair at the threshold
of 0.8 with a probability of 1e-5. Within large families of copies that are not
all linked, parity words (each shingle turns one of 1,024 bits) rule out pairs
before they are formed: sets differ in at least as many shingles as bits, so
no link is lost.

Texts that are null, empty or without a word have the empty set and are linked
with nothing; fewer words than a shingle are one shingle. Rows that repeat an
id are documents of their own. Other columns are ignored; no rows, no result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.llm.common import if_small, ship, staged, words_of
from remitra.llm.links import grouped_by_links, shared_buckets

SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 48, 7
#: Parity words of 64 bits; more rule out more pairs of long documents.
PARITY = 16
_CIRCLE = 1 << 20
_STEP, _MIX_A, _MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(_MIX_A)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(_MIX_B)
    return values ^ (values >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _circle(coordinates: int) -> np.ndarray:
    """Row p holds the values of position p for all shifts."""
    values = np.random.default_rng(20).permutation(_CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: coordinates - 1]]), coordinates)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text."""
    import xxhash

    distinct, numbers, ends = words_of(texts)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    words = _mixed(hashes)[numbers]
    step = np.uint64(_STEP)
    n = max(0, len(words) - size + 1)
    windows = np.zeros(n, np.uint64)
    for k in range(size):
        windows = windows * step + words[k : k + n]
    windows = _mixed(windows)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= size:
            out.append(np.unique(windows[start : end - size + 1]))
        elif end > start:
            short = np.array([end - start], np.uint64)
            for word in words[start:end]:
                short = short * step + word
            out.append(_mixed(_mixed(short)))
        else:
            out.append(words[:0])
        start = end
    return out


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash of a non-empty set."""
    circle, at = _circle(coordinates), (_mixed(shingles + np.uint64(_STEP)) >> np.uint64(44)).astype(np.int64)
    best = circle[at[:2048]].min(axis=0)
    for k in range(2048, len(at), 2048):
        best = np.minimum(best, circle[at[k : k + 2048]].min(axis=0))
    return best


def _summaries(size: int, bands: int, rows: int):
    import xxhash

    powers = np.cumprod(np.full(rows, _STEP, np.uint64), dtype=np.uint64)

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(2), size)
            full = [s for s in sets if len(s)]
            keys = iter([])
            if full:
                signed = np.stack([signature(s, bands * rows) for s in full]).astype(np.uint64).reshape(-1, bands, rows)
                keys = iter(_mixed((signed * powers).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_MIX_A)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "th", "n_shingles", "class", "bands"],
            )

    return run


def parity(shingles: np.ndarray) -> np.ndarray:
    """``PARITY`` words whose bits tell if an odd number of shingles falls on them."""
    at = (_mixed(shingles) % np.uint64(64 * PARITY)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64)


def _sets(size: int):
    import xxhash

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parity(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["node", "found", "shingles", "parity"],
            )

    return run


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document (doc_id, text) of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 times their common shingles are at least
    ``percent`` times all their shingles; component_id is the smallest doc_id
    that links lead to. ``kept`` marks the documents that have it.
    """
    ship(docs.sparkSession)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) th", "cast(text as string) text")
    documents = staged(
        texts.mapInArrow(_summaries(size, bands, rows), "doc_id long, th long, n_shingles long, class binary, bands array<long>"), "signatures"
    )
    classes = (
        documents.filter("class is not null").groupBy("class")
        .agg(F.min(F.struct("doc_id", "th", "n_shingles", "bands")).alias("f"))
        .select(F.monotonically_increasing_id().alias("node"), "class", "f.doc_id", "f.th", F.col("f.n_shingles").alias("mark"), "f.bands")
    )
    classes = staged(classes, "classes")
    members = staged(shared_buckets(classes.select(F.explode("bands").alias("bucket"), "node", "mark")), "members")
    wanted = members.select("node").distinct()
    wanted = staged(
        classes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("class").alias("_class")),
        "wanted",
    )
    sets = (
        texts.join(if_small(wanted), (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
        .select("node", "text").mapInArrow(_sets(size), "node long, found binary, shingles array<long>, parity array<long>")
    )
    keys = wanted.select(F.col("node").alias("_node"), "_class")
    sets = staged(
        sets.join(if_small(keys), (F.col("node") == F.col("_node")) & (F.col("found") == F.col("_class"))).select("node", "shingles", "parity").dropDuplicates(["node"]),
        "sets",
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
        common = F.size(F.array_intersect("_a", "_b"))
        return pairs.join(left, "a").join(right, "b").filter(
            100 * common >= percent * (F.size("_a") + F.size("_b") - common)
        ).select("a", "b")

    small, large = F.least, F.greatest

    def shared_shingles(nodes: DataFrame) -> DataFrame:
        """A node's set size, how many of its shingles any other of ``nodes`` has, and its parity words."""
        own = staged(sets.join(if_small(staged(nodes, "left")), "node", "left_semi").select("node", F.size("shingles").cast("long").alias("n"), "shingles", "parity"), "left")
        each = own.select("node", F.explode("shingles").alias("s"))
        common = each.groupBy(F.col("s").alias("_s")).agg(F.min("node").alias("_l"), F.max("node").alias("_h")).filter("_l < _h").select("_s")
        held = each.join(common, F.col("s") == F.col("_s")).groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("held"))
        return own.join(held, F.col("node") == F.col("_node"), "left").select(
            "node", F.struct("n", F.coalesce("held", F.lit(0)).alias("held"), "parity").alias("mark")
        )

    def may_share(m: Column, n: Column) -> Column:
        """Whether what both sets share with others would be enough, and their parity words differ little enough."""
        most = small(m["held"], n["held"])
        apart = sum(F.bit_count(m["parity"][k].bitwiseXOR(n["parity"][k])) for k in range(PARITY))
        both = m["n"] + n["n"]
        return (100 * most >= percent * (both - most)) & ((100 + percent) * apart <= (100 - percent) * both)

    roots = grouped_by_links(
        members, lambda m, n: 100 * small(m, n) >= percent * large(m, n), confirmed, sharper=(shared_shingles, may_share)
    )
    of_class = classes.select("node", "class", F.col("doc_id").alias("_doc")).join(roots, "node", "left")
    of_class = staged(of_class.select(F.col("class").alias("_class"), "_doc", F.coalesce("root", "node").alias("root")), "rooted")
    least = of_class.groupBy("root").agg(F.min("_doc").alias("component"))
    named = staged(of_class.join(least, "root").select("_class", "component"), "components")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return (
        documents.select("doc_id", "n_shingles", "class").join(named, F.col("class") == F.col("_class"), "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    )
