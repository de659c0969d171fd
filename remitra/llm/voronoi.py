"""Exact top-k by inner product as a Voronoi join.

Pivots are rows of the table. Every vector belongs to the cell of its nearest
pivot; a cell's summary is its size, its radius and the distances of the k + 1
vectors nearest to the pivot. For a query q and a vector x at distance d from
pivot p, the score lies within ``|q| d`` of ``q p``, so the summaries bound
each query's k-th best score from below and each cell's best from above. A
query is copied only to the cells that can reach its bound.

Cells are cut into blocks of bounded size, and queries into chunks, so that a
cell of any size is spread over tasks; each pair of block and chunk is solved
by one matrix product, and the best k of every block are merged. Of equal
vectors only the k + 1 smallest ids can be among anyone's best, so the others
are set aside before.

Vectors that are null, or hold a null or non-finite component, take no part,
nor do rows without an id. Of rows that repeat an id the smallest vector stands
for it. Shorter vectors count as padded with zeros. Scores must fit 64 bits.
Fewer than k other rows give fewer results; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from remitra.llm.common import ship, staged
from remitra.operators.scale import top_k_per_group

PIVOTS = 32
BLOCK_ROWS, CHUNK_ROWS = 8192, 4096


def quantised(embedding: Column, factor: int = 64) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * factor))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    out = np.zeros((len(column), dims))
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def _best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int):
    """(query row, data row, score) of each query's k best rows; ``ids`` ascend."""
    largest = np.abs(queries).sum(axis=1).max() * np.abs(data).max()
    if largest < 2**53:
        score = (queries @ data.T).astype(np.int64)
    else:
        score = np.array([[sum(int(a) * int(b) for a, b in zip(q, x, strict=True)) for x in data] for q in queries], np.int64)
    n = len(ids)
    own = query_ids[:, None] == ids
    if largest < 2**62 / n:
        key = score * n + np.arange(n - 1, -1, -1)
        key[own] = np.iinfo(np.int64).min
        at = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), key.shape)
    else:
        at = np.stack([np.lexsort((ids, -s.astype(object)))[: k + 1] for s in score])
    rows = np.repeat(np.arange(len(queries)), at.shape[1])
    at = at.ravel()
    real = ~own[rows, at]
    return rows[real], at[real], score[rows[real], at[real]]


def top_k(vectors: DataFrame, is_query: Column, k: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, vec array<long>) that ``is_query`` selects."""
    ship(vectors.sparkSession)
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "vec").filter("vec_id is not null and vec is not null and not exists(vec, x -> x is null)")
    rows = staged(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    dims = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    centres = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    centre = np.zeros((len(centres), dims))
    for j, row in enumerate(centres):
        centre[j, : len(row.vec)] = row.vec

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            far = (x * x).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(axis=1)
            cell = far.argmin(axis=1)
            distance = np.sqrt(((x - centre[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0), "vec": pa.array([r.tobytes() for r in x], pa.binary()),
                "cell": pa.array(cell, pa.int32()), "distance": pa.array(distance, pa.float64()),
            })

    schema = "vec_id long, vec binary, cell int, distance double"
    if not centres:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).limit(0)
    everyone = staged(rows.mapInArrow(assign, schema), "cells")
    data = staged(top_k_per_group(everyone, ["cell", "vec"], [F.col("vec_id")], k + 1, spread_by="vec_id").select("vec_id", "vec", "cell", "distance"), "data")
    near = top_k_per_group(data.select("cell", "distance", "vec_id"), ["cell"], [F.col("distance"), F.col("vec_id")], k + 1, spread_by="vec_id")
    near = near.groupBy("cell").agg(F.collect_list("distance").alias("near"))
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).join(near, "cell").collect()
    cells = np.array([r.cell for r in summary], np.int64)
    radius = np.array([r.radius for r in summary])
    blocks = np.array([-(-r.n // block_rows) for r in summary], np.int64)
    owner = np.repeat(np.arange(len(cells)), [len(r.near) for r in summary])
    close = np.concatenate([r.near for r in summary])
    wanted = everyone.filter(is_query).select("vec_id", "vec")
    chunks = max(1, -(-wanted.count() // chunk_rows))

    def replicate(batches):
        for batch in batches:
            q = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, dims)
            length = np.sqrt((q * q).sum(axis=1))[:, None]
            middle = q @ centre[cells].T
            slack = 1e-9 * (1 + np.abs(middle).max(initial=0) + length.max(initial=0) * max(radius.max(), 1))
            least = np.sort(middle[:, owner] - length * close, axis=1)[:, ::-1]
            bound = least[:, min(k, least.shape[1] - 1)] if least.shape[1] > k else np.full(len(q), -np.inf)
            who, where = np.nonzero(middle + length * radius >= bound[:, None] - slack)
            times = blocks[where]
            who, where = np.repeat(who, times), np.repeat(where, times)
            block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            for low in range(0, len(who), 20_000):
                part = slice(low, low + 20_000)
                yield pa.RecordBatch.from_pydict({
                    "query_id": batch.column(0).take(pa.array(who[part])), "query": batch.column(1).take(pa.array(who[part])),
                    "cell": pa.array(cells[where[part]], pa.int32()), "block": pa.array(block[part], pa.int64()),
                })

    asked = wanted.mapInArrow(replicate, "query_id long, query binary, cell int, block long")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    count_of = F.create_map(*[F.lit(int(x)) for pair in zip(cells, blocks, strict=True) for x in pair])
    dealt = data.withColumns({
        "block": F.pmod(F.xxhash64("vec_id"), F.element_at(count_of, F.col("cell")).cast("long")),
        "chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))),
    })

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)}
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            q = np.frombuffer(b"".join(left["query"]), np.float64).reshape(len(left), dims)
            x = np.frombuffer(b"".join(right["vec"]), np.float64).reshape(len(right), dims)
            asks, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
            parts = []
            for low in range(0, len(q), 256):
                who, at, score = _best(q[low : low + 256], asks[low : low + 256], x, ids, k)
                parts.append((asks[low + who], ids[at], score))
            columns = dict(zip(columns, map(np.concatenate, zip(*parts, strict=True)), strict=True))
        return pd.DataFrame(columns)

    key = ["cell", "block", "chunk"]
    found = asked.groupBy(*key).cogroup(dealt.select(*key, "vec_id", "vec").groupBy(*key)).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
