"""Re-Pair compression of token ids into files that give back any document or range of ids.

Documents are dealt out in ascending order of doc_id. A task encodes its range
in blocks of about a million ids; each block is a row of a Parquet file:

| column | holds |
| --- | --- |
| shard, block | place in the order; blocks of a shard follow each other |
| n_tokens, before | ids of the block; ids of the shard before it |
| doc_ids | its documents in order |
| doc_symbols, doc_tokens | little-endian 64-bit: symbols, and ids, up to each document's end |
| rules | little-endian 16-bit pairs of symbols; rule ``k`` is symbol ``base + k`` |
| lengths | little-endian 32-bit: ids that each rule expands to |
| symbols | little-endian 16-bit: the documents in symbols |

A block is compressed in rounds: pairs of neighbouring symbols are counted, the
frequent ones become rules, and their occurrences are replaced where they don't
overlap a more frequent one. No pair crosses documents, so each one is a range
of symbols; cumulated expansion lengths lead to the symbols of any range of ids.

Rows are documents of their own even if they repeat an id; a null text is
empty and has one end id; null ids come first; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from remitra.llm.common import ship
from remitra.llm.tokens import encoder, with_end

BLOCK_TOKENS = 1 << 20
ROUNDS = 6
LEAST = 8
RULES_A_ROUND = 4096
SYMBOLS = 1 << 16
_BUCKETS = 1 << 18
_MIX = ((2654435761, 2246822519), (3266489917, 668265263), (374761393, 2869860233), (2097192037, 3812015801))
SCHEMA = (
    "shard int, block int, base int, n_tokens long, before long, doc_ids array<long>, doc_symbols binary, "
    "doc_tokens binary, rules binary, lengths binary, symbols binary"
)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, rounds: int = ROUNDS, least: int = LEAST):
    """Rules (n, 2), their lengths, the symbols, and where each document's symbols end."""
    symbols, ends = ids.astype(np.uint32), ends.astype(np.int64)
    rules: list[np.ndarray] = []
    lengths = np.ones(base, np.int64)
    following = base
    for round_ in range(rounds):
        free = min(RULES_A_ROUND, SYMBOLS - following)
        if len(symbols) < 2 or free <= 0:
            break
        left, right = symbols[:-1], symbols[1:]
        mix = _MIX[round_ % len(_MIX)]  # pairs that share a bucket part in the next round
        bucket = ((left * np.uint32(mix[0]) + right * np.uint32(mix[1])) >> np.uint32(14)).astype(np.int64)
        bucket[ends[:-1] - 1] = 0  # bucket 0 is never taken: no pair crosses documents
        counts = np.bincount(bucket, minlength=_BUCKETS)
        counts[0] = 0
        above = np.cumsum(np.bincount(np.minimum(counts, 1 << 16))[::-1])[::-1]  # buckets with so many or more
        enough = max(least, int(np.searchsorted(-above, -free)))
        at = np.flatnonzero((counts >= enough)[bucket])
        if not len(at):
            break
        cell = bucket[at]
        first = np.zeros(_BUCKETS, np.int64)
        first[cell] = at  # one pair stands for its bucket; others wait for a later round
        same = (left[at] == left[first][cell]) & (right[at] == right[first][cell])
        at, cell = at[same], cell[same]
        weight = np.bincount(cell, minlength=_BUCKETS)[cell] * 2 + (at & 1)
        beats = np.ones(len(at), bool)
        touch = at[1:] == at[:-1] + 1
        beats[1:] &= ~touch | (weight[1:] > weight[:-1])
        beats[:-1] &= ~touch | (weight[:-1] > weight[1:])
        at, cell = at[beats], cell[beats]
        used = np.bincount(cell, minlength=_BUCKETS)
        chosen = np.flatnonzero(used >= least)
        if len(chosen) > free:
            chosen = np.sort(chosen[np.argsort(-used[chosen], kind="stable")[:free]])
        if not len(chosen):
            break
        number = np.zeros(_BUCKETS, np.uint32)
        number[chosen] = following + np.arange(len(chosen), dtype=np.uint32)
        taken = number[cell] > 0
        at, cell = at[taken], cell[taken]
        pairs = np.stack([left[first[chosen]], right[first[chosen]]], axis=1)
        rules.append(pairs)
        lengths = np.concatenate([lengths, lengths[pairs[:, 0]] + lengths[pairs[:, 1]]])
        following += len(chosen)
        gone = at + 1
        ends = ends - np.searchsorted(gone, ends, side="left")
        keep = np.ones(len(symbols), bool)
        keep[gone] = False
        symbols = symbols.copy()
        symbols[at] = number[cell]
        before = len(symbols)
        symbols = symbols[keep]
        if before - len(symbols) < before // 50:
            break
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return table, lengths[base:], symbols, ends


class Grammar:
    """The rules of a block; expands symbols in bulk or only where asked."""

    def __init__(self, base: int, rules: bytes, lengths: bytes):
        self.base = base
        self.pairs = np.frombuffer(rules, "<u2").reshape(-1, 2).astype(np.int64)
        self.sizes = np.concatenate([np.ones(base, np.int64), np.frombuffer(lengths, "<u4").astype(np.int64)])
        self._values = None

    def _table(self) -> None:
        known: list[bytes] = []
        one = lambda s: known[s - self.base] if s >= self.base else int(s).to_bytes(4, "little")
        for a, b in self.pairs.tolist():
            known.append(one(a) + one(b))
        self._values = np.concatenate([np.arange(self.base, dtype=np.uint32), np.frombuffer(b"".join(known), "<u4")])
        self._first = np.concatenate([[0], np.cumsum(self.sizes)])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of ``symbols``."""
        if self._values is None:
            self._table()
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.uint32)
        shift = np.repeat(self._first[symbols] - (ends - sizes), sizes)
        return self._values[shift + np.arange(ends[-1])]

    def part(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a document, expanding only the symbols that cover them."""
        ends = np.cumsum(self.sizes[symbols])
        low, high = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[low - 1]) if low else 0
        out, stack = [], symbols[low:high].tolist()[::-1]
        while stack:
            symbol = stack.pop()
            size = int(self.sizes[symbol])
            if before + size <= start or before >= stop:
                before += size
            elif symbol < self.base:
                out.append(symbol)
                before += 1
            else:
                left, right = self.pairs[symbol - self.base].tolist()
                stack += [right, left]
        return np.array(out, np.uint32)


def _row(shard: int, block: int, before: int, base: int, docs: list, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    rules, lengths, symbols, symbol_ends = compress(ids, ends, base)
    row = {
        "shard": (shard, pa.int32()), "block": (block, pa.int32()), "base": (base, pa.int32()),
        "n_tokens": (len(ids), pa.int64()), "before": (before, pa.int64()), "doc_ids": (docs, pa.list_(pa.int64())),
        "doc_symbols": (symbol_ends.astype("<i8").tobytes(), pa.binary()), "doc_tokens": (ends.astype("<i8").tobytes(), pa.binary()),
        "rules": (rules.astype("<u2").tobytes(), pa.binary()), "lengths": (lengths.astype("<u4").tobytes(), pa.binary()),
        "symbols": (symbols.astype("<u2").tobytes(), pa.binary()),
    }
    return pa.RecordBatch.from_pydict({k: pa.array([v], t) for k, (v, t) in row.items()})


def write_ids(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2,
    block_tokens: int = BLOCK_TOKENS, partitions: int | None = None,
) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``folder`` in ascending doc_id order."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        shard, block, before, encode = TaskContext.get().partitionId(), 0, 0, encoder(path)
        if encode.size > SYMBOLS:
            raise ValueError(f"{encode.size} ids do not fit 16-bit symbols")
        docs: list = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        held = 0
        for batch in batches:
            ids, ends = with_end(*encode(batch.column(1)), end_id)
            start = 0
            for doc, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                docs.append(doc)
                parts.append(ids[start:end])
                sizes.append(end - start)
                held += end - start
                start = end
                if held >= block_tokens:
                    yield _row(shard, block, before, encode.size, docs, np.concatenate(parts), np.cumsum(sizes))
                    block, before, docs, parts, sizes, held = block + 1, before + held, [], [], [], 0
            parts = [np.concatenate(parts)] if parts else []  # lets go of the batch
        if docs:
            yield _row(shard, block, before, encode.size, docs, np.concatenate(parts), np.cumsum(sizes))

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(text) as _tie")
    (
        rows.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
        .mapInArrow(run, SCHEMA).write.parquet(folder)
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids (little-endian 32-bit)."""
    ship(spark)
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                grammar = Grammar(row["base"], row["rules"], row["lengths"])
                ids = grammar.expand(np.frombuffer(row["symbols"], "<u2"))
                ends = np.frombuffer(row["doc_tokens"], "<i8")
                starts = np.concatenate([[0], ends[:-1]])
                data = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(starts + row["before"] + row["_shift"], pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids": pa.array([data[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                })

    return (
        blocks.join(offsets, F.col("shard") == F.col("_shard"))
        .select("base", "before", "doc_ids", "doc_tokens", "rules", "lengths", "symbols", "_shift")
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    )


def read_range(spark: SparkSession, folder: str, doc_id: int, start: int, stop: int) -> list[int]:
    """Ids ``start`` to ``stop`` of one document, without expanding the rest of its block."""
    found = spark.read.schema(SCHEMA).parquet(folder).filter(F.array_contains("doc_ids", doc_id)).limit(1).collect()
    if not found:
        return []
    row = found[0]
    k = row.doc_ids.index(doc_id)
    ends = np.frombuffer(bytes(row.doc_symbols), "<i8")
    symbols = np.frombuffer(bytes(row.symbols), "<u2")[ends[k - 1] if k else 0 : ends[k]].astype(np.int64)
    return Grammar(row.base, bytes(row.rules), bytes(row.lengths)).part(symbols, start, stop).tolist()
