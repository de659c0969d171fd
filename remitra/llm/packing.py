"""Sum-of-squares packing of documents into windows of a fixed number of tokens.

A document fills whole windows first. What remains goes to the open window
whose level makes the sum of the squared level counts smallest: with ``N[h]``
open windows at level ``h``, an item of size ``s`` chooses between a new window
(cost ``2 N[s] + 1``), level ``h`` (``2 (N[h+s] - N[h]) + 2``) and a level that
it fills up (``1 - 2 N[h]``). Ties go to the fullest level.

Each partition packs its own rows in one pass, with a bounded number of open
windows in memory and no shuffle. When that bound is reached, and at the end,
the emptiest windows are cut up to fill the fullest. The single window that is
left over at the end is cut at powers of two, which need no padding.

Sequence numbers come from the partition number, so a lost task that runs again
over a table makes the same rows. Rows are documents of their own even if they
repeat an id; a null text counts as empty and is one end token; other columns
are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from remitra.llm.common import ship
from remitra.llm.tokens import encoder, with_end

WINDOW = 4096
OPEN_WINDOWS = 1024
SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


class Levels:
    """Open windows by level. A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, window: int, open_windows: int, first_id: int = 0):
        self.window, self.limit, self.next_id = window, open_windows, first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.at: dict[int, list[list]] = defaultdict(list)
        self.open = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        """Pieces in their order become a sequence."""
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids.tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def choose(self, size: int) -> int:
        """The level that an item of ``size`` goes to; 0 is a new window."""
        w, n = self.window, self.counts
        best, cost = 0, 2 * n[size] + 1
        if size < w:
            levels = n[1 : w - size + 1]
            used = np.flatnonzero(levels)
            if len(used):
                change = 2 * (n[used + 1 + size] - levels[used]) + 2
                if used[-1] + 1 + size == w:
                    change[-1] = 1 - 2 * levels[used[-1]]
                k = len(change) - 1 - int(np.argmin(change[::-1]))
                if change[k] <= cost:
                    best = int(used[k]) + 1
        return best

    def _put(self, level: int, pieces: list) -> None:
        if level == self.window:
            self.close(pieces)
        elif level:
            self.at[level].append(pieces)
            self.counts[level] += 1
            self.open += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        whole = total - total % w
        for start in range(0, whole, w):
            self.close([(doc, start, ids[start : start + w], total)])
        rest = ids[whole:]
        if not len(rest):
            return
        level, pieces = self.choose(len(rest)), []
        if level:
            pieces = self.at[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        pieces.append((doc, whole, rest.copy(), total))
        self._put(level + len(rest), pieces)
        if self.open >= self.limit:
            self.fill_up()

    def fill_up(self) -> None:
        """Fill the fullest windows with what the emptiest hold; at most one stays open."""
        windows = [(level, pieces) for level in sorted(self.at) for pieces in self.at[level]]
        self.at.clear()
        self.counts[:] = 0
        self.open = 0
        give, rest = 0, []
        while len(windows) > give or rest:
            if len(windows) > give:
                level, pieces = windows.pop()
            else:
                level, pieces = 0, []
            while level < self.window and (rest or len(windows) > give):
                if not rest:
                    rest = windows[give][1][::-1]
                    give += 1
                doc, start, ids, total = rest.pop()
                room = self.window - level
                pieces.append((doc, start, ids[:room], total))
                level += len(pieces[-1][2])
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
            self._put(level, pieces)

    def end(self) -> None:
        """Close everything; the last window is cut at powers of two."""
        self.fill_up()
        rest = [p for level in sorted(self.at) for pieces in self.at[level] for p in pieces][::-1]
        self.at.clear()
        self.counts[:] = 0
        self.open = 0
        left = sum(len(p[2]) for p in rest)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc, start, ids, total = rest.pop()
                pieces.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
                room -= len(pieces[-1][2])
            self.close(pieces)

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in _ARROW]
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, field.type) for c, field in zip(columns, _ARROW, strict=True)], schema=_ARROW
        )


def pack(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = 2,
    window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their ids, their sequence and their place in it."""
    ship(docs.sparkSession)
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        from pyspark import TaskContext

        levels = Levels(window, open_windows, TaskContext.get().partitionId() << 36)
        encode = encoder(path)
        for batch in batches:
            ids, ends = with_end(*encode(batch.column(1)), end_id)
            start = 0
            for doc, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                levels.add(doc, ids[start:end])
                start = end
                if len(levels.rows) >= 2_000:
                    yield levels.taken()
        levels.end()
        yield levels.taken()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
