"""Byte-level BPE of whole texts by a file of ranks, and back to bytes.

A text is cut by the vocabulary's pattern, and each match is merged on its own.
A segment tree over the match's byte positions holds, in the leaf of each
position where a token starts, the rank of joining that token with the next one,
followed by the position; a node holds the least of its two children, so the
root names the leftmost pair of least rank. A merge changes three leaves: that of
the joined token, of the one before it and of the one that is gone; each change
climbs to the root. A match of n bytes takes O(n log n) steps whatever it consists
of. The trees of many short matches are kept in one array and merged side by side;
a long match has its own. A match that is a token itself is that token.

Null texts count as empty and have no ids; ids of null decode to null. Rows are
encoded one by one, so repeated rows and repeated ids come back as often as they
went in. Other columns are ignored, and an empty table gives an empty result.
Texts of any length are encoded whole, in bounded memory beside the text itself.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from remitra.llm.common import ship

#: Matches of a text that are held at once, bytes of text and ids of a batch, and leaves of trees merged together.
MATCHES, BATCH_BYTES, BATCH_IDS, TREE_NODES = 200_000, 4_000_000, 250_000, 1 << 18
#: Bytes of a match up to which its tree is merged side by side with others.
SIDE_BY_SIDE = 512

#: Marks the first chunk of a text, which no space precedes.
_FIRST = "\x02"
#: White space, then a space; or the mark itself.
_IRREGULAR = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] |\x02"


class Ranks:
    """Ranks by token, and by the ids of any two tokens that make up a third."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            rows = [line.split() for line in file if line.strip()]
        self.of = {base64.b64decode(token): int(rank) for token, rank in rows}
        missing = [b for b in range(256) if bytes([b]) not in self.of]
        if missing:
            raise ValueError(f"no rank for the bytes {missing}")
        self.width = max(self.of.values()) + 1
        self.longest = max(map(len, self.of))
        self.bytes = np.array([self.of[bytes([b])] for b in range(256)], np.int64)
        halves = ((self.of.get(t[:k]), self.of.get(t[k:]), rank) for t, rank in self.of.items() for k in range(1, len(t)))
        pairs = np.array([h for h in halves if h[0] is not None and h[1] is not None], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.joined = np.append(keys[order], np.iinfo(np.int64).max), np.append(pairs[order, 2], 0)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the token that two tokens make up, -1 if none."""
        keys = left * self.width + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.joined[at], -1)


class PairTrees:
    """Segment trees of many byte strings of up to ``leaves`` bytes, merged side by side.

    A leaf holds the rank of joining the token that starts at its byte with the next
    one, times ``leaves``, plus its place; a node holds the least of its children.
    """

    def __init__(self, ranks: Ranks, pieces: list[bytes], leaves: int):
        n = len(pieces)
        self.ranks, self.leaves = ranks, leaves
        self.none = np.int64(ranks.width * leaves)
        self.sizes = np.fromiter(map(len, pieces), np.int64, n)
        padded = b"".join(piece.ljust(leaves, b"\0") for piece in pieces)
        place = np.arange(leaves)
        self.ids = np.where(place < self.sizes[:, None], ranks.bytes[np.frombuffer(padded, np.uint8).reshape(n, leaves)], -1).ravel()
        self.after, self.before = np.tile(place + 1, n), np.tile(place - 1, n)
        self.nodes = np.full(2 * leaves * n, self.none)
        tree = self.nodes.reshape(n, 2 * leaves)
        grid = self.ids.reshape(n, leaves)
        joined = np.where(grid[:, 1:] >= 0, ranks.join(grid[:, :-1], grid[:, 1:]), -1)
        tree[:, leaves:-1] = np.where(joined >= 0, joined * leaves + place[:-1], self.none)
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

    def pair(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and place of joining the tokens at ``at`` with their next ones."""
        base = rows * self.leaves
        middle = self.after[base + at]
        inside = middle < self.sizes[rows]
        joined = self.ranks.join(self.ids[base + at], self.ids[base + np.where(inside, middle, at)])
        return np.where(inside & (joined >= 0), joined * self.leaves + at, self.none)

    def put(self, rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """Change one leaf of each row and what is above it."""
        base, node = rows * (2 * self.leaves), at + self.leaves
        self.nodes[base + node] = value
        for _ in range(self.leaves.bit_length() - 1):
            value = np.minimum(value, self.nodes[base + (node ^ 1)])
            node = node >> 1
            self.nodes[base + node] = value

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings after all merges, and how many each has. In a round every string joins its leftmost pair of least rank."""
        roots = 2 * self.leaves * np.arange(len(self.sizes)) + 1
        rows = np.flatnonzero(self.nodes[roots] < self.none)
        while len(rows):
            joined, at = np.divmod(self.nodes[roots[rows]], self.leaves)
            base = rows * self.leaves
            gone = self.after[base + at]
            end = self.after[base + gone]
            self.ids[base + at], self.ids[base + gone] = joined, -1
            self.after[base + at] = end
            inside = end < self.sizes[rows]
            self.before[(base + end)[inside]] = at[inside]
            self.put(rows, gone, np.full(len(rows), self.none))
            self.put(rows, at, self.pair(rows, at))
            before = self.before[base + at]
            some = before >= 0
            self.put(rows[some], before[some], self.pair(rows[some], before[some]))
            rows = rows[self.nodes[roots[rows]] < self.none]
        live = self.ids >= 0
        return self.ids[live], live.reshape(-1, self.leaves).sum(axis=1)


def merged_alone(ranks: Ranks, piece: bytes) -> list[int]:
    """Ids of one long byte string by a tree of its own; a change climbs until a node keeps its value."""
    n, of, longest = len(piece), ranks.of, ranks.longest
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    leaves = 1 << (n - 1).bit_length()
    none = ranks.width * leaves
    nodes = [none] * (2 * leaves)

    def pair(at: int) -> int:
        end = after[after[at]] if after[at] < n else n + 1
        rank = of.get(piece[at:end]) if end <= n and end - at <= longest else None
        return none if rank is None else rank * leaves + at

    def put(at: int, value: int) -> None:
        node = leaves + at
        nodes[node] = value
        while node > 1:
            value = min(value, nodes[node ^ 1])
            node >>= 1
            if nodes[node] == value:
                return
            nodes[node] = value

    nodes[leaves : leaves + n] = map(pair, range(n))
    for node in range(leaves - 1, 0, -1):
        nodes[node] = min(nodes[2 * node], nodes[2 * node + 1])
    while nodes[1] < none:
        at = nodes[1] % leaves
        gone = after[at]
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        put(gone, none)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    ids, at = [], 0
    while at < n:
        ids.append(of[piece[at : after[at]]])
        at = after[at]
    return ids


class Vocabulary:
    """Encodes texts by ranks and a pattern, and decodes ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = Ranks(path)
        self.pattern = regex.compile(pattern)
        tokens = sorted((rank, token) for token, rank in self.ranks.of.items())
        self.sizes = np.full(self.ranks.width, -1, np.int64)
        self.sizes[[rank for rank, _ in tokens]] = [len(token) for _, token in tokens]
        self.firsts = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)
        self.bytes = np.frombuffer(b"".join(token for _, token in tokens), np.uint8)

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte strings one after the other, and how many each has."""
        whole = np.fromiter((self.ranks.of.get(piece, -1) for piece in pieces), np.int64, len(pieces))
        values, firsts, sizes = [whole], np.arange(len(pieces)), np.ones(len(pieces), np.int64)
        held = len(whole)
        rest = np.flatnonzero(whole < 0)
        lengths = np.fromiter((len(pieces[k]) for k in rest), np.int64, len(rest))
        widths = 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
        for k in rest[widths > SIDE_BY_SIDE].tolist():
            values.append(np.array(merged_alone(self.ranks, pieces[k]), np.int64))
            firsts[k], sizes[k] = held, len(values[-1])
            held += len(values[-1])
        for width in np.unique(widths[widths <= SIDE_BY_SIDE]).tolist():
            mine = rest[widths == width]
            for low in range(0, len(mine), max(1, TREE_NODES // width)):
                some = mine[low : low + max(1, TREE_NODES // width)]
                ids, counts = PairTrees(self.ranks, [pieces[k] for k in some], width).merged()
                values.append(ids)
                firsts[some], sizes[some] = held + np.cumsum(counts) - counts, counts
                held += len(ids)
        return _taken(np.concatenate(values), firsts, sizes)[0], sizes

    def matched(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches one after the other, and where each one's end; equal matches are encoded once."""
        coded = pa.array(matches, pa.string()).dictionary_encode()
        ids, sizes = self.pieces([m.encode() for m in coded.dictionary.to_pylist()])
        numbers = np.asarray(coded.indices)
        return _taken(ids, (np.cumsum(sizes) - sizes)[numbers], sizes[numbers])

    def alone(self, text: str) -> np.ndarray:
        """Ids of a text, a bounded number of matches at a time."""
        matches, parts = self.pattern.finditer(text), [np.zeros(0, np.int64)]
        while some := [m[0] for m in islice(matches, MATCHES)]:
            parts.append(self.matched(some)[0])
        return np.concatenate(parts)

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and how many each has.

        Chunks that start with a space and end in something else are matched in
        one string: no match goes over their borders.
        """
        safe = np.fromiter((c[:1] == " " and not c[-1:].isspace() for c in chunks), bool, len(chunks))
        long = np.fromiter((len(c) > BATCH_BYTES // 4 for c in chunks), bool, len(chunks))
        together = [chunks[k] for k in np.flatnonzero(safe)]
        matches = self.pattern.findall("".join(together))
        match_ends = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        last = np.searchsorted(match_ends, np.cumsum(np.fromiter(map(len, together), np.int64, len(together))))
        others = [self.pattern.findall(chunks[k]) for k in np.flatnonzero(~safe & ~long)]
        last = np.concatenate([last, len(matches) - 1 + np.cumsum([len(m) for m in others], dtype=np.int64)])
        ids, ends = self.matched(list(chain(matches, *others)))
        ends = np.concatenate([[0], ends])[last + 1]
        order = np.concatenate([np.flatnonzero(safe), np.flatnonzero(~safe & ~long)])
        sizes, firsts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        sizes[order] = np.diff(ends, prepend=0)
        firsts[order] = ends - sizes[order]
        rows = [self.alone(chunks[k]) for k in np.flatnonzero(~safe & long)]
        sizes[~safe & long] = [len(row) for row in rows]
        firsts[~safe & long] = len(ids) + np.cumsum([len(row) for row in rows], dtype=np.int64) - sizes[~safe & long]
        return _taken(np.concatenate([ids, *rows]), firsts, sizes)[0], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end.

        No match goes from a character on to a space behind it, so texts are cut
        before such spaces and each distinct chunk is encoded once. Texts with a
        space behind other white space, where the pattern looks ahead, are taken whole.
        """
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, _IRREGULAR))
        plain = texts.filter(pa.array(~odd))
        cut = pc.split_pattern(pc.binary_join_element_wise(_FIRST, plain, ""), " ")
        coded = cut.flatten().dictionary_encode()
        chunks = [c[1:] if c[:1] == _FIRST else f" {c}" for c in coded.dictionary.to_pylist()]
        ids, sizes = self.chunks(chunks + texts.filter(pa.array(odd)).to_pylist())
        numbers, parts = np.asarray(coded.indices), np.ones(len(texts), np.int64)
        parts[~odd] = np.diff(np.asarray(cut.offsets)) if len(plain) else 0
        every = np.empty(parts.sum(), np.int64)
        strange = np.repeat(odd, parts)
        every[~strange], every[strange] = numbers, len(chunks) + np.arange(odd.sum())
        ids, ends = _taken(ids, (np.cumsum(sizes) - sizes)[every], sizes[every])
        return ids, np.concatenate([[0], ends])[np.cumsum(parts)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each id's bytes end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or self.sizes[ids].min() < 0):
            raise ValueError("an id stands for no token")
        return _taken(self.bytes, self.firsts[ids], self.sizes[ids])


def _taken(values: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(firsts - (ends - sizes), sizes) + np.arange(total)], ends


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The worker's vocabulary of a file."""
    return Vocabulary(path, pattern)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` together, or one row."""
    blocks = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(sizes)]
    return ((low, high) for low, high in zip(cuts, cuts[1:], strict=False) if low < high)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the ids of the whole text of each row of ``docs`` (doc_id, text), by the ranks in the file ``path``."""
    ship(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, pattern)
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
            for low, high in slices(sizes, BATCH_BYTES):
                ids, ends = known.encode(batch.column(1).slice(low, high - low))
                places = pa.array(np.concatenate([[0], ends]), pa.int32())
                listed = pa.ListArray.from_arrays(places, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), listed], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes that the ids of ``encoded`` (doc_id, ids) stand for; an id without a token is an error."""
    ship(encoded.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, "")
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0)).astype(np.int64)
            for low, high in slices(sizes, BATCH_IDS):
                part = batch.slice(low, high - low)
                flat = np.asarray(pc.fill_null(part.column(1).flatten(), -1))
                data, ends = known.decode(flat)
                places = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes[low:high])])].astype(np.int32)
                missing = np.packbits(np.asarray(part.column(1).is_valid()), bitorder="little")
                buffers = [pa.py_buffer(missing), pa.py_buffer(places), pa.py_buffer(data)]
                decoded = pa.Array.from_buffers(pa.binary(), high - low, buffers)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], ["doc_id", "ids", "decoded"])

    rows = encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
