"""Likelihood of whole texts under a hidden Markov language model.

Tokens are words and one end. The ``SYMBOLS`` most frequent words and the end
are symbols of their own; every other word stands for the class of its last two
characters, and has the share ``(c + 1) / (N + V + 1)`` in it, with the class's
``N`` tokens and ``V`` words in training and one place for unseen words. So the
probabilities of all texts of a length add up to one.

Counts of words are exact over all training texts, and Baum-Welch runs over all
of them from its first round to its last. It is the incremental kind (Neal and
Hinton): texts fall into ``PARTS`` parts by a hash, each part's expected counts
replace those it gave in the round before, and the model follows the sum over
all parts. So a round reads each text once and improves the model ``PARTS``
times. A text's likelihood comes from the scaled forward recursion over the
whole of it.

Only frequent words, a bounded number, are shipped to tasks. A text's other
words meet their counts in a join, one row per word and text; since each of
them is rare, no key is hot.

Null and empty texts are the end alone. Texts without an id are learned from
and not held out. Rows that repeat an id are texts of their own. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.llm.chains import Chains
from remitra.llm.common import ship, staged, summed, words_of
from remitra.session import shared_dir

FREQUENT = 200_000
SYMBOLS, CLASSES, STATES = 16_384, 1_024, 8
PARTS, ROUNDS = 6, 2
SMOOTHING, STAY = 500.0, 0.8
#: Tokens that a task holds to sort texts by length, and that one recursion runs over.
HELD, TOGETHER = 8_000_000, 400_000


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all of ``texts`` (text)."""
    def run(batches):
        for batch in batches:
            words, numbers, _ = words_of(batch.column(0))
            count = np.bincount(numbers, minlength=len(words))
            real = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in real], pa.string()), pa.array(count[real], pa.int64())], names=["word", "c"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[pa.Table, float]:
    """Words with at least some count, as many as fit ``most``, and that count; found by a histogram of counts."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    bars = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("low")).orderBy(F.desc("step")).collect()
    total, least = 0, math.inf
    for bar in bars:
        total += bar.n
        if total > most:
            break
        least = bar.low
    table = counts.filter(F.col("c") >= (least if least < math.inf else 2**62)).toArrow()
    return table.sort_by([("c", "descending"), ("word", "ascending")]), least


def class_of(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % CLASSES


def _class_column(word: Column) -> Column:
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % CLASSES).cast("int")


class Vocabulary:
    """What tasks know of words: the frequent ones with their counts, and the totals of classes."""

    def __init__(self, words: list[str], counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, ends: int):
        self.token, self.words, self.counts, self.ends = uuid.uuid4().hex, words, counts, ends
        self.symbols = min(SYMBOLS, len(words))
        self.class_tokens, self.class_whole = class_tokens, class_tokens + class_words + 1.0
        self.n = self.symbols + CLASSES + 1

    def share(self) -> np.ndarray:
        """The share of each symbol in training, smoothed."""
        count = np.concatenate([self.counts[: self.symbols], self.class_tokens, [self.ends]]) + 1.0
        return count / count.sum()


_known: dict = {}


def _index(vocabulary: Vocabulary) -> dict[str, int]:
    if _known.get("token") != vocabulary.token:
        _known.update(token=vocabulary.token, index={w: k for k, w in enumerate(vocabulary.words)})
    return _known["index"]


ENCODED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, inside double, symbols binary, "
    "rare array<string>, rare_n array<long>"
)


def _encode(vocabulary: Vocabulary, batches):
    index = _index(vocabulary)
    v, logs = vocabulary, np.log10(vocabulary.counts + 1.0)
    end_log = math.log10(v.ends + 1)
    for batch in batches:
        words, numbers, ends = words_of(batch.column(3))
        rank = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
        kinds = np.fromiter((class_of(w) for w in words), np.int64, len(words))
        own = (rank >= 0) & (rank < v.symbols)
        symbol = np.where(own, rank, v.symbols + kinds).astype(np.uint16)
        known_log = np.where(rank >= 0, logs[rank] if len(logs) else 0.0, 0.0)
        inside = np.where(own, 0.0, known_log - np.log10(v.class_whole[kinds]))
        per = np.diff(ends, prepend=0)
        by_text = lambda values: np.diff(np.concatenate([[0.0], np.cumsum(values[numbers])])[ends], prepend=0.0)
        text = np.repeat(np.arange(len(ends)), per)
        late = rank[numbers] < 0
        keys, n = np.unique(text[late] * (len(words) + 1) + numbers[late], return_counts=True)
        cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys // (len(words) + 1), minlength=len(ends)))]), pa.int32())
        rare = pa.array(words, pa.string()).take(pa.array(keys % (len(words) + 1)))
        coded, start, symbols = symbol[numbers], 0, []
        last = np.array([v.n - 1], np.uint16).tobytes()
        for end in ends.tolist():
            symbols.append(coded[start:end].tobytes() + last)
            start = end
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(2), pa.array(per + 1, pa.int64()),
                pa.array(by_text((rank >= 0).astype(float)).round().astype(np.int64) + int(v.ends > 0), pa.int64()),
                pa.array(by_text(known_log) + end_log, pa.float64()), pa.array(by_text(inside), pa.float64()), pa.array(symbols, pa.binary()),
                pa.ListArray.from_arrays(cuts, rare), pa.ListArray.from_arrays(cuts, pa.array(n, pa.int64())),
            ],
            names=[f.split()[0] for f in ENCODED.split(", ")],
        )


def _groups(batches, column: int):
    """Symbols of many texts, those of like length together: (positions, batches they are from, symbols, lengths)."""
    held: list[tuple[int, bytes]] = []
    size = 0

    def sorted_groups():
        order = sorted(range(len(held)), key=lambda k: len(held[k][1]))
        group, n = [], 0
        for k in order:
            group.append(k)
            n += len(held[k][1]) // 2
            if n >= TOGETHER:
                yield group
                group, n = [], 0
        if group:
            yield group

    def made():
        for group in sorted_groups():
            data = [held[k][1] for k in group]
            yield group, np.frombuffer(b"".join(data), np.uint16).astype(np.int64), np.array([len(d) // 2 for d in data])

    for batch in batches:
        for data in batch.column(column).to_pylist():
            held.append((len(held), data))
            size += len(data) // 2
        if size >= HELD:
            yield from made()
            held, size = [], 0
    yield from made()


def _expected(batches, model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Expected counts of first states, moves and emissions, and the log likelihood."""
    s, m = model["emit"].shape
    out = {"first": np.zeros(s), "move": np.zeros((s, s)), "emit": np.zeros((s, m)), "log": np.zeros(1)}
    table = np.ascontiguousarray(model["emit"].T)
    for _, symbols, lengths in _groups(batches, 0):
        emit, chains = table[symbols], Chains(lengths)
        alpha, scales = chains.forward(model["first"], model["move"], emit)
        back, ahead = chains.backward(model["move"], emit, scales)
        later = chains.later()
        at = np.flatnonzero(later)
        out["move"] += (alpha[at - 1].T @ ahead[at]) * model["move"]
        alpha *= back
        out["first"] += alpha[~later].sum(axis=0)
        for k in range(s):
            out["emit"][k] += np.bincount(symbols, weights=alpha[:, k], minlength=m)
        out["log"] += np.log(scales).sum()
    return out


def _updated(counts: dict[str, np.ndarray], share: np.ndarray) -> dict[str, np.ndarray]:
    emit = counts["emit"] + SMOOTHING * share
    move, first = counts["move"] + 0.1, counts["first"] + 0.1
    return {
        "first": first / first.sum(), "move": move / move.sum(axis=1, keepdims=True), "emit": emit / emit.sum(axis=1, keepdims=True),
    }


def in_parts(texts: DataFrame, parts: int = PARTS) -> list[DataFrame]:
    """Written symbols of ``texts`` (row, symbols), a table for each part that has a text."""
    path = f"{shared_dir(texts.sparkSession)}/staged/parts-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    texts.select("symbols", part.alias("part")).write.partitionBy("part").parquet(path)
    written = texts.sparkSession.read.schema("symbols binary, part int").parquet(path)
    held = sorted(r.part for r in written.select("part").distinct().collect())  # at most ``parts``
    return [written.filter(F.col("part") == k).select("symbols") for k in held]


def baum_welch(texts: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS, parts: int = PARTS) -> dict[str, np.ndarray]:
    """Model of all ``texts`` (row, symbols)."""
    random = np.random.default_rng(7)
    emit = share * random.gamma(2.0, size=(states, len(share)))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    model = {"first": np.full(states, 1 / states), "move": move, "emit": emit / emit.sum(axis=1, keepdims=True)}
    tables = in_parts(texts, parts)
    counts: dict[int, dict[str, np.ndarray]] = {}
    for _ in range(rounds):
        for k, table in enumerate(tables):
            counts[k] = summed(table, lambda batches, now=model: _expected(batches, now))
            model = _updated({name: sum(c[name] for c in counts.values()) for name in counts[k]}, share)
    return model


def _scored(model: dict[str, np.ndarray], batches):
    """row and the natural logarithm of the likelihood of its symbols."""
    table = np.ascontiguousarray(model["emit"].T)
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for group, symbols, lengths in _groups([batch], 1):
            chains = Chains(lengths)
            _, scales = chains.forward(model["first"], model["move"], table[symbols])
            yield pa.RecordBatch.from_arrays([pa.array(rows[group], pa.int64()), pa.array(chains.sums(np.log(scales)), pa.float64())], names=["row", "log"])


def _together(batches):
    """Fewer and larger batches, so that long texts meet in one recursion."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= 2 * HELD:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def score(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row of ``docs`` (doc_id, text).

    ``base_score`` is the same by single words with one added to every count.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    counts = staged(word_counts(texts.filter(~F.col("held_out"))), "words")
    ends = texts.filter(~F.col("held_out")).count()
    words, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    tokens, kinds = int(words or 0) + ends, int(distinct) + int(ends > 0)
    frequent, least = frequent_words(counts)
    names, number = frequent.column("word").to_pylist(), frequent.column("c").to_numpy().astype(np.int64)
    # the words with symbols of their own are taken out of the totals of classes here
    by_class = counts.groupBy(_class_column(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        class_tokens[r.k], class_words[r.k] = r.c, r.n
    for name, c in zip(names[:SYMBOLS], number[:SYMBOLS], strict=False):
        class_tokens[class_of(name)] -= c
        class_words[class_of(name)] -= 1
    shared = spark.sparkContext.broadcast(Vocabulary(names, number, class_tokens, class_words, ends))  # FREQUENT words
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    encoded = staged(rows.mapInArrow(lambda batches: _encode(shared.value, batches), ENCODED), "encoded")
    model = baum_welch(encoded.filter(~F.col("held_out")).select("row", "symbols"), shared.value.share(), states, rounds)
    likelihood = encoded.select("row", "symbols").mapInArrow(lambda batches: _scored(model, _together(batches)), "row long, log double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    others = counts.filter(F.col("c") < (least if least < math.inf else 2**62))
    rare = rare.join(others, "word").groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return (
        encoded.select("row", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "inside")
        .join(likelihood, "row").join(rare, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("base") + rare_log - F.col("n_tokens") * math.log10(tokens + kinds + 1)).alias("base_score"),
            (F.col("log") / math.log(10) + F.col("inside") + rare_log).alias("score"),
        )
    )


