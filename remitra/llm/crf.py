"""Language of text, word by word, by a linear-chain conditional random field.

A line is a chain of words. A word's features are its prefixes and suffixes of
up to three characters, its inner trigrams, itself, and the languages whose
lexicon holds it; transitions between languages are learned with them. The
lexicon and the weights come from at most ``TRAIN_DOCS`` documents per language,
those with the smallest hash of doc_id; every word of a document is taken to be
in its language. Transitions get a share of switches from the start, since
labels by document show none.

A document's language is that with the largest sum of its words' marginal
probabilities, which forward-backward gives; the score is its mean. Ties go to
the first name. Null texts and texts without a letter are ``und`` with score 0,
as is everything when there is no labelled document.

Repeated rows are labelled alike; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitra.llm.chains import Chains
from remitra.llm.common import ship, staged, summed
from remitra.llm.training import adam
from remitra.operators.scale import top_k_per_group

FEATURES = 1 << 16
TRAIN_DOCS, LEXICON = 400, 2_000
STEPS, RATE, PENALTY = 25, 0.2, 1.0
#: Chains are cut at so many words for fitting only.
TRAIN_CHAIN = 100
#: Switches per word assumed beside those that the labels show.
SWITCHES = 0.02
REMEMBERED = 500_000
_MARKS = string.punctuation + string.digits + "¡¿«»„“”‘’…–—"


def plain(word: str) -> str:
    return word.strip(_MARKS).lower()


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of a plain word; none without a letter."""
    import xxhash

    if not any(map(str.isalpha, word)):
        return []
    framed = f"<{word}>"
    names = {f"p{word[:k]}" for k in (1, 2, 3)} | {f"s{word[-k:]}" for k in (1, 2, 3)} | {f"w{word}"}
    names |= {f"g{framed[k : k + 3]}" for k in range(len(framed) - 2)}
    if word in lexicon:
        names.add(f"l{lexicon[word]}")
    return sorted({xxhash.xxh3_64_intdigest(name) % FEATURES for name in names})


def lines_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, each word's number, the length of each line in words, and each text's number of lines."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    cut = pc.ascii_split_whitespace(lines.flatten())
    coded = cut.flatten().dictionary_encode()
    sizes = np.diff(cut.offsets.to_numpy()).astype(np.int64)
    numbers, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    if "" in words:
        real = numbers != words.index("")
        ends = np.concatenate([[0], np.cumsum(real)])[np.cumsum(sizes)] if len(sizes) else sizes
        sizes, numbers = np.diff(ends, prepend=0), numbers[real]
    return words, numbers, sizes, np.diff(lines.offsets.to_numpy())


def _prepared(batches: Iterator[pa.RecordBatch], lexicon: dict[str, int], names: dict[str, int]):
    """Training rows: features of distinct words, words of chains, and their label."""
    for batch in batches:
        words, numbers, sizes, per_text = lines_of(batch.column(1))
        found = [word_features(plain(w), lexicon) for w in words]
        labels = np.repeat([names[x] for x in batch.column(0).to_pylist()], per_text)
        parts = np.maximum(1, -(-sizes // TRAIN_CHAIN))
        labels, wide = np.repeat(labels, parts), np.repeat(sizes, parts)
        nth = np.arange(len(wide)) - np.repeat(np.cumsum(parts) - parts, parts)
        cut = np.clip(wide - nth * TRAIN_CHAIN, 0, TRAIN_CHAIN)
        row = {
            "features": np.array([f for fs in found for f in fs], np.int32), "ends": np.cumsum([len(f) for f in found]).astype(np.int64),
            "words": numbers.astype(np.int32), "lengths": cut, "labels": labels[: len(cut)].astype(np.int32),
        }
        yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in row.items()})


_TRAIN = {"features": np.int32, "ends": np.int64, "words": np.int32, "lengths": np.int64, "labels": np.int32}


def _scores(weights: np.ndarray, features: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[features], axis=0)])[ends]
    return np.diff(total, axis=0, prepend=np.zeros((1, weights.shape[1])))


def _gradient(batches: Iterator[pa.RecordBatch], model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Expected less observed counts."""
    n = len(model["first"])
    out = {"weights": np.zeros((FEATURES, n)), "moves": np.zeros((n, n)), "first": np.zeros(n)}
    move, first = np.exp(model["moves"]), np.exp(model["first"])
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: np.frombuffer(batch.column(c)[k].as_py(), kind) for c, (name, kind) in enumerate(_TRAIN.items())}
            lengths = row["lengths"][row["lengths"] > 0]
            labels = np.repeat(row["labels"], row["lengths"])
            score = _scores(model["weights"], row["features"], row["ends"])[row["words"]]
            emit = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-12
            chains = Chains(lengths)
            alpha, scales = chains.forward(first, move, emit)
            back, ahead = chains.backward(move, emit, scales)
            share = alpha * back
            share /= share.sum(axis=1, keepdims=True)
            later = np.flatnonzero(chains.later())
            out["moves"] += (alpha[later - 1].T @ ahead[later]) * move - np.diag(np.bincount(labels[later], minlength=n))
            begin = np.flatnonzero(~chains.later())
            out["first"] += share[begin].sum(axis=0) - np.bincount(labels[begin], minlength=n)
            share[np.arange(len(labels)), labels] -= 1
            sizes = np.diff(row["ends"], prepend=0)
            for j in range(n):
                of_word = np.bincount(row["words"], weights=share[:, j], minlength=len(sizes))
                out["weights"][:, j] += np.bincount(row["features"], weights=np.repeat(of_word, sizes), minlength=FEATURES)
    return out


def fit(labelled: DataFrame, per_language: int = TRAIN_DOCS, steps: int = STEPS) -> dict | None:
    """Model of a bounded sample of ``labelled`` (doc_id, text, lang); None without any."""
    ship(labelled.sparkSession)
    known = labelled.filter("lang is not null and text is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    chosen = top_k_per_group(known.select("doc_id", "lang").withColumn("_h", F.xxhash64("doc_id")), ["lang"], [F.col("_h"), F.col("doc_id")], per_language, spread_by="doc_id")
    chosen = F.broadcast(staged(chosen.select(F.col("doc_id").alias("_doc"), F.col("lang").alias("_lang")).distinct(), "chosen"))  # per_language rows each
    sample = staged(known.join(chosen, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("lang") == F.col("_lang"))).select("lang", "text"), "sample")
    names = [r.lang for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not names:
        return None
    number = {name: k for k, name in enumerate(names)}
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w != ''").groupBy("w", "lang").agg(F.count("*").alias("n"))
    most = words.groupBy("w").agg(F.max(F.struct("n", "lang")).alias("m"), F.sum("n").alias("t")).filter("m.n >= 3 and m.n >= 0.8 * t")
    listed = top_k_per_group(most.select("w", F.col("m.lang").alias("lang"), F.col("m.n").alias("n")), ["lang"], [F.desc("n"), F.col("w")], LEXICON, spread_by="w")
    lexicon = {r.w: number[r.lang] for r in listed.select("w", "lang").collect()}  # LEXICON words a language
    schema = ", ".join(f"{k} binary" for k in _TRAIN)
    rows = staged(sample.repartition(8).mapInArrow(lambda batches: _prepared(batches, lexicon, number), schema), "chains")
    n = len(names)

    def gradient(model):
        found = summed(rows, lambda batches: _gradient(batches, model))
        return {k: found[k] + PENALTY * (model[k] - start[k]) for k in start}

    stay = np.full((n, n), np.log(SWITCHES / max(1, n - 1)))
    np.fill_diagonal(stay, np.log(1 - SWITCHES))
    start = {"weights": np.zeros((FEATURES, n)), "moves": stay, "first": np.zeros(n)}
    model = adam(start, gradient, steps, RATE)
    # documents with one label each show no switches: a share of staying is kept for them
    model["moves"] = np.logaddexp(model["moves"], np.diag(model["moves"])[:, None] + np.where(np.eye(n) > 0, -np.inf, stay))
    return {"token": uuid.uuid4().hex, "names": names, "lexicon": lexicon, "weights": model["weights"].astype(np.float32), "moves": model["moves"], "first": model["first"]}


class Labeller:
    def __init__(self, model: dict):
        self.model = model
        self.move, self.first = np.exp(model["moves"]), np.exp(model["first"])
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Row of each word in ``table``: its emission and whether it has a letter."""
        if len(self.known) > REMEMBERED:
            self.known, self.rows = {}, []
        forms = [plain(w) for w in words]
        new = list({w for w in forms if w not in self.known})
        if new:
            found = [word_features(w, self.model["lexicon"]) for w in new]
            flat = np.array([f for fs in found for f in fs], np.int64)
            score = _scores(self.model["weights"].astype(np.float64), flat, np.cumsum([len(f) for f in found]))
            emit = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-12
            letters = np.array([bool(f) for f in found], float)
            size = len(self.known)
            self.known.update(zip(new, range(size, size + len(new)), strict=True))
            self.rows.append(np.column_stack([emit, letters]))
            self.rows = [np.concatenate(self.rows)]
        return np.fromiter(map(self.known.__getitem__, forms), np.int64, len(forms))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal probabilities of all words, whether they have a letter, and each text's number of words."""
        words, numbers, sizes, per_text = lines_of(texts)
        n = len(self.first)
        text = np.repeat(np.arange(len(per_text)), per_text)
        per = np.bincount(text, weights=sizes, minlength=len(per_text)).astype(np.int64)
        if not len(numbers):
            return np.zeros((0, n)), np.zeros(0, bool), per
        at = self._numbers(words)[numbers]
        table = self.rows[0]
        emit, letters = table[at, :n], table[at, n] > 0
        chains = Chains(sizes)
        alpha, scales = chains.forward(self.first, self.move, emit)
        share = alpha * chains.backward(self.move, emit, scales)[0]
        return share / share.sum(axis=1, keepdims=True), letters, per


_kept: list[Labeller] = []


def _labeller(model: dict) -> Labeller:
    """The worker's labeller of the model in use."""
    if not _kept or _kept[0].model["token"] != model["token"]:
        _kept[:] = [Labeller(model)]
    return _kept[0]


def label(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred and score for every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return texts.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows and the lexicon

    def run(batches):
        labeller = _labeller(shared.value)
        names = [*shared.value["names"], "und"]
        for batch in batches:
            share, letters, per = labeller.words(batch.column(1))
            text = np.repeat(np.arange(len(per)), per)[letters]
            sums = np.stack([np.bincount(text, weights=share[letters, j], minlength=len(per)) for j in range(len(names) - 1)], axis=1)
            count = np.bincount(text, minlength=len(per))
            best = np.where(count > 0, sums.argmax(axis=1), len(names) - 1)
            score = np.where(count > 0, sums.max(axis=1) / np.maximum(count, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([names[k] for k in best], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")
