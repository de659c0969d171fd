"""Severity of toxic language by cumulative-link ordinal regression.

A document's features are its distinct words, hashed; words are stripped of
marks around them and lower-cased. A feature's value is the logarithm of its
lift, how much more often graded documents hold it than others, shrunk so that
rare words count little. One weight vector serves all grades:
``P(grade > k) = sigmoid(w x - t_k)`` with ascending thresholds, kept in order
by fitting the logarithms of their distances. The gradient of the likelihood
is summed over the partitions of the labelled rows, of which at most
``TRAIN_ROWS`` are used, those with the smallest hash of doc_id. The expected
severity is the sum of ``P(grade > k)``.

Null and empty texts have no features. Labels for unknown documents, or without
a grade, are left out; of several labels for a document the highest holds.
Without labels no document is flagged. Repeated rows are scored alike; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitra.llm.common import ship, staged, summed
from remitra.llm.training import adam

FEATURES = 1 << 17
TRAIN_ROWS = 20_000
STEPS, RATE, PENALTY, SHRINK = 40, 0.3, 0.3, 2.0
#: A hashed word is strong if it is this many times as frequent in toxic documents, and in at least so many of them.
STRONG_RATIO, STRONG_DOCS = 20.0, 5
#: Strong words from which a toxic document has the upper grade.
MANY_STRONG = 4
#: Probability of a grade above 0 from which a document is flagged.
FLAG = 0.25
_MARKS = string.punctuation + "¡¿«»„“”‘’…–—"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of all texts one after the other, and where each text's end."""
    import xxhash

    texts = pc.fill_null(texts, "")
    cut = pc.ascii_split_whitespace(texts)
    coded = cut.flatten().dictionary_encode()
    words = [w.strip(_MARKS).lower() for w in coded.dictionary.to_pylist()]
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) % FEATURES if w else -1 for w in words), np.int64, len(words))
    offsets = cut.offsets.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    at = hashed[coded.indices.to_numpy()]
    keys = np.unique(text[at >= 0] * FEATURES + at[at >= 0])
    return keys % FEATURES, np.cumsum(np.bincount(keys // FEATURES, minlength=len(texts)))


def _vectors(batches):
    for batch in batches:
        found, ends = features(batch.column(2))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "grade", "features"])


def labelled_vectors(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, grade and features of a bounded sample of the labelled documents, written."""
    chosen = (
        labels.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("_grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_doc")
    )
    chosen = F.broadcast(staged(chosen, "chosen"))  # at most ``rows`` rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.join(chosen, F.col("doc_id") == F.col("_doc")).select("doc_id", F.col("_grade").alias("grade"), "text")
    return staged(known.mapInArrow(_vectors, "doc_id long, grade int, features array<int>"), "vectors")


def severity_grades(vectors: DataFrame, many: int = MANY_STRONG) -> DataFrame:
    """Toxic documents of ``vectors`` (grade 0 or 1) that hold many words typical of such get grade 2."""
    toxic, everyone = [float(x or 0) for x in vectors.agg(F.sum("grade"), F.count("*")).first()]
    counts = vectors.select("grade", F.explode("features").alias("f")).groupBy("f").agg(F.sum("grade").alias("hit"), F.count("*").alias("n"))
    share = F.col("hit") / max(toxic, 1.0) / ((F.col("n") - F.col("hit") + 0.5) / max(everyone - toxic, 1.0))
    strong = counts.filter((F.col("hit") >= STRONG_DOCS) & (share >= STRONG_RATIO)).select("f").collect()  # of FEATURES at most
    known = F.array(*[F.lit(r.f) for r in strong]).cast("array<int>")
    grade = F.when((F.col("grade") > 0) & (F.size(F.array_intersect("features", known)) >= many), 2).otherwise(F.col("grade"))
    return staged(vectors.withColumn("grade", grade.cast("int")), "graded")


def _rows(batch: pa.RecordBatch):
    lists = batch.column(2)
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(), ends[1:] - ends[0]


def _sums(weights: np.ndarray, found: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[found])])[ends]
    return np.diff(total, prepend=0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def thresholds(model: dict[str, np.ndarray]) -> np.ndarray:
    return model["first"] + np.concatenate([[0.0], np.cumsum(np.exp(model["gaps"]))])


def _lifts(vectors: DataFrame) -> np.ndarray:
    """The value of each feature."""
    def partial(batches):
        out = {"hit": np.zeros(FEATURES), "n": np.zeros(FEATURES), "graded": np.zeros(2)}
        for batch in batches:
            found, ends = _rows(batch)
            graded = batch.column(1).to_numpy() > 0
            out["hit"] += np.bincount(found, weights=np.repeat(graded, np.diff(ends, prepend=0)), minlength=FEATURES)
            out["n"] += np.bincount(found, minlength=FEATURES)
            out["graded"] += [graded.sum(), len(graded)]
        return out

    got = summed(vectors, partial)
    share = got["graded"][0] / max(got["graded"][1], 1)
    return np.log((got["hit"] + SHRINK) / (got["n"] * share + SHRINK))


def fit(vectors: DataFrame, grades: int, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> dict[str, np.ndarray]:
    """weights, first threshold and logarithms of the gaps for grades 0 to ``grades`` - 1."""

    def gradient(model):
        cuts, by_feature = thresholds(model), model["weights"] * values

        def partial(batches):
            g = {"weights": np.zeros(FEATURES), "first": np.zeros(1), "gaps": np.zeros(grades - 2)}
            for batch in batches:
                found, ends = _rows(batch)
                y = np.clip(batch.column(1).to_numpy(), 0, grades - 1)
                score = _sums(by_feature, found, ends)
                above = np.concatenate([np.ones((len(y), 1)), _sigmoid(score[:, None] - cuts), np.zeros((len(y), 1))], axis=1)
                upper, lower = above[np.arange(len(y)), y], above[np.arange(len(y)), y + 1]
                p = np.maximum(upper - lower, 1e-12)
                d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
                pull = -(d_upper - d_lower)  # derivative of -log p by the score
                g["weights"] += np.bincount(found, weights=np.repeat(pull, np.diff(ends, prepend=0)), minlength=FEATURES)
                by_cut = np.zeros(grades + 1)
                np.add.at(by_cut, y, d_upper)
                np.add.at(by_cut, y + 1, -d_lower)
                by_cut = by_cut[1:grades]
                g["first"] += by_cut.sum()
                g["gaps"] += np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(model["gaps"])
            return g

        g = summed(vectors, partial)
        g["weights"] = g["weights"] * values + penalty * model["weights"]
        return g

    start = {"weights": np.zeros(FEATURES), "first": np.array([2.0]), "gaps": np.zeros(grades - 2)}
    if vectors.isEmpty():
        return start | {"first": np.array([35.0])}
    values = _lifts(vectors)
    model = adam(start, gradient, steps, rate, whole=True)
    return model | {"weights": model["weights"] * values}


def predict(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest) and toxic (a grade above 0 has at least the probability ``FLAG``)."""
    cuts = thresholds(model)
    shared = docs.sparkSession.sparkContext.broadcast(model["weights"].astype(np.float32))  # FEATURES numbers

    def run(batches):
        for batch in batches:
            found, ends = features(batch.column(1))
            above = _sigmoid(_sums(shared.value.astype(np.float64), found, ends)[:, None] - cuts)
            each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1), pa.float64()), pa.array(each.argmax(axis=1), pa.int32()), pa.array(above[:, 0] > FLAG)],
                names=["doc_id", "severity", "grade", "toxic"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def severity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Grade ``labels`` (doc_id, grade 0 or 1) by severity, fit on them, and score all of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    vectors = severity_grades(labelled_vectors(docs, labels, rows))
    return predict(docs, fit(vectors, 3))


