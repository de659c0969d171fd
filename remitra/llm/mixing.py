"""Rates per document that bring a corpus to target shares of domains. DataFrame functions only.

A naive Bayes classifier over hashed words is counted from a labelled table and
gives every document a probability for each domain; the mean evidence of its
words counts as that of ``EVIDENCE`` words, so long texts aren't taken for
certain. The expected tokens of a domain are the sum of rate times tokens times
probability. Rates between 0 and ``most`` start at 1 and follow the projected
gradient of the squared relative errors of the expected tokens, in the measure
of tokens; each step is one aggregation over a written table of a few numbers
per document. As every document's probabilities sum to one, steps of 1 converge.

A word's evidence is the logarithm of its lift for the domain, shrunk so that
rare words say little.

``copies`` rounds a rate up or down by the hash of doc_id, so that its
expectation is the rate. Unless a total is given, it is what uses up the domain
with the largest target; a domain with too few tokens falls short, unless
``most`` lets documents repeat.

Texts that are null or without words have no tokens and the rate of the labels'
shares. Labels for unknown documents, or without a domain, count for nothing;
of several labels for a document the smallest holds. Without labels all domains
are equally likely. Rows that repeat an id are documents of their own. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.llm.common import if_small, staged

BUCKETS = 1 << 16
EVIDENCE, SHRINK = 40.0, 2.0
STEPS, WRITE_EVERY, CLOSE, STILL = 40, 8, 1e-4, 1e-6


def _words(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per word, hashed to a bucket; a row without words keeps one that isn't real."""
    trimmed = F.btrim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r"))
    words = rows.select(*columns, F.explode_outer(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("_word"))
    real = F.coalesce(F.col("_word") != "", F.lit(False))
    return words.select(*columns, F.pmod(F.xxhash64("_word"), F.lit(BUCKETS)).alias("bucket"), real.alias("real"))


def evidence(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """Evidence of a word's bucket for each domain, less that for the first, and the log shares of domains."""
    labels = staged(
        labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_doc")).agg(F.min("domain").alias("domain")), "labels",
    )
    known = docs.join(if_small(labels), F.col("doc_id") == F.col("_doc"))
    counts = staged(_words(known, "domain").filter("real").groupBy("bucket", "domain").agg(F.count("*").alias("n")), "counts")
    totals = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    seen = {r["domain"]: r["n"] for r in labels.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n, tokens = sum(seen.values()) + len(domains), max(sum(totals.values()), 1)
    per = [F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"c{k}") for k, d in enumerate(domains)]
    rows = counts.groupBy("bucket").agg(F.sum("n").alias("c"), *per)
    lift = lambda k: F.log((F.col(f"c{k}") + SHRINK) / (F.col("c") * (totals.get(domains[k], 0) / tokens) + SHRINK))
    scores = rows.select(F.col("bucket").alias("_bucket"), *[(lift(k) - lift(0)).alias(f"s{k}") for k in range(1, len(domains))])
    return scores, [math.log((seen.get(d, 0) + 1) / n) for d in domains]


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """row, doc_id, n_tokens and p0, p1, ... for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scores, prior = evidence(rows, labelled, domains)
    # at most BUCKETS rows of a few numbers, whatever the corpus
    scores = F.broadcast(staged(scores, "evidence"))
    words = _words(rows.withColumn("row", F.monotonically_increasing_id()), "row", "doc_id").join(scores, F.col("bucket") == F.col("_bucket"), "left")
    sums = [F.sum(F.when(F.col("real"), F.col(f"s{k}"))).alias(f"s{k}") for k in range(1, len(domains))]
    totals = words.groupBy("row", "doc_id").agg(F.sum(F.col("real").cast("long")).alias("n_tokens"), *sums)
    size = F.greatest("n_tokens", F.lit(1))
    logits = [F.lit(prior[0])] + [prior[k] + EVIDENCE * F.coalesce(f"s{k}", F.lit(0.0)) / size for k in range(1, len(domains))]
    logits = totals.select("row", "doc_id", "n_tokens", *[x.alias(f"l{k}") for k, x in enumerate(logits)])
    top = F.greatest(*[f"l{k}" for k in range(len(domains))]) if len(domains) > 1 else F.col("l0")
    raised = logits.select("row", "doc_id", "n_tokens", *[F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in range(len(domains))])
    whole = sum((F.col(f"e{k}") for k in range(1, len(domains))), F.col("e0"))
    return raised.select("row", "doc_id", "n_tokens", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(len(domains))])


def fitted(rows: DataFrame, targets: list[float], total: float | None = None, most: float = 1.0, steps: int = STEPS) -> tuple[DataFrame, list[float], list[float]]:
    """``rows`` (n_tokens, p0, p1, ...) with ``rate``; the goals in tokens, and what the rates give."""
    ks = range(len(targets))

    def expected(df: DataFrame, rate: Column) -> list[float]:
        got = df.agg(*[F.sum(F.col("n_tokens") * F.col(f"p{k}") * rate).alias(f"t{k}") for k in ks]).first()
        return [float(x or 0.0) for x in got]

    rows = staged(rows.withColumn("rate", F.lit(min(1.0, most)).cast("double")), "rates")
    whole = expected(rows, F.lit(1.0))
    share = [t / sum(targets) for t in targets]
    if total is None:
        main = max(ks, key=lambda k: share[k])
        total = whole[main] / share[main]
    goals = [total * s for s in share]
    rate, got = F.col("rate"), expected(rows, F.col("rate"))
    for step in range(1, steps + 1):
        if max(abs(g - t) for g, t in zip(got, goals, strict=True)) <= CLOSE * max(total, 1.0):
            break
        pull = sum((F.col(f"p{k}") * F.lit((got[k] - goals[k]) / whole[k] if whole[k] else 0.0) for k in ks), F.lit(0.0))
        rate = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), rate - pull))
        if step % WRITE_EVERY == 0:
            rows = staged(rows.withColumn("rate", rate), "rates")
            rate = F.col("rate")
        last, got = got, expected(rows, rate)
        if max(abs(g - o) for g, o in zip(got, last, strict=True)) <= STILL * max(total, 1.0):
            break
    return rows.withColumn("rate", rate), goals, got


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, most: float = 1.0, steps: int = STEPS,
) -> DataFrame:
    """doc_id, n_tokens, the probability of each domain, rate and copies for every row of ``docs``.

    ``labelled`` has doc_id and domain; ``targets`` maps each domain to its share of tokens.
    """
    domains = sorted(targets)
    rows = staged(posteriors(docs, labelled, domains), "posteriors")
    rows, _, _ = fitted(rows, [float(targets[d]) for d in domains], total, most, steps)
    luck = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 32)) / float(1 << 32)
    copies = F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rows.select(
        "doc_id", "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)], "rate", copies.cast("int").alias("copies")
    )
