"""How far the sources of a language differ in their words.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A
language keeps the terms found in at least ``least`` of its documents. A group
(language and source, or a whole language) gives each kept term the smoothed
share p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), where N is its count over
all V kept terms. Two groups differ by the sum of |p - q| over all kept terms;
the terms that set a source apart are those with p above the language's q.
All sums are over integers, so they are exact and in no order.

Texts are cut once. Each task adds up its rows by term and writes them with a
64-bit digest; from there on counts, document frequencies, shares, sums and ranks
are shuffled by digest alone. For digests that can be kept, the least and the
greatest string tell whether several terms share one: those are split, counted
again by string, and told apart by a small number. Strings are joined back to the
rows of the result only, ties at the last rank included.

Shares are compared in blocks of terms by all sources of a language, a matrix of
bounded size each; a source without a term of the block has the share of count 0.

Null text, language and source count as empty. Rows are documents of their own,
repeated ones too. A group without terms has equal shares, and the difference is 0
where nothing is kept. Ties rank by the item's UTF-8 bytes. Other columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from remitra.llm.common import if_small, ship, staged, words_of

#: Share of a whole, and what is added to every count.
SCALE, ADDED = 1_000_000_000, 5
#: Rows a task holds before it adds up equal ones and, if most remain, hands them on.
HELD_ROWS = 400_000
#: Characters of text that are cut at once.
CUT_CHARS = 4_000_000
#: Cells of a block's matrix of sources and terms.
CELLS = 1 << 19

_KEYS = ["lang", "source", "digest", "term"]
_OCCURRENCES = "lang string, source string, digest long, term string, n long, docs long"

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[:128] = 32
_BYTES[97:123] = np.arange(97, 123)
_BYTES[65:91] = np.arange(97, 123)


def terms_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct terms, each term's number among them, and where each text's terms end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(_BYTES[raw]))
    return words_of(plain, lower=False)


def digests(terms: list[str], bits: int) -> np.ndarray:
    import xxhash

    found = np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))
    return (found >> np.uint64(64 - bits)).view(np.int64)


def _counted(langs: pa.Array, sources: pa.Array, texts: pa.Array, bits: int) -> pa.Table:
    """Occurrences and documents by language, source and term."""
    terms, numbers, ends = terms_of(texts)
    both = [pc.fill_null(c, "").dictionary_encode() for c in (langs, sources)]
    lang, source = (np.asarray(c.indices).astype(np.int64) for c in both)
    width = max(len(terms), 1)
    in_doc, n = np.unique(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) * width + numbers, return_counts=True)
    doc, term = in_doc // width, in_doc % width
    several = max(len(both[1].dictionary), 1)
    found, group = np.unique((lang * several + source)[doc] * width + term, return_inverse=True)
    held, term = found // width, found % width
    return pa.table({
        "lang": both[0].dictionary.take(pa.array(held // several)),
        "source": both[1].dictionary.take(pa.array(held % several)),
        "digest": pa.array(digests(terms, bits)).take(pa.array(term)),
        "term": pa.array(terms, pa.string()).take(pa.array(term)),
        "n": pa.array(np.bincount(group, n, len(found)).astype(np.int64)),
        "docs": pa.array(np.bincount(group, minlength=len(found))),
    })


def _added(tables: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(tables)
    table = table.group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return table.rename_columns([*_KEYS, "n", "docs"])


def occurrences(docs: DataFrame, bits: int = 64) -> DataFrame:
    """lang, source, digest, term, occurrences and documents, added up within a task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            langs, sources, texts = batch.columns
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // CUT_CHARS)) + 1).tolist(), len(texts)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                held.append(_counted(*(c.slice(low, high - low) for c in (langs, sources, texts)), bits))
                if sum(map(len, held)) > HELD_ROWS:
                    held = [_added(held)]
                    if len(held[0]) > HELD_ROWS // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from _added(held).to_batches()

    rows = docs.selectExpr("cast(lang as string) lang", "cast(source as string) source", "cast(text as string) text")
    return rows.mapInArrow(run, _OCCURRENCES)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), in decimals, since the product may exceed 64 bits."""
    wide = (count + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + kept * ADDED).cast("decimal(20,0)")).cast("long") + 1


def kept_terms(found: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Kept counts (lang, source, digest, split, n) without strings, and the terms (lang, digest, split, term)."""
    key = ["lang", "digest"]
    counts = staged(found.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    frequent = counts.groupBy(key).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select(key)
    frequent = if_small(staged(frequent, "frequent"))
    ends = found.join(frequent, key, "left_semi").groupBy(key).agg(F.min("term").alias("low"), F.max("term").alias("high"))
    ends = staged(ends, "ends")
    single = ends.filter("low = high").select(*key, F.lit(0).alias("split"), F.col("low").alias("term"))
    mixed = if_small(staged(ends.filter("low <> high").select(key), "mixed"))
    apart = staged(
        found.join(mixed, key, "left_semi").groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "apart",
    )
    strings = apart.groupBy(*key, "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    strings = strings.select(*key, F.row_number().over(W.partitionBy(key).orderBy("term")).alias("split"), "term")
    terms = staged(single.unionByName(strings), "terms")
    plain = counts.join(if_small(terms.filter("split = 0").select(key)), key, "left_semi")
    split = apart.join(terms.filter("split > 0"), [*key, "term"])
    columns = ["lang", "source", "digest", "split", "n"]
    return staged(plain.withColumn("split", F.lit(0)).select(columns).unionByName(split.select(columns)), "kept"), terms


def _differences(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over a block's terms for every two sources of a language."""
    right = right.sort_values("source", ignore_index=True)
    sources = right["source"].to_numpy()
    if len(left):
        term = pd.factorize(pd.MultiIndex.from_frame(left[["digest", "split"]]))[0]
        row = pd.Index(sources).get_indexer(left["source"])
        shares = np.repeat(right["zero"].to_numpy(np.int64)[:, None], term.max() + 1, axis=1)
        shares[row, term] = left["p"].to_numpy(np.int64)
    else:
        shares = np.zeros((len(sources), 1), np.int64)
    parts = []
    for k in range(len(sources)):
        value = np.abs(shares - shares[k]).sum(axis=1)
        others = np.arange(len(sources)) != k
        parts.append(pd.DataFrame({"source": sources[k], "item": sources[others], "value": value[others]}))
    out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"source": [], "item": [], "value": []})
    out.insert(0, "lang", right["lang"].iloc[0] if len(right) else "")
    return out


def audit(docs: DataFrame, least: int = 30, top: int = 50, bits: int = 64) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank of ``docs`` (text, lang, source).

    ``bits`` is the width of digests; few of them make terms collide, as the tests do.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    all_groups = docs.select(lang, source).distinct()
    found = staged(occurrences(docs, bits), "occurrences")
    kept, terms = kept_terms(found, least)
    sizes = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = all_groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "kept"])
    zero = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(0)
    groups = staged(groups.withColumn("zero", zero), "groups")
    langs = groups.groupBy("lang", "kept").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    langs = staged(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("sources") / CELLS)).cast("int")), "langs")

    shares = kept.join(if_small(groups), ["lang", "source"]).join(if_small(langs.select("lang", "lang_total", "blocks")), "lang")
    shares = staged(shares.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))), "shares")

    block = F.pmod(F.hash("digest", "split"), F.col("blocks")).alias("block")
    cells = shares.select("lang", "source", "digest", "split", "p", block)
    every = groups.join(if_small(langs.select("lang", "blocks")), "lang")
    every = every.select("lang", "source", "zero", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sums = cells.groupBy("lang", "block").cogroup(every.groupBy("lang", "block")).applyInPandas(
        lambda left, right: _differences(left, right), "lang string, source string, item string, value long"
    )
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    of_group = W.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(of_group.orderBy(F.desc("value"), "item")).alias("rank"))

    term = ["lang", "digest", "split"]
    whole = shares.groupBy(*term, "lang_total", "kept").agg(F.sum("n").alias("lang_n"))
    whole = whole.select(*term, share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    above = shares.select(*term, "source", "p").join(whole, term).select(*term, "source", (F.col("p") - F.col("q")).alias("value")).filter("value > 0")
    best = above.withColumn("place", F.rank().over(of_group.orderBy(F.desc("value")))).filter(F.col("place") <= top)
    named = best.join(terms, term).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value",
        F.row_number().over(of_group.orderBy(F.desc("value"), "term")).alias("rank"),
    ).filter(F.col("rank") <= top)
    return pairs.unionByName(named)
