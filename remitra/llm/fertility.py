"""Quality rules by what public tokenizers make of a text.

Two vocabularies are used. The byte-level one gives characters per token and
the entropy of the text's tokens, the one with byte fallback gives the share of
tokens that are single bytes. What is usual differs by language, so the bands
come from the distinct texts of all documents that pass the base rules: per
language, or per script where no language is given, the quartiles widened by
``FENCE`` times their distance. A text counts once however many copies it has;
texts that differ in a word count each. A document outside a band of its language is rejected.

The base rules count words, their characters, symbols, repeated lines, and
words in runs of three that occur again. A text fails them if it has fewer than
50 words, or if more than half of its words are in such runs.

Null and empty texts have no words and fail. Repeated rows get equal verdicts.
A language of a single document sets its own band. Columns other than doc_id,
text and lang are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.llm.common import if_small, ship, staged, words_of
from remitra.llm.tokens import encoder

REMEMBERED = 200_000
#: Bytes of text that are measured together.
BATCH_BYTES = 6_000_000
LEAST_WORDS, MOST_REPEATED = 50, 50

#: First code points of blocks of letters, and the scripts they begin.
BLOCKS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "cjk"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x20000, "cjk"),
]
_STARTS = [start for start, _ in BLOCKS]
SCRIPTS = sorted({name for _, name in BLOCKS} | {"none"})


#: Widths of the bands in distances between the quartiles, and the least width as a share of the middle.
FENCE, LEAST_WIDTH = 4.0, 0.05
#: Byte fallback that any language may have.
FREE_FALLBACK = 0.02

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "script string, chars_per_token double, fallback_share double, token_entropy double, text_hash long"
)


class Pieces:
    """Tokens, byte tokens and script of words by a vocabulary with byte fallback, remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(k) for k in range(self.model.vocab_size())])
        self.known: dict[str, int] = {}  # tokens, byte tokens and script in one number
        self.letters: dict[str, int] = {}  # script of a word by its first character, -1 if that is no letter

    @staticmethod
    def script(word: str) -> int:
        for char in word:
            if char.isalpha():
                return SCRIPTS.index(BLOCKS[bisect_right(_STARTS, ord(char)) - 1][1])
        return SCRIPTS.index("none")

    def scripts(self, words: list[str]) -> np.ndarray:
        """``script`` of each word; most begin with a letter, which tells."""
        firsts = [w[:1] for w in words]
        self.letters |= {c: self.script(c) if c.isalpha() else -1 for c in set(firsts).difference(self.letters)}
        out = np.fromiter(map(self.letters.__getitem__, firsts), np.int64, len(words))
        for k in np.flatnonzero(out < 0):
            out[k] = self.script(words[k])
        return out

    def _measure(self, words: list[str]) -> np.ndarray:
        rows = self.model.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        return (sizes << 36) + (_by_text(self.byte[ids], np.cumsum(sizes)) << 8) + self.scripts(words)

    def __call__(self, words: list[str]) -> np.ndarray:
        """Tokens, byte tokens and script of distinct words."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        held = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(held < 0)
        for low in range(0, len(unseen), 20_000):
            at = unseen[low : low + 20_000]
            part = [words[k] for k in at.tolist()]
            held[at] = self._measure(part)
            self.known.update(zip(part, held[at].tolist(), strict=True))
        return np.stack([held >> 36, (held >> 8) & ((1 << 28) - 1), held & 255], axis=1)


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _by_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])[ends]
    return np.diff(total, prepend=0)


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    """Per text, its lines with a word that equal an earlier line."""
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    offsets = lines.offsets.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    full = np.asarray(pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]"))
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)[full]
    keys = np.unique(text[full] * (len(flat) + 1) + codes)
    return np.bincount(text[full], minlength=len(texts)) - np.bincount(keys // (len(flat) + 1), minlength=len(texts))


def _repeated_words(numbers: np.ndarray, ends: np.ndarray, kinds: int) -> np.ndarray:
    """Per text, its words within runs of three words that occur twice or more in it."""
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), sizes)
    w = numbers.astype(np.int64)
    at = np.flatnonzero(text[:-2] == text[2:]) if len(w) > 2 else np.zeros(0, np.int64)
    pair = w[at] * kinds + w[at + 1]
    if kinds >= 2**20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    run = pair * kinds + w[at + 2]
    order = np.lexsort((run, text[at]))
    same = (run[order][1:] == run[order][:-1]) & (text[at][order][1:] == text[at][order][:-1])
    found = at[order][np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(at) else at
    hit = np.zeros(len(w), bool)
    for k in range(3):
        hit[found + k] = True
    return _by_text(hit, ends)


def _entropy(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, start = np.zeros(len(ends)), 0
    for k, end in enumerate(ends.tolist()):
        if end > start:
            part = np.sort(ids[start:end])
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            share = np.diff(cuts) / (end - start)
            out[k] = -(share * np.log2(share)).sum()
        start = end
    return out


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``BATCH_BYTES`` of text, or of one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
            yield batch.slice(low, high - low)


def measure(docs: DataFrame, byte_vocabulary: str | None = None, piece_vocabulary: str | None = None) -> DataFrame:
    """Counts and measures per row of ``docs`` (doc_id, text, and lang if there is one)."""
    ship(docs.sparkSession)
    byte_path = byte_vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    piece_path = piece_vocabulary or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        for batch in parts_of(batches):
            texts = pc.fill_null(batch.column(2), "")
            distinct, numbers, ends = words_of(texts, lower=False)
            n_words = np.diff(ends, prepend=0)
            lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
            repeated = _repeated_words(numbers, ends, len(distinct))
            failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
            measured = _pieces(piece_path)(distinct)
            of_words = measured[numbers]
            tokens, fallback = _by_text(of_words[:, 0], ends), _by_text(of_words[:, 1], ends)
            text = np.repeat(np.arange(len(ends)), n_words)
            votes = np.bincount(text * len(SCRIPTS) + of_words[:, 2], minlength=len(ends) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
            none = SCRIPTS.index("none")
            votes[:, none] = np.where(votes.sum(axis=1) > votes[:, none], 0, 1)
            script = votes.argmax(axis=1)
            ids, id_ends = encoder(byte_path)(texts)
            n_ids = np.diff(id_ends, prepend=0)
            fertility = np.asarray(pc.utf8_length(texts)) / np.maximum(n_ids, 1)
            share = fallback / np.maximum(tokens, 1)
            entropy = _entropy(ids, id_ends)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(_by_text(lengths[numbers], ends), pa.int64()),
                    pc.cast(pc.count_substring_regex(texts, r"[#*$%&|<>]"), pa.int64()), pa.array(_repeated_lines(texts), pa.int64()),
                    pa.array(repeated, pa.int64()), pa.array(failed), pa.array([SCRIPTS[k] for k in script]),
                    pa.array(fertility, pa.float64()), pa.array(share, pa.float64()), pa.array(entropy, pa.float64()), batch.column(3),
                ],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    lang = "cast(lang as string)" if "lang" in docs.columns else "cast(null as string)"
    return docs.selectExpr("cast(doc_id as long) doc_id", f"{lang} lang", "cast(text as string) text", "xxhash64(cast(text as string)) text_hash").mapInArrow(run, SCHEMA)


def judge(docs: DataFrame, fence: float = FENCE, byte_vocabulary: str | None = None, piece_vocabulary: str | None = None) -> DataFrame:
    """Counts, measures, and ``kept``: whether a document passes the base rules and lies within the bands."""
    rows = staged(measure(docs, byte_vocabulary, piece_vocabulary), "measures").withColumn("_group", F.coalesce("lang", "script"))
    measures = ("chars_per_token", "fallback_share", "token_entropy")
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 10_000).alias(f"_{m}") for m in measures]
    texts = rows.filter("not base_failed").select("_group", "text_hash", *measures).distinct()
    bands = staged(texts.groupBy(F.col("_group").alias("_of")).agg(*quartiles), "bands")

    def within(name: str) -> Column:
        low, high = F.col(f"_{name}")[0], F.col(f"_{name}")[1]
        width = fence * F.greatest(high - low, LEAST_WIDTH / fence * (low + high) / 2)
        upper = F.col(name) <= high + width + (FREE_FALLBACK if name == "fallback_share" else 0)
        return upper if name == "fallback_share" else upper & (F.col(name) >= low - width)

    fits = within(measures[0]) & within(measures[1]) & within(measures[2])
    return (
        rows.join(if_small(bands), F.col("_group") == F.col("_of"), "left")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False)))
        .select("doc_id", *BASE, "base_failed", "kept", *measures, "script")
    )

