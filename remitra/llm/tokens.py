"""Ids of whole texts by a vocabulary file of the tokenizers library, each distinct piece encoded once.

The two supported layouts split a text before any merge, so the ids of a text
are those of its pieces one after the other. A batch of texts is cut with Arrow
kernels, its distinct pieces are looked up in the worker's memory, and only
unseen ones go through the library, many in one call. Where a cut could change
the ids (runs of white space with the byte layout), the text is encoded as a whole.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from remitra.llm.common import as_strings

#: Pieces a worker remembers; beyond them it forgets all but those that the batch before had met again.
REMEMBERED = 400_000
#: Pieces that go through the library in one call.
TOGETHER = 4_096

_IRREGULAR = r"[ \n]{2}|[\t\x0b\x0c\r\x02]|[ \n]$|^[ \n]"
_TAIL = ",.;:!?"
#: Most pieces that keep their ids with others around them, by layout, and a word with marks behind it.
_PLAIN = {True: r"^[!-~\p{L}\p{M}\p{N}]+$", False: r"^[\n ][!-~\p{L}\p{M}\p{N}]+$"}
_MARKED = rf"[A-Za-z][{_TAIL}]+$"


def _matches(pieces: list[str], pattern: str) -> np.ndarray:
    return pc.match_substring_regex(pa.array(pieces, pa.string()), pattern).to_numpy(zero_copy_only=False).astype(bool)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        suffix = declared["model"].get("end_of_word_suffix") or ""
        self.by_words = bool(suffix)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self._bytes = np.zeros(self.size, np.int64)
        for token, number in vocabulary.items():
            self._bytes[number] = len(token.removesuffix(suffix) if suffix else token)
        self._clear()

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        self._sizes, self._firsts, self._values = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self._held = 0
        self._again = np.zeros(0, np.int64)  # pieces of the batch before that were known then

    def _forget(self) -> None:
        """Keep common pieces alone, at most half of what may be remembered."""
        again = self._again[: REMEMBERED // 2]
        names, ids, sizes = list(self._known), self.ids_of(again), self._sizes[again]
        self._clear()
        self._remember([names[k] for k in again.tolist()], ids, sizes)

    def _remember(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the ids of new pieces, which stand one after the other in ``ids``."""
        n, k = len(self._known), len(pieces)
        while n + k > len(self._sizes):
            self._sizes, self._firsts = np.resize(self._sizes, 2 * len(self._sizes)), np.resize(self._firsts, 2 * len(self._firsts))
        while self._held + len(ids) > len(self._values):
            self._values = np.resize(self._values, 2 * len(self._values))
        self._sizes[n : n + k] = sizes
        self._firsts[n : n + k] = self._held + np.cumsum(sizes) - sizes
        self._values[self._held : self._held + len(ids)] = ids
        self._held += len(ids)
        self._known.update(zip(pieces, range(n, n + k), strict=True))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _form_bytes(self, pieces: list[str]) -> np.ndarray:
        """The bytes of each piece in the form that the vocabulary takes."""
        if self.by_words:
            pieces = [p if p.isascii() else unicodedata.normalize("NFC", p).lower() for p in pieces]
        return pc.binary_length(pa.array(pieces, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces in one call and cut the ids where their bytes end; if the cuts don't fit, one by one."""
        joined = ("\n" if self.by_words else "").join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(self._bytes[ids])
        want = np.cumsum(self._form_bytes(pieces))
        at = np.searchsorted(ends, want)
        if len(ends) and ends[-1] == want[-1] and np.array_equal(ends[np.minimum(at, len(ends) - 1)], want):
            self._remember(pieces, ids, np.diff(at, prepend=-1))
        else:
            self._one_by_one(pieces)

    def _one_by_one(self, pieces: list[str]) -> None:
        rows = [self.whole(p) for p in pieces]
        self._remember(pieces, np.concatenate(rows), np.array([len(r) for r in rows]))

    def _simple(self, piece: str) -> bool:
        """Whether the piece keeps its ids with others before and behind it."""
        if self.by_words:
            return piece.isprintable() and not piece.isspace()
        return piece[:1] in ("\n", " ") and len(piece) > 1 and piece[1:].isprintable() and not piece[1].isspace() and not piece[-1].isspace()

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the pieces in what the worker remembers, after learning the new ones."""
        known = self._known
        if len(known) > REMEMBERED:
            self._forget()
            known = self._known
        found = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        self._again = found[found >= 0]
        new = [pieces[k] for k in np.flatnonzero(found < 0)]
        if not new:
            return found
        marked = _matches(new, _MARKED)  # a word and the marks behind it are never merged
        cut = [new[k] for k in np.flatnonzero(marked)]
        stems = [piece.rstrip(_TAIL) for piece in cut]
        tails = [piece[len(stem) :] for piece, stem in zip(cut, stems, strict=True)]
        whole = [new[k] for k in np.flatnonzero(~marked)]
        own = len(whole)
        if cut:
            here = set(whole)
            whole += [p for p in dict.fromkeys(stems + tails) if p not in known and p not in here]
        plain = _matches(whole, _PLAIN[self.by_words])
        odd = np.flatnonzero(~plain)
        simple = np.fromiter((self._simple(whole[k]) for k in odd), bool, len(odd))
        order = np.concatenate([np.flatnonzero(plain), odd[simple], odd[~simple]])
        together, alone = [whole[k] for k in order[: len(whole) - int((~simple).sum())]], [whole[k] for k in odd[~simple]]
        numbers = np.empty(len(whole), np.int64)
        numbers[order] = len(known) + np.arange(len(whole))
        for k in range(0, len(together), TOGETHER):
            self._learn(together[k : k + TOGETHER])
        if alone:
            self._one_by_one(alone)
        of_new = np.empty(len(new), np.int64)
        of_new[~marked] = numbers[:own]
        if cut:
            parts = np.empty((len(cut), 2), np.int64)
            parts[:, 0] = np.fromiter(map(known.get, stems), np.int64, len(cut))
            parts[:, 1] = np.fromiter(map(known.get, tails), np.int64, len(cut))
            of_new[marked] = len(known) + np.arange(len(cut))
            self._remember(cut, self.ids_of(parts.ravel()), self._sizes[parts].sum(axis=1))
        found[found < 0] = of_new
        return found

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of remembered pieces one after the other."""
        sizes = self._sizes[numbers]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.uint32)
        return self._values[np.repeat(self._firsts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1])]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids end."""
        texts = pc.fill_null(texts, "")
        if self.by_words:
            return self._regular(texts)
        odd = np.asarray(pc.match_substring_regex(texts, _IRREGULAR))
        if not odd.any():
            return self._regular(texts)
        ids, ends = self._regular(texts.filter(pa.array(~odd)))
        plain = iter(np.split(ids, ends[:-1]) if len(ends) else [])
        rows = [
            self.whole(text.as_py()) if strange else next(plain)
            for text, strange in zip(texts, odd, strict=True)
        ]
        return np.concatenate(rows), np.cumsum([len(r) for r in rows])

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.by_words:
            cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        else:
            marked = pc.replace_substring(texts, "\n", " \n")
            cut = pc.split_pattern(pc.binary_join_element_wise("\x02", marked, ""), " ")
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary
        if self.by_words:
            pieces = as_strings(distinct)
        else:
            pieces = as_strings(pc.binary_join_element_wise(" ", distinct, ""))
            for k in np.flatnonzero(np.asarray(pc.match_substring_regex(distinct, r"^[\n\x02]"))):
                pieces[k] = pieces[k][1 if pieces[k][1] == "\n" else 2 :]
        numbers = self.pieces(pieces)[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self._sizes[numbers])])
        offsets = cut.offsets.to_numpy()
        return self.ids_of(numbers), ends[offsets[1:] - offsets[0]]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every text's ids."""
    new_ends = ends + np.arange(1, len(ends) + 1)
    out = np.empty(len(ids) + len(ends), np.uint32)
    last = np.zeros(len(out), bool)
    last[new_ends - 1] = True
    out[last] = end_id
    out[~last] = ids
    return out, new_ends
