"""Plain versions and awkward inputs for the tests of the text operators."""

from __future__ import annotations

import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: Columns of documents and some whose names the operators might use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _doc long, class binary, node long, bucket long, row long, "
    "h long, g int, kept boolean, th long, n_tokens long, rate double, word string, label string"
)


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    base = "one two three four five six seven eight nine ten " * 8
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, None), (3, None, "en", "b"), (4, "", "de", "b"), (5, " \t\n \x0b", None, "b"),
        (None, "a text without a number for itself", "en", None), (None, None, None, None), (6, "x" * 200_000, "en", "c"),
        (7, "word " * 60_000, "fr", "c"), (8, "\n".join(["same line of some words"] * 50), "en", "c"), (9, "日本語 текст 123 !!", "ja", "d"),
        (10, "a", "en", "d"), (11, "no break space \U0001f600 é", "fr", "d"), (12, base + "eleven", "en", "a"),
    ]
    extra = (7, b"k", 7, 7, 7, 7, 7, True, 7, 7, 0.5, "w", "l")
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), *extra) for i, t, la, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def grouped(nodes, links):
    """Each node's smallest reachable node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: min(g) for g in groups.values() for n in g}
