from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from remitra.llm import circulant, fuzzylines
from remitra.llm.links import connected, grouped_by_links, shared_buckets
from helpers import LOWER, WORDS, awkward, empty, grouped


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 430)] + [(500, k) for k in range(501, 700)] + [(9, 9)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = grouped({n for link in links for n in link}, links)
    assert all(got.get(n, n) == root for n, root in want.items())
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_within_buckets(spark):
    draw = random.Random(4)
    rows = [(draw.randint(0, 12), n, draw.randint(0, 400)) for n in range(250)] + [(99, n, 7) for n in range(250, 400)]
    rows += [(b + 100, n, m) for b, n, m in rows[:80]]
    near = lambda a, b: abs(a - b) <= 3
    want = grouped({n for _, n, _ in rows}, [(a, b) for x, a, m in rows for y, b, n in rows if x == y and a < b and near(m, n)])
    members = spark.createDataFrame(rows, "bucket long, node long, mark long")
    shared = shared_buckets(members)
    sizes = Counter(b for b, _, _ in rows)
    assert shared.count() == sum(n for n in sizes.values() if n > 1)
    got = {r.node: r.root for r in grouped_by_links(members, lambda m, n: F.abs(m - n) <= 3, lambda pairs: pairs).collect()}
    assert all(got.get(n, n) == root for n, root in want.items())


def shingles(text, size):
    words = WORDS((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[k:] for k in range(size)], strict=False))


def texts_with_copies():
    draw = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(25):
        words = draw.choices(vocabulary, k=draw.randint(60, 160))
        for changes in (0, 0, 1, 2, 3, 4, 6):
            copy = list(words)
            for _ in range(changes):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((n, " ".join(copy).upper() if changes == 0 and n % 2 else " ".join(copy)))
            n += 1
    chain = draw.choices(vocabulary, k=100)  # each is near the next, not the one after
    for k in range(8):
        rows.append((n, " ".join(chain[k * 6 :] + draw.choices(vocabulary, k=k * 6))))
        n += 1
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = texts_with_copies()
    sets = {i: shingles(t, 4) for i, t in rows}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = grouped(sets, [(i, j) for i in sets for j in sets if i < j and near(sets[i], sets[j])])
    got = circulant.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == want[r.doc_id]) for r in got)


def test_near_duplicates_of_awkward_rows(spark):
    got = circulant.near_duplicates(awkward(spark), size=4).collect()
    assert len(got) == 15
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[2].component_id == by_id[1].component_id == by_id[12].component_id == 1 and not by_id[2].kept
    assert all(by_id[k].n_shingles == 0 and by_id[k].kept for k in (3, 4, 5))
    assert by_id[7].n_shingles == 1 and by_id[10].n_shingles == 1
    assert circulant.near_duplicates(empty(spark)).count() == 0


def test_signature_is_the_minimum_over_shifts():
    import numpy as np

    sets = np.arange(1, 30, dtype=np.uint64) * np.uint64(977)
    circle = circulant._circle(20)
    values = circle[:, 0]
    at = (circulant._mixed(sets + np.uint64(circulant._STEP)) >> np.uint64(44)).astype(int)
    want = [min(values[(a + k) % len(values)] for a in at) for k in range(20)]
    assert circulant.signature(sets, 20).tolist() == want


def test_parity_words_differ_in_no_more_bits_than_sets_in_shingles():
    import numpy as np

    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**64, 400, dtype=np.uint64)
    for other in (0, 1, 5, 40, 300):
        near = np.concatenate([base[other:], draw.integers(0, 2**64, other, dtype=np.uint64)])
        bits = sum(int(x).bit_count() for x in (circulant.parity(base) ^ circulant.parity(near)).view(np.uint64))
        assert bits <= 2 * other and bits % 2 == 0 and (other == 0) == (bits == 0)


def test_large_family_of_copies_that_are_not_all_linked(spark):
    draw = random.Random(21)
    vocabulary = [f"w{k}" for k in range(300)]
    base, rows = draw.choices(vocabulary, k=90), []
    for n in range(160):
        copy = list(base)
        for _ in range(draw.randint(1, 7)):
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        rows.append((n, " ".join(copy)))
    sets = {i: shingles(t, 4) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = grouped(sets, links)
    assert len(set(want.values())) > 5 and max(Counter(want.values()).values()) > 20
    got = circulant.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def within(a, b, most):
    """Whether ``most`` edits of characters turn one text into the other."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, far) + 1
            if j:
                best = min(best, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
            new[j] = best
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), far) <= most


def plain_lines(rows):
    """Texts without repeated lines, by comparing all pairs of distinct lines."""
    import re

    normal = lambda line: re.sub(r"[\W_]+", " ", line.lower()).strip()
    places = [(i, k, normal(line)) for i, text in rows for k, line in enumerate((text or "").split("\n")) if normal(line)]
    lines = sorted({n for _, _, n in places})
    links = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if within(a, b, max(len(a), len(b)) // 10)]
    group, seen, gone = grouped(lines, links), set(), set()
    for i, k, n in sorted(places, key=lambda p: p[:2]):
        if group[n] in seen:
            gone.add((i, k))
        seen.add(group[n])
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) if t is not None else None for i, t in rows}
    return kept, len(gone), len(links)


def test_fuzzy_lines_against_all_pairs(spark):
    draw = random.Random(6)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(300)]
    originals = [" ".join(draw.choices(vocabulary, k=draw.randint(25, 40))) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for line in draw.sample(originals, 3):
            words = line.split(" ")
            if draw.random() < 0.5:
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            lines.append(" ".join(words).capitalize() + draw.choice([".", "!", ""]))
        rows.append((i, "\n".join([*lines, draw.choice(["", "--", "ab c", "Short line"])])))
    want, gone, links = plain_lines(rows)
    assert links > 20
    got = fuzzylines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert sum(r.n_dropped for r in got) == gone and all(r.n_lines == 4 for r in got)


def test_fuzzy_lines_of_awkward_rows(spark):
    docs = awkward(spark)
    out = fuzzylines.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = out.collect()
    assert len(got) == 15
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[8].text == "same line of some words" and by_id[8].n_dropped == 49
    assert by_id[1].n_dropped == 0 and by_id[2].text == "" and by_id[3].text is None and by_id[3].n_lines == 0
    assert by_id[4].text == "" and by_id[5].text == " \t\n \x0b"
    assert fuzzylines.drop_repeated_lines(empty(spark)).count() == 0


def test_fuzzy_lines_count_edits_in_characters(spark):
    """Lines of few words are as near as their characters are."""
    pairs = [
        ("Chapter 7 of the annual company report", "Chapter 8 of the annual company report"),
        ("Volume 12 with selected papers", "Volume 13 with selected papers"),
    ]
    rows = [(k, line) for k, line in enumerate(line for pair in pairs for line in pair)] + [(9, "Short line here"), (10, "Sharp lime hare")]
    got = {r.doc_id: r.n_dropped for r in fuzzylines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 9: 0, 10: 0}


def test_fuzzy_lines_against_all_pairs_by_edit_distance_alone(spark):
    draw = random.Random(12)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(300)]
    lines = []
    for size in (3, 6, 10, 10, 20, 20, 30, 50):
        words = draw.choices(vocabulary, k=size)
        line = " ".join(words)
        lines.append(line)
        for _ in range(3):  # one word of ten replaced by another of its length
            copy, left = list(words), len(line) // 10
            for k in draw.sample(range(size), size):
                if len(copy[k]) <= left:
                    left -= len(copy[k])
                    copy[k] = "".join(draw.choices("klmnop", k=len(copy[k])))
            lines.append(" ".join(copy))
        typed = list(line)
        for k in draw.sample(range(len(line)), len(line) // 10):  # letters mistyped anywhere
            typed[k] = draw.choice("qrs")
        lines.append("".join(typed))
    lines += ["".join(map(chr, range(0x4E00, 0x4E00 + 40))), "".join(map(chr, range(0x4E00, 0x4E00 + 39))) + "!\u4e8c"]
    lines = list(dict.fromkeys(lines))
    norms = [line.replace("!", " ") for line in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if 10 * edits(norms[i], norms[j]) <= max(len(norms[i]), len(norms[j]))]
    group = grouped(range(len(lines)), links)
    assert len(links) > 30
    got = fuzzylines.drop_repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_dropped} == {k for k in group if group[k] != k}
