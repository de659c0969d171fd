"""Divergence of sources, Merkle manifests and byte-level BPE against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from remitra.llm import bytebpe, divergence, manifest
from remitra.llm.queries import op11_divergence, op12_manifest, op13_byte_bpe
from helpers import LOWER, awkward, empty

FOLDER = "/root/testdata/sf0.001"


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def known():
    return bytebpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def ids_of(known, *texts):
    return [row.tolist() for row in np.split(*(lambda ids, ends: (ids, ends[:-1]))(*known.encode(pa.array(texts))))]


def test_strange_texts(library, known):
    draw = random.Random(8)
    signs = ["a", "The", "ing", " ", "  ", "\n", "\n\n ", "\t", ",", "!?", "é", "é", "İ", "ß", "\xa0", "　", "\x85", "\x1c", "123", "'s", "'ll", "\x00", "日本語", "\U0001f600", "\r\n", "र्", "ກ", "Ⅷ"]
    for _ in range(100):
        texts = ["".join(draw.choices(signs, k=draw.randint(0, 40))) for _ in range(50)]
        texts += [" ".join(draw.choices(signs[:3] + signs[8:], k=draw.randint(0, 20))) for _ in range(50)]
        for text, ids in zip(texts, ids_of(known, *texts), strict=True):
            assert ids == library.encode_ordinary(text), text


def test_code_points(library, known):
    """Every character between letters, digits and blanks, so that it is cut as the library cuts it."""
    for low in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}1 {chr(c)}\n" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        assert ids_of(known, text) == [library.encode_ordinary(text)], hex(low)


def test_long_matches(library, known):
    draw = random.Random(2)
    for text in ("a" * 20_000, "".join(draw.choices("abcde", k=20_000)), "国" * 5_000 + "文字" * 3_000, " " * 3_000, "=-" * 4_000):
        assert ids_of(known, text) == [library.encode_ordinary(text)]


def test_trees_join_the_leftmost_least_pair(known):
    draw = random.Random(4)
    ranks = known.ranks.of
    for leaves in (2, 8, 64):
        pieces = [bytes(draw.choices(b"abcdeilnorst", k=draw.randint(1, leaves))) for _ in range(200)]
        trees = bytebpe.PairTrees(known.ranks, pieces, leaves)
        want = []
        for k, piece in enumerate(pieces):
            tokens = [piece[j : j + 1] for j in range(len(piece))]
            first = True
            while True:
                pairs = [(ranks[a + b], j) for j, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if a + b in ranks]
                if first:
                    root = trees.nodes[2 * leaves * k + 1]
                    assert root == (min(pairs)[0] * leaves + min(pairs)[1] if pairs else trees.none)
                    first = False
                if not pairs:
                    break
                j = min(pairs)[1]
                tokens[j : j + 2] = [tokens[j] + tokens[j + 1]]
            want.append([ranks[t] for t in tokens])
        ids, sizes = trees.merged()
        assert [row.tolist() for row in np.split(ids, np.cumsum(sizes)[:-1])] == want
        assert [bytebpe.merged_alone(known.ranks, piece) for piece in pieces] == want


def plain_digests(library, texts):
    out = []
    for text in texts:
        ids = library.encode_ordinary(text or "")
        out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    return out


def test_byte_bpe_query(spark, library):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: d for r, d in zip(rows, plain_digests(library, [r.text for r in rows]), strict=True)}
    assert {r.doc_id: tuple(r[1:]) for r in op13_byte_bpe(spark, FOLDER).collect()} == want


def test_byte_bpe_of_awkward_rows(spark, library):
    docs = awkward(spark)
    texts = [r.text for r in docs.collect()]
    rows = bytebpe.decode(bytebpe.encode(docs)).collect()
    assert sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in rows) == sorted(
        (r.doc_id or 0, library.encode_ordinary(t or ""), (t or "").encode()) for r, t in zip(docs.collect(), texts, strict=True)
    )
    assert bytebpe.decode(bytebpe.encode(empty(spark))).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, [104]), (2, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bytebpe.decode(nothing).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and bytes(got[None]) == bytes([library.decode_bytes([104])[0]])


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, fields=manifest.FIELDS):
    return h(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in fields))


def plain_tree(nodes, arity):
    """Root and each node's (left, right) siblings by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, place in enumerate(at):
            low = place - place % arity
            paths[k].append(("".join(level[low:place]), "".join(level[place + 1 : low + arity])))
        level = [h(*level[k : k + arity]) for k in range(0, len(level), arity)]
        at = [place // arity for place in at]
    return level[0], paths


def plain_manifest(rows, tampered, arity=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, plain_leaf(row), row))
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    trees = {name: plain_tree([x[2] for x in sorted(groups[name], key=lambda x: x[:3])], arity) for name in names}
    root, tops = plain_tree([trees[name][0] for name in names], arity)
    out = []
    for name, top in zip(names, tops, strict=True):
        for (_, _, leaf, row), path in zip(sorted(groups[name], key=lambda x: x[:3]), trees[name][1], strict=True):
            folded = plain_leaf(tampered(row))
            for left, right in path + top:
                folded = h(left, folded, right)
            out.append((row["doc_id"], leaf, trees[name][0], root, h(*(left + right for left, right in path + top)), folded, folded == root))
    return out


def shown(rows):
    siblings = F.array_join(F.transform("path", lambda at: F.concat(at["left"], at["right"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), "folded_root", "verified")


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def one_more(row):
    hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None
    return {**row, "n_chars": row["n_chars"] + 1} if hit else row


def test_manifest_query(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = op12_manifest(spark, FOLDER).collect()
    assert ordered(got) == ordered(plain_manifest(rows, one_more))
    assert 0 < sum(not r.verified for r in got) < len(rows) / 3


@pytest.mark.parametrize(("arity", "levels"), [(2, 2), (3, 2), (2, 8), (5, 1)])
def test_manifest_of_several_passes(spark, monkeypatch, arity, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = [{"doc_id": k, "source": "s", "lang": lang, "n_chars": k, "text": f"é{k}"} for lang, n in (("a", 1), ("b", 70), (None, 27), ("", 2), ("é", 33)) for k in range(n)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    claimed = {"n_chars": F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = shown(manifest.proofs(docs, claimed, arity=arity)).collect()
    assert ordered(got) == ordered(plain_manifest(rows, lambda r: {**r, "n_chars": r["n_chars"] + (r["doc_id"] % 5 == 0)}, arity))


def test_manifest_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = [r.asDict() for r in docs.collect()]
    got = shown(manifest.proofs(docs)).collect()
    assert ordered(got) == ordered(plain_manifest(rows, lambda r: r)) and all(r.verified for r in got)
    assert manifest.proofs(empty(spark)).count() == 0
    alone = docs.filter("doc_id = 9")
    row = manifest.proofs(alone).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.path == []


# Divergence of sources


def plain_audit(rows, least, top):
    groups, frequency = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        frequency[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in frequency[lang].items() if n >= least]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = {s: shares(c) for (la, s), c in groups.items() if la == lang}
        whole = shares(sum((c for (la, _), c in groups.items() if la == lang), Counter()))
        for source, p in own.items():
            pairs = [(-sum(abs(p[t] - q[t]) for t in kept), other.encode()) for other, q in own.items() if other != source]
            terms = [(whole[t] - p[t], t.encode()) for t in kept if groups[lang, source][t] and p[t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def audited(docs, **how):
    return sorted(map(tuple, divergence.audit(docs, **how).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence_query(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted(map(tuple, op11_divergence(spark, FOLDER).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain_audit(rows, 30, 50) and {r[2] for r in got} == {"pair", "term"}


@pytest.mark.parametrize("bits", [2, 5, 64])
def test_terms_that_share_a_digest(spark, bits, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 64)
    draw = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["É", "é", "日本", "Ünïcode\xa0x", "A1B", "don't"]
    rows = [(" ".join(draw.choices(words[: draw.choice([20, 66])], k=draw.randint(0, 30))), draw.choice(["en", "de", None]), draw.choice(["a", "b", "é", "", None])) for _ in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert audited(docs, least=6, top=7, bits=bits) == plain_audit(rows, 6, 7)


def test_divergence_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    for least in (1, 2, 30):
        assert audited(docs, least=least) == plain_audit(rows, least, 50)
    assert divergence.audit(empty(spark)).count() == 0


def test_large_counts_stay_exact(spark):
    n, total, kept = 9 * 10**17, 9 * 10**17 + 12345, 10**6
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).first()
    assert row[0] == 1 + 10**9 * (n + 5) // (total + 5 * kept)
