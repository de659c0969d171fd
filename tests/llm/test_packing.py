from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from remitra.llm import packing, repair, tokens
from remitra.llm.common import table
from remitra.llm.queries import op1_pack, op2_token_files
from remitra.llm.tokens import Encoder
from helpers import awkward, empty

FOLDER = "/root/testdata/sf0.001"


def plain_ids(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_strange_texts(name):
    draw = random.Random(5)
    signs = ["a", "The", " ", "  ", "\n", "\n\n", "\t", ",", "!?", "é", "é", "İ", "ß", " ", " ", "123", "'s", "'ll", "\x02", "\x01", "日本", "\U0001f600", "\r\n", "hello", "."]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    encoder = Encoder(public_tokenizers.path(name))
    for low in range(0, len(texts), 100):
        part = texts[low : low + 100]
        ids, ends = encoder(pa.array(part))
        got = np.split(ids, ends[:-1])
        for text, have, want in zip(part, got, plain_ids(name, part), strict=True):
            assert have.tolist() == want[:-1], text


def test_common_pieces_outlive_the_memory_of_rare_ones(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 70)
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    learned, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda pieces: learned.extend(pieces) or learn(pieces))
    for turn in range(8):
        texts = [" ".join(f"common{k} rare{turn}x{k}, again{k}." for k in range(20))] * 2 + ["", None]
        ids, ends = encoder(pa.array(texts, pa.string()))
        for text, have, want in zip(texts, np.split(ids, ends[:-1]), plain_ids("byte_bpe_50k.json", texts), strict=True):
            assert have.tolist() == want[:-1], text
        assert len(encoder._known) <= 70 + 62
    assert learned.count(" common7") == 1


def test_level_choice_minimises_the_sum_of_squares():
    draw = random.Random(1)
    levels = packing.Levels(64, 10**6)
    for k in range(3000):
        size = draw.randint(1, 64)
        before = levels.counts.copy()

        def cost(h, size=size, before=before):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + size < 64:
                n[h + size] += 1
            return int((n[1:64].astype(object) ** 2).sum())

        options = [h for h in range(1, 65 - size) if before[h]] + [0]
        best = levels.choose(size)
        assert cost(best) == min(map(cost, options))
        assert best == max(h for h in options if cost(h) == cost(best))
        levels.add(k, np.arange(size, dtype=np.uint32))
    levels.end()
    assert sum(len(r[2]) // 4 for r in levels.rows) == sum({r[0]: r[3] for r in levels.rows}.values())


def check_pieces(rows, ids):
    for doc, want in ids.items():
        pieces = sorted((r.start, r.length) for r in rows if r.doc_id == doc)
        at = 0
        for start, length in pieces:
            assert start == at
            at += length
        assert at == len(want)
    sequences = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padded = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    return padded


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([d.doc_id for d in docs], plain_ids("word_bpe_49k.json", [d.text for d in docs]), strict=True))
    assert check_pieces(op1_pack(spark, FOLDER).collect(), ids) == 0


def test_few_open_windows_lose_nothing(spark):
    docs = table(spark, FOLDER, "documents")
    size = F.sum(F.octet_length("ids") / 4)
    few = packing.pack(docs, window=256, open_windows=4).agg(size, F.max(F.col("offset") + F.octet_length("ids") / 4)).first()
    assert few[0] == packing.pack(docs).agg(size).first()[0] and few[1] == 256


def test_token_files(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start = 0
    rows = {r.doc_id: r for r in op2_token_files(spark, FOLDER).collect()}
    assert len(rows) == len(docs)
    for doc, ids in zip(docs, plain_ids("byte_bpe_50k.json", [d.text for d in docs]), strict=True):
        assert rows[doc.doc_id][1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_random_access(spark, tmp_path):
    folder = str(tmp_path / "ids")
    docs = table(spark, FOLDER, "documents")
    repair.write_ids(docs, folder, block_tokens=20_000, partitions=3)
    assert spark.read.parquet(folder).count() > 3
    for doc in docs.orderBy("doc_id").limit(3).collect():
        ids = plain_ids("byte_bpe_50k.json", [doc.text])[0]
        for low, high in ((0, 1), (3, 40), (len(ids) - 2, len(ids)), (0, len(ids)), (5, 5)):
            assert repair.read_range(spark, folder, doc.doc_id, low, high) == ids[low:high]
    assert repair.read_range(spark, folder, -1, 0, 5) == []


def test_grammar_replaces_pairs_and_gives_all_back():
    draw = np.random.default_rng(3)
    ids = np.concatenate([np.tile([7, 8, 9], 400), np.full(301, 5), draw.integers(0, 40, 5000), [1]]).astype(np.uint32)
    ends = np.array([900, 1200, 1501, 1502, len(ids)])
    rules, lengths, symbols, symbol_ends = repair.compress(ids, ends, 50, least=2)
    assert len(rules) and len(symbols) < len(ids)
    grammar = repair.Grammar(50, rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes())
    assert np.array_equal(grammar.expand(symbols), ids)
    for part, want in zip(np.split(symbols, symbol_ends[:-1]), np.split(ids, ends[:-1]), strict=True):
        assert np.array_equal(grammar.expand(part), want)


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    texts = [r.text for r in docs.collect()]
    whole = sum(len(ids) for ids in plain_ids("word_bpe_49k.json", texts))
    assert packing.pack(docs).agg(F.sum(F.octet_length("ids") / 4)).first()[0] == whole
    repair.write_ids(docs, str(tmp_path / "a"))
    rows = repair.read_ids(spark, str(tmp_path / "a")).collect()
    assert len(rows) == len(texts)
    assert sorted(bytes(r.ids) for r in rows) == sorted(np.array(i, "<u4").tobytes() for i in plain_ids("byte_bpe_50k.json", texts))
    ends = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    assert packing.pack(empty(spark)).count() == 0
    repair.write_ids(empty(spark), str(tmp_path / "b"))
    assert repair.read_ids(spark, str(tmp_path / "b")).count() == 0
