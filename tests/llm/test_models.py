from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from helpers import LOWER, WORDS, awkward, empty
from pyspark.sql import functions as F

from remitra.llm import crf, fertility, hmm, mixing, ordinal, queries, voronoi
from remitra.llm.chains import Chains
from remitra.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def best_by_all_pairs(rows, every, k):
    out = {}
    for i, q in rows.items():
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j) for j, x in rows.items() if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_top_k_against_all_pairs(spark):
    draw = random.Random(3)
    rows = {i: [draw.randint(-40, 40) for _ in range(6)] for i in range(300)} | {i: [9, 9, 9, 9, 9, 9] for i in range(300, 420)}
    rows |= {500: [1, 2], 501: [60] * 6}
    df = spark.createDataFrame([*rows.items(), (600, None), (None, [1, 2, 3, 4, 5, 6]), (601, [1, None, 2, 3, 4, 5])], "vec_id long, vec array<long>")
    got = {}
    for r in voronoi.top_k(df, F.col("vec_id") % 20 == 0, 7, pivots=5, block_rows=32, chunk_rows=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == best_by_all_pairs(rows, 20, 7)


def test_top_k_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1]), (20, [2]), (3, [3]), (3, [4])], "vec_id long, vec array<long>")
    got = [tuple(r) for r in voronoi.top_k(few, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 3), (0, 2, 20, 2), (20, 1, 3, 6), (20, 2, 0, 2)]
    assert voronoi.top_k(few.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    large = spark.createDataFrame([(0, [2**31, 5]), (1, [2**31, 7]), (2, [2**31, -1])], "vec_id long, vec array<long>")
    got = [r.score for r in voronoi.top_k(large, F.col("vec_id") == 0, 2).orderBy("rank").collect()]
    assert got == [2**62 + 35, 2**62 - 5]


def plain_base(text):
    text = text or ""
    words, seen, lines = WORDS(text), set(), 0
    for line in text.split("\n"):
        if WORDS(line):
            lines += line in seen
            seen.add(line)
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + j for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(hit), failed


def test_base_rules(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text", "lang")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in fertility.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(texts[r.doc_id])
    rows = awkward(spark).collect()
    want = sorted(plain_base(r.text) for r in rows)
    got = fertility.judge(awkward(spark)).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert fertility.judge(empty(spark)).count() == 0


def test_words_of_a_batch_are_measured_together(monkeypatch):
    words = ["plain", "été", "§x", "123", "", "日本", "...", "9th", "Ωmega", "ʼn", "\U0001f600", "İx", "plain,"]
    pieces = fertility.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    alone = [[pieces.model.encode(w), fertility.Pieces.script(w)] for w in words]
    asked = []
    by_letters = fertility.Pieces.script
    monkeypatch.setattr(fertility.Pieces, "script", staticmethod(lambda w: asked.append(w) or by_letters(w)))
    for part in (words, words[3:] + ["plainly"]):
        for word, row in zip(part, pieces(part).tolist(), strict=True):
            ids, script = alone[words.index(word)] if word in words else (pieces.model.encode(word), fertility.SCRIPTS.index("latin"))
            assert row == [len(ids), int(sum(pieces.model.is_byte(k) for k in ids)), script], word
    # Words that begin with a letter known by now are not looked at one by one.
    assert {w for w in asked if len(w) > 1} == {"§x", "123", "...", "9th"}


def test_fertility_measures(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in fertility.measure(table(spark, FOLDER, "documents").limit(40)).join(table(spark, FOLDER, "documents").select("doc_id", "text"), "doc_id").collect():
        ids = tokens.encode(r.text, add_special_tokens=False).ids
        assert math.isclose(r.chars_per_token, len(r.text) / len(ids))
        shares = [n / len(ids) for n in Counter(ids).values()]
        assert math.isclose(r.token_entropy, -sum(s * math.log2(s) for s in shares))
        got = [p for w in WORDS(r.text) for p in pieces.encode(w)]
        assert math.isclose(r.fallback_share, sum(map(pieces.is_byte, got)) / len(got))


def test_an_odd_text_is_outside_the_band(spark):
    draw = random.Random(2)
    usual = [(k, " ".join(draw.choices("the of and a house walks under green trees every day".split(), k=80)), "en") for k in range(60)]
    odd = [(100, " ".join("".join(draw.choices("zqxj#%", k=9)) for _ in range(80)), "en"), (101, " ".join("".join(draw.choices("日本語の文字です今日は雨山川", k=4)) for _ in range(80)), "en")]
    rows = fertility.judge(spark.createDataFrame(usual + odd, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id for r in rows if not r.kept and not r.base_failed} == {100, 101}


def test_copies_do_not_narrow_the_bands(spark):
    draw = random.Random(3)
    names = ["".join(draw.choices("abcdefghiklmnoprstuw", k=5)) for _ in range(60)]
    usual = [(k, " ".join(draw.choices(names[: 10 + k], k=120)), "en") for k in range(50)]
    copies = [(k, usual[-1][1], "en") for k in range(100, 200)]
    rows = fertility.judge(spark.createDataFrame(usual + copies, "doc_id long, text string, lang string")).collect()
    assert len(rows) == 150 and all(r.kept for r in rows)


def test_rates_meet_targets(spark):
    draw = np.random.default_rng(5)
    p = draw.dirichlet([0.4, 0.3, 0.3], 400)
    n = draw.integers(1, 900, 400)
    df = spark.createDataFrame([(int(a), *map(float, q)) for a, q in zip(n, p, strict=True)], "n_tokens long, p0 double, p1 double, p2 double")
    whole = (n[:, None] * p).sum(axis=0)
    goals = [0.5 * whole.sum() * s for s in (0.6, 0.3, 0.1)]
    rows, aims, got = mixing.fitted(df, [0.6, 0.3, 0.1], total=0.5 * whole.sum(), most=3.0)
    rows = rows.toPandas()
    assert np.allclose(aims, goals) and np.allclose(got, goals, rtol=1e-2)
    assert rows.rate.between(0, 3).all()
    rate = np.ones(400)  # the same steps by hand, then until they stand still
    q, w = rows[["p0", "p1", "p2"]].to_numpy(), rows["n_tokens"].to_numpy()
    for _ in range(2000):
        rate = np.clip(rate - q @ (((w * rate) @ q - goals) / whole), 0, 3)
    assert np.abs(rate - rows.rate).max() < 0.05


def plain_posteriors(docs, labels, domains):
    import xxhash

    bucket = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    words = {i: [signed(bucket(w)) % mixing.BUCKETS for w in (t or "").lower().split()] for i, t in docs.items()}
    count = {d: Counter(b for i, x in labels.items() if x == d for b in words.get(i, [])) for d in domains}
    total = {d: sum(c.values()) for d, c in count.items()}
    every = sum(total.values())
    out = {}
    for i, bs in words.items():
        logits = []
        for d in domains:
            lift = [math.log((count[d][b] + 2) / (sum(count[x][b] for x in domains) * total[d] / every + 2)) for b in bs if any(count[x][b] for x in domains)]
            prior = math.log((sum(x == d for x in labels.values()) + 1) / (len(labels) + len(domains)))
            logits.append(prior + 40 * sum(lift) / max(len(bs), 1))
        top = max(logits)
        out[i] = [math.exp(x - top) / sum(math.exp(y - top) for y in logits) for x in logits]
    return out


def test_posteriors_and_copies(spark):
    draw = random.Random(1)
    docs = {i: " ".join(draw.choices(["red", "blue", "green"] if i % 3 else ["one", "two", "Red"], k=draw.randint(0, 30))) for i in range(60)}
    labels = {i: "n" if i % 3 == 0 else "c" for i in range(0, 60, 2)}
    frame = spark.createDataFrame([*docs.items(), (60, None)], "doc_id long, text string")
    got = mixing.mix(frame, spark.createDataFrame([*labels.items(), (999, "n"), (1, None)], "doc_id long, domain string"), {"n": 0.5, "c": 0.5}).collect()
    labels[999] = "n"
    want = plain_posteriors(docs | {60: None}, labels, ["c", "n"])
    for r in got:
        assert np.allclose([r.p_c, r.p_n], want[r.doc_id], atol=1e-9) and r.copies in (0, 1) and 0 <= r.rate <= 1
        assert r.n_tokens == len((docs.get(r.doc_id) or "").split())


def test_mixing_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, "a"), (7, "b"), (7, "a"), (None, "a")], "doc_id long, domain string")
    assert mixing.mix(awkward(spark), labels, {"a": 0.5, "b": 0.5}).count() == 15
    assert mixing.mix(awkward(spark), labels.limit(0), {"a": 0.5, "b": 0.5}).count() == 15
    assert mixing.mix(empty(spark), labels, {"a": 0.5, "b": 0.5}).count() == 0


def test_ordinal_gradient(spark):
    rows = [(k, k % 3, sorted(random.Random(k).sample(range(20), 5))) for k in range(40)]
    vectors = spark.createDataFrame(rows, "doc_id long, grade int, features array<int>").repartition(2)
    draw = np.random.default_rng(0)
    model = {"weights": np.zeros(ordinal.FEATURES), "first": np.array([0.3]), "gaps": np.array([-0.4])}
    model["weights"][:20] = draw.normal(size=20)

    def loss(m):
        cuts, total = ordinal.thresholds(m), 0.0
        for _, y, f in rows:
            above = [1, *(1 / (1 + math.exp(-((m["weights"] * lifts)[f].sum() - c))) for c in cuts), 0]
            total -= math.log(above[y] - above[y + 1])
        return total + 0.15 * (m["weights"] ** 2).sum()

    caught = {}
    ordinal_adam, ordinal.adam = ordinal.adam, lambda start, gradient, *a, **b: caught.update(gradient(model)) or start
    lifts = ordinal._lifts(vectors)
    try:
        ordinal.fit(vectors, 3)
    finally:
        ordinal.adam = ordinal_adam
    for name, at in (("weights", 3), ("weights", 11), ("first", 0), ("gaps", 0)):
        up, down = ({k: v.copy() for k, v in model.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert math.isclose(caught[name][at], (loss(up) - loss(down)) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)


def test_severity_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", F.col("toxic").alias("grade"))
    train, test = labels.filter("doc_id % 4 != 0"), labels.filter("doc_id % 4 = 0")
    rows = ordinal.severity(docs, train).join(test, "doc_id").select("toxic", F.col("severity"), test.grade).collect()
    hits = sum(r.toxic and r[2] == 1 for r in rows)
    assert hits >= 0.75 * sum(r[2] for r in rows) and sum(r.toxic and r[2] == 0 for r in rows) <= 2
    assert all(0 <= r.severity <= 2 for r in rows)


def test_severity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 0), (7, 1), (7, 0), (None, 1), (2, None), (99, 1)], "doc_id long, grade int")
    got = ordinal.severity(awkward(spark), labels).collect()
    assert len(got) == 15
    assert not any(r.toxic for r in ordinal.severity(awkward(spark), labels.limit(0)).collect())
    assert ordinal.severity(empty(spark), labels).count() == 0


def test_chains_against_all_paths():
    draw = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 5, 2])
    first, move, emit = draw.random(3), draw.random((3, 3)), draw.random((11, 3))
    chains = Chains(lengths)
    alpha, scales = chains.forward(first, move, emit)
    back, ahead = chains.backward(move, emit, scales)
    logs = chains.sums(np.log(scales))
    share = alpha * back
    at = np.flatnonzero(chains.later())
    pairs = (alpha[at - 1][:, :, None] * move * ahead[at][:, None, :]).sum(axis=0)
    want_pairs, start = np.zeros((3, 3)), 0
    for k, n in enumerate(lengths):
        if n == 0:
            assert logs[k] == 0
            continue
        whole, marginal, pair = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = first[path[0]] * math.prod(move[a, b] for a, b in itertools.pairwise(path)) * math.prod(emit[start + t, s] for t, s in enumerate(path))
            whole += weight
            for t, s in enumerate(path):
                marginal[t, s] += weight
            for a, b in itertools.pairwise(path):
                pair[a, b] += weight
        assert math.isclose(math.exp(logs[k]), whole) and np.allclose(share[start : start + n], marginal / whole)
        want_pairs += pair / whole
        start += n
    assert np.allclose(pairs, want_pairs)


def test_language_of_held_out_documents(spark):
    docs = table(spark, FOLDER, "documents")
    model = crf.fit(docs.filter("doc_id % 3 != 0"), per_language=40, steps=12)
    rows = crf.label(docs, model).join(docs.filter("doc_id % 3 = 0").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    by_lang = {r.lang: r.text.split()[:8] for r in docs.filter("length(text) > 300").collect()}
    names = sorted(by_lang)[:2]
    mixed = by_lang[names[0]] + by_lang[names[1]]
    share, letters, _ = crf.Labeller(model).words(pa.array([" ".join(mixed)]))
    picked = [model["names"][k] for k in share.argmax(axis=1)]
    assert sum(a == b for a, b in zip(picked, [names[0]] * 8 + [names[1]] * 8, strict=True)) >= 13


def test_language_of_awkward_rows(spark):
    model = crf.fit(awkward(spark), per_language=5, steps=2)
    got = crf.label(awkward(spark), model).collect()
    assert len(got) == 15
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (3, 4, 5))
    assert {r.lang_pred for r in crf.label(awkward(spark), crf.fit(empty(spark))).collect()} == {"und"}
    assert crf.label(empty(spark), model).count() == 0


def test_language_query_learns_from_its_own_rows(spark, tmp_path):
    words = {"en": "the house and the garden of the town", "de": "das haus und der garten von der stadt"}
    rows = [(k, words["en" if k % 2 else "de"], "en" if k % 2 else "de") for k in range(40)] + [(40, None, "en"), (41, "12 34", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_language(spark, str(tmp_path)).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:40])
    assert [(got[k].lang_pred, got[k].score) for k in (40, 41)] == [("und", 0.0)] * 2
    assert {k for k in got if got[k].held_out} == {k for k in got if zlib.crc32(str(k).encode()) % 5 == 0}


def test_probabilities_of_texts_add_up(spark):
    texts = ["a b a", "b b", "", "a", "a c"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    old, hmm.SYMBOLS = hmm.SYMBOLS, 1
    try:
        asked = [(100 + k, " ".join(x)) for k, x in enumerate(itertools.chain.from_iterable(itertools.product(["a", "b", "c"], repeat=n) for n in (0, 1, 2)))]
        both = docs.union(spark.createDataFrame(asked, docs.schema))
        rows = {r.doc_id: r for r in hmm.score(both, F.col("doc_id") >= 100, states=3).collect()}
    finally:
        hmm.SYMBOLS = old
    p = {t: 10 ** rows[i].score for i, t in asked}
    assert all(0 < x < 1 for x in p.values()) and sum(p.values()) < 1
    assert rows[100].n_tokens == 1 and rows[0].n_known == 4 and rows[0].train_tokens == 13


def test_likelihood_against_plain_counts(spark):
    docs = table(spark, FOLDER, "documents")
    rows = hmm.score(docs, F.col("doc_id") % 7 == 2).collect()
    texts = {r.doc_id: WORDS(r.text.translate(LOWER)) for r in docs.collect()}
    count, ends = Counter(), 0
    for i, words in texts.items():
        if i % 7 != 2:
            count.update(words)
            ends += 1
    tokens, kinds = sum(count.values()) + ends, len(count) + 1
    for r in rows:
        words = texts[r.doc_id]
        base = sum(math.log10((c + 1) / (tokens + kinds + 1)) for c in [*(count[w] for w in words), ends])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_known == 1 + sum(count[w] > 0 for w in words)
        assert r.train_tokens == tokens and r.n_tokens == len(words) + 1
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_frequent_words_do_not_change_the_base(spark):
    docs = table(spark, FOLDER, "documents").limit(60)
    want = {r.doc_id: (r.n_known, r.base_score, r.score) for r in hmm.score(docs, F.col("doc_id") % 7 == 2).collect()}
    old, hmm.FREQUENT = hmm.frequent_words.__defaults__, 0
    hmm.frequent_words.__defaults__ = (2_000,)
    try:
        got = {r.doc_id: (r.n_known, r.base_score, r.score) for r in hmm.score(docs, F.col("doc_id") % 7 == 2).collect()}
    finally:
        hmm.frequent_words.__defaults__ = old
    assert all(got[i][0] == n and math.isclose(got[i][1], b) for i, (n, b, _) in want.items())


def test_every_round_learns_from_every_text(spark, monkeypatch):
    rows = spark.range(1800).selectExpr("id as row", "cast(concat(if(id % 3 = 0, x'0000', x'0100'), x'0200') as binary) as symbols")
    read = []
    monkeypatch.setattr(hmm, "summed", lambda table, f, plain=hmm.summed: read.append((table.count(), found := plain(table, f))) or found)
    model = hmm.baum_welch(rows, np.full(3, 1 / 3), states=2, rounds=2, parts=4)
    assert len(read) == 8 and [sum(n for n, _ in read[k : k + 4]) for k in (0, 4)] == [1800, 1800]
    assert all(math.isclose(counts["first"].sum(), n) and math.isclose(counts["emit"].sum(), 2 * n) for n, counts in read)
    assert all(np.allclose(model[name].sum(axis=-1), 1) for name in model)


def test_likelihood_of_awkward_rows(spark):
    assert len(hmm.score(awkward(spark), F.col("doc_id") == 2).collect()) == 15
    rows = hmm.score(awkward(spark), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert hmm.score(empty(spark), F.lit(False)).count() == 0
