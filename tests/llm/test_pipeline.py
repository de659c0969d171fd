from __future__ import annotations

import corpus_pipeline
from helpers import awkward, empty

from remitra.llm import circulant, fertility, fuzzylines, mixing
from remitra.llm.common import table
from remitra.llm.queries import TARGETS, domains

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_applies_its_operator(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name == "quality rules":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in fertility.judge(docs).filter("kept").collect()}
        elif name == "line dedup":
            want = {r.doc_id: r.text for r in fuzzylines.drop_repeated_lines(docs).collect() if not r.n_dropped or r.text.strip()}
            assert {r.doc_id: r.text for r in after.collect()} == want
            assert all(r.n_chars == len(r.text) for r in after.collect())
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in after.collect()} == {r.component_id for r in circulant.near_duplicates(docs).collect()}
        elif name == "mixing":
            rates = mixing.mix(docs, domains(table(spark, FOLDER, "labels")), TARGETS)
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in rates.filter("copies > 0").collect()}
        else:
            assert {r.doc_id for r in after.collect()} == set(before)
        if name != "packing":
            assert after.columns == columns and 0 < after.count() <= len(before)
        docs = after


def test_stages_stand_awkward_and_empty_tables(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, awkward(spark), FOLDER)
        ids = sorted((r.doc_id for r in rows.collect()), key=lambda i: (i is None, i or 0))
        if name == "line dedup":
            assert ids == [1, 1, *range(3, 12), None, None]
        elif name == "MinHash near-dedup":
            assert ids == [1, 1, *range(3, 12)]
        elif name != "packing":
            assert None not in ids and set(ids) <= set(range(1, 13))
        assert name == "packing" or rows.columns == columns
        assert stage(spark, empty(spark), FOLDER).count() == 0
