"""The pipeline, stage by stage, against plain Python on a small table."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from corpusgraph.llm import packing, pii, quality
from corpusgraph.llm.scratch import written

from test_documents import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    assert all(x.dtypes == stages[0].dtypes for x in stages[1:-1])


def test_quality_stage(stages):
    kept = {r.doc_id for r in quality.quality(stages[0]).where("kept").collect()}
    got = {r.doc_id: r.text for r in stages[1].collect()}
    before = {r.doc_id: r.text for r in stages[0].collect()}
    assert set(got) == kept and all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in got.items())


def test_one_of_each_group_stays(stages):
    expect = brute_components([(r.doc_id, r.text) for r in stages[1].collect()], 80)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({c for _, c in expect.values()}) and corpus_pipeline.NEAR_PERCENT == 80


def test_personal_data_is_gone(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r.text for r in stages[3].collect()}
    assert set(before) == set(after) and sum(bool(pii.spans_text(pii.find(t))) for t in before.values()) > 0
    assert all(pii.spans_text(pii.find(t), pii.BASE_KINDS) == "" for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not pii.spans_text(pii.find(t)))


def test_mixture(stages):
    copies = collections.Counter(r.doc_id for r in stages[4].collect())
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    assert set(copies) <= set(texts) and max(copies.values()) <= 3
    assert {r.doc_id: r.text for r in stages[4].collect()} == {i: texts[i] for i in copies}


def test_packing_covers_all_copies(stages, spark):
    lengths = collections.Counter()
    for r in stages[5].collect():
        assert r.length & (r.length - 1) == 0
        lengths[r.doc_id] += r.length
    total = {r.doc_id: r.doc_tokens for r in stages[5].collect()}
    copies = collections.Counter(r.doc_id for r in stages[4].collect())
    assert lengths == {i: n * total[i] for i, n in copies.items()} and packing.LENGTH == 4096


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).drop("sequence_id", "ids").collect()
    assert sorted(map(str, got)) == sorted(map(str, stages[5].drop("sequence_id", "ids").collect()))
