from collections import Counter

import pytest

import corpus_pipeline
from postlake.llm import mixing
from tests.llm import brute
from tests.llm.test_decontaminate import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, docs))
    return {n: (d, d.collect()) for n, d in out}


def test_columns_and_counts(steps):
    documents = steps["documents"][0]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert steps[name][0].dtypes == documents.dtypes
    sizes = {n: len(rows) for n, (_, rows) in steps.items()}
    assert sizes["documents"] > sizes["quality"] > sizes["near_duplicates"] > sizes["decontamination"] > 0
    assert sizes["mixing"] == sizes["sharding"]


def test_quality_keeps_clean_rows(spark, steps):
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0}
    gone = {r.doc_id for r in steps["documents"][1]} - {r.doc_id for r in steps["quality"][1]}
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len((gone & labelled) - bad) <= 0.02 * len(labelled)


def test_one_of_each_group(steps):
    before = {r.doc_id: r.text for r in steps["quality"][1]}
    groups = brute.near_duplicates(before, width=5)
    assert {r.doc_id for r in steps["near_duplicates"][1]} == {i for i, g in groups.items() if i == g}


def test_no_benchmark_left(spark, steps):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in steps["near_duplicates"][1] if any(windows(r.text, x) >= 0.8 for x in items)}
    assert {r.doc_id for r in steps["decontamination"][1]} == {r.doc_id for r in steps["near_duplicates"][1]} - dirty


def test_mix_and_shards(steps):
    docs, _ = steps["decontamination"]
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = Counter()
    for r in steps["mixing"][1]:
        got[r.doc_id] += len(brute.words(r.text))
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert Counter(r.doc_id for r in steps["mixing"][1]) == Counter(r.doc_id for r in steps["sharding"][1])
