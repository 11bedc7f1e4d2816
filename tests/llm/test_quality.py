import zlib

import numpy as np
from pyspark.sql import functions as F

from postlake.llm import quality

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_is_all_pairs():
    random_ = np.random.default_rng(0)
    machine = quality.Machine(0.3, random_.normal(size=40), random_.normal(size=(40, 3)))
    rows = [(random_.choice(40, n, replace=False), random_.normal(size=n)) for n in (1, 2, 9)]
    for (places, values), got in zip(rows, machine.scores(rows)):
        raw = 0.3 + machine.weight[places] @ values
        for a in range(len(places)):
            for b in range(a + 1, len(places)):
                raw += machine.vectors[places[a]] @ machine.vectors[places[b]] * values[a] * values[b]
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-9


def test_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.assess(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    truth = [(r.quality, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for q, s in truth if q == 1], [s for q, s in truth if q == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95
    assert np.mean([s >= 0.3 for s in good]) >= 0.98
    assert quality.accepted(docs, labels).columns == docs.columns


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "\n \t"), (3, "&" * 200_000), (4, "word " * 50_000), (4, "word " * 50_000), (5, "é\U0001f600")]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (9, 0)], "doc_id long, quality int")
    got = quality.assess(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert len({r.score for r in got if r.doc_id == 4}) == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in quality.assess(docs, none).collect()] == [(0.5, 1)]
    assert quality.assess(docs.where(F.lit(False)), none).count() == 0


def test_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    ids = [n for n in range(40) if zlib.crc32(str(n).encode()) % 5][:2]
    docs = spark.createDataFrame([(i, f"text number {k} of many words", 30) for i in ids for k in range(1_500)], "doc_id long, text string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, k) for k, i in enumerate(ids)] * 2, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, targets, *a, **k: seen.append((len(rows), len(targets))))
    quality.train(docs, labels, rows=2)
    assert seen == [(2, 2)]
