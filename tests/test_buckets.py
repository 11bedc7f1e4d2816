"""The bucketed store: what a batch reads and writes, repeats and failures, and the one-by-one model."""

import random

from pyspark.sql import functions as F

from postlake.operators.match import stored_keys
from postlake.sources.buckets import Store
from tests.test_store import HASHED, PRIORITY, URL, Model, frame, row


def ranks(spark):
    return spark.createDataFrame(list(PRIORITY.items()), "source_key string, priority long")


def in_force(store):
    return {(r.name, r.bucket): r.batch for r in store.manifest().collect()}


def test_a_batch_changes_its_own_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=256, spread=2)
    first = frame(spark, [row("a", f"old{n}", title=f"Postdoc {n}", institution=f"Inst {n}") for n in range(300)])
    assert store.store(first, ranks(spark), 1).counters().first().inserted == 300
    before = in_force(store)
    batch = [row("a", f"old{n}", title=f"Changed {n}", institution=f"Inst {n}") for n in range(5)] + [row("b", f"new{n}", title=f"Fresh {n}", institution=f"New {n}") for n in range(5)]
    done = store.store(frame(spark, batch), ranks(spark), 2)
    assert done.counters().first().asDict() == dict(inserted=5, updated=5, unchanged=0, duplicates_merged=0)
    after = in_force(store)
    for name in ("jobs", "observations"):
        assert sum(b == 2 for (n, _), b in after.items() if n == name) <= 10
    assert sum(b == 2 for (n, _), b in after.items() if n == "keys") <= 10 * 2 * 9
    assert {k: v for k, v in before.items() if after[k] == 1}.items() <= after.items()
    # again, and after a try that wrote its files but did not end
    assert store.store(frame(spark, batch), ranks(spark), 2) is None and in_force(store) == after
    store._write("jobs", store.read("jobs").limit(3), 9)
    assert in_force(store) == after and store.read("jobs").count() == 305
    jobs, seen = store.read("jobs"), store.read("observations")
    kept = store.read("keys").select("high", "low", "job_id")
    made = stored_keys(jobs, seen).select("high", "low", "job_id").distinct()
    assert kept.exceptAll(made).isEmpty() and made.exceptAll(kept).isEmpty()


def test_batches_equal_one_by_one(spark, tmp_path):
    rnd = random.Random(11)
    store, model = Store(spark, str(tmp_path), buckets=8, spread=3), Model()

    def some(s):
        n = rnd.randrange(5)
        url = URL[s] + str(n)
        return row(
            s, f"{s}{n}", url=url, title=f"Postdoc {n} {rnd.randrange(2)}", institution=rnd.choice([f"Inst {n}", "See original source"]),
            apply_url=f"https://apply.org/jobs/{n}" if n % 2 else url, source_type=rnd.choice(["rss", "html"]), tags=[rnd.choice("pqr")],
        )

    total = dict.fromkeys(model.count, 0)
    for number, source in enumerate("bcab", 1):
        batch = [some(source) for _ in range(25)]
        for r in batch:
            model.store(r)
        for k, v in store.store(frame(spark, batch), ranks(spark), number).counters().first().asDict().items():
            total[k] += v
    assert total == model.count
    blank = lambda v: None if v == "" else v
    compared = [*HASHED, "source_key", "source_item_id", "source_url", "source_type"]
    assert {r.id: {c: blank(r[c]) for c in compared} for r in store.read("jobs").collect()} == {k: {c: blank(j[c]) for c in compared} for k, j in model.jobs.items()}
    seen = store.read("observations")
    assert {(r.source_key, r.source_item_id): r.job_id for r in seen.collect()} == model.seen
    assert seen.groupBy("job_id").agg(F.count_if("is_primary").alias("n")).where("n <> 1").isEmpty()


def test_empty_batch_and_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    assert store.read("jobs").isEmpty() and store.batches() == []
    none = frame(spark, [row("a", "x")]).limit(0)
    assert store.store(none, ranks(spark), 1).counters().first().inserted == 0
    assert store.read("jobs").isEmpty()
