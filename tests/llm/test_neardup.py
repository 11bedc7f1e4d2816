import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from postlake.llm import neardup
from postlake.llm.components import _hung, components
from tests.llm import brute


def test_signatures_estimate_jaccard():
    random_ = np.random.default_rng(3)
    for n, shared in ((400, 320), (40, 30), (3, 2)):
        pool = random_.integers(0, 2**63, 2 * n - shared, dtype=np.int64).astype(np.uint64)
        a, b = neardup.signatures([np.unique(pool[:n]), np.unique(pool[n - shared :])])
        want = shared / (2 * n - shared)
        assert abs((a == b).mean() - want) < 0.12
        assert (a < np.uint64(2**64 - 1)).all()


def test_long_sets_in_pieces():
    items = np.unique(np.random.default_rng(1).integers(0, 2**63, 150_000, dtype=np.int64).astype(np.uint64))
    one = neardup.signatures([items])
    parts = neardup.signatures([items[:70_000], items[70_000:]])
    assert (one[0] == parts.min(axis=0)).all()


def edited(words, edits, random_):
    out = list(words)
    for _ in range(edits):
        out[random_.randrange(len(out))] = f"w{random_.random()}"
    return " ".join(out)


def hard_cases():
    random_ = random.Random(5)
    base = [f"b{random_.randrange(400)}" for _ in range(160)]
    texts = [edited(base, random_.randrange(0, 6), random_) for _ in range(150)]
    chain = [f"c{n}" for n in range(120)]
    for n in range(0, 60, 4):  # each close to the next, the ends far apart
        texts.append(" ".join(chain[n : n + 60]))
    passage = " ".join(f"p{n}" for n in range(60))
    texts += [passage + " " + edited(["x"] * 60, 60, random_) for _ in range(60)]
    texts += [None, "", " \t\n", "One", "one", "ONE two three", "one TWO three", "\u00c9t\u00e9 \u00e9", "\u00e9t\u00e9 \u00e9"]
    texts += [texts[0]] * 40
    return texts


def test_against_all_pairs(spark):
    texts = dict(enumerate(hard_cases()))
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in texts.items()], "doc_id long, text string, id int, bands string").repartition(5)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    want = brute.near_duplicates(texts)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(brute.shingles(t, 4)) for i, t in texts.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_null_and_repeated_ids(spark):
    long = "a b c d e f g h"
    rows = [(None, long, "x"), (1, long, "y"), (1, long, "y"), (2, long, "z"), (3, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 3, True), (True, 0, None, True)]
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.source) for r in kept.collect()) == [(0, "x"), (1, "y"), (3, "n")]


def test_unrelated_texts_of_one_id(spark):
    a, b, c = "a b c d e f g h", "k l m n o p q r", "s t u v w x y z"
    for rows, kept, named in (
        ([(1, a), (1, b), (2, c), (3, a)], [(1, a), (1, b), (2, c)], {(1, 1, True): 2, (2, 2, True): 1, (3, 1, False): 1}),
        ([(5, a), (5, b), (2, a)], [(2, a), (5, b)], {(2, 2, True): 1, (5, 2, False): 1, (5, 5, True): 1}),
        ([(7, a), (7, b), (7, a), (-3, b), (None, a), (None, a)], [(-3, b), (7, a), (None, a), (None, a)], {(7, 7, True): 2, (7, -3, False): 1, (-3, -3, True): 1, (None, None, True): 2}),
        ([(4, a)] * 300 + [(4, c), (9, None), (9, "")], [(4, a), (4, c), (9, ""), (9, None)], None),
    ):
        docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, n int").repartition(3)
        got = sorted(((r.doc_id, r.text) for r in neardup.without_near_duplicates(docs).collect()), key=repr)
        if rows[-1] == (9, ""):  # NULL and empty are one text
            assert got[:2] == [(4, a), (4, c)] and len(got) == 3
        else:
            assert got == sorted(kept, key=repr)
        if named:
            assert Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()) == named


def test_small_sets_share_a_key():
    random_ = np.random.default_rng(8)
    lost = near = 0
    for _ in range(4_000):
        union = int(random_.integers(1, 32))
        pool = random_.integers(0, 2**63, union, dtype=np.int64).astype(np.uint64)
        apart = int(random_.integers(0, union // 5 + 1))
        left = int(random_.integers(0, apart + 1))
        sets = [np.sort(pool[left:]), np.sort(np.concatenate([pool[:left], pool[apart:]]))]
        if min(map(len, sets)) == 0 or min(map(len, sets)) >= neardup.SMALL:
            continue
        shared = len(np.intersect1d(*sets))
        if 100 * shared >= 80 * (len(sets[0]) + len(sets[1]) - shared):
            near += 1
            keys = neardup.keys_of(sets, neardup.signatures(sets), 80)
            lost += not set(keys[0][keys[0] != 0]) & set(keys[1][keys[1] != 0])
    assert near > 1_500 and lost == 0


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    random_ = random.Random(2)
    edges = [(n, n + 1) for n in range(0, 90)] + [(1000, n) for n in range(1001, 1300)] + [(random_.randrange(2000, 2400), random_.randrange(2000, 2400)) for _ in range(250)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_flat_trees_take_no_round(spark, monkeypatch):
    rounds, hung = [], _hung
    monkeypatch.setattr("postlake.llm.components._hung", lambda edges, large: rounds.append(large) or hung(edges, large))
    star = [(n, 0) for n in range(1, 50)]
    found = components(spark.createDataFrame(star, "a long, b long").coalesce(1))
    assert {tuple(r) for r in found.collect()} == {(n, 0) for n in range(50)}
    assert rounds == []
    found = components(spark.createDataFrame([*star, (0, -1), (70, 60), (70, 65)], "a long, b long").repartition(9))
    assert {tuple(r) for r in found.collect()} == {(n, -1) for n in range(-1, 50)} | {(n, 60) for n in (60, 65, 70)}
    assert rounds
