import math

import numpy as np

from postlake.llm import vptree


def brute(rows, k, every):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            sound[i] = min(sound.get(i, v), v)
    out = {}
    for q, a in sound.items():
        if q % every == 0:
            scores = []
            for i, b in sound.items():
                if i != q and len(a) == len(b):
                    s = 0.0
                    for x, y in zip(a, b):
                        s += x * y
                    scores.append((-s, i))
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return {q: v for q, v in out.items() if v}


def test_factor_one_is_exact(spark):
    random_ = np.random.default_rng(4)
    rows = [(n, [float(x) for x in np.float32(random_.normal(size=8) * random_.choice([0.1, 1, 5]))]) for n in range(900)]
    rows += [(n, rows[3][1]) for n in range(1000, 1060)]  # ties
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [float("nan")] * 8), (2080, [1.0, None] + [0.0] * 6), (2100, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(2120, [1.0, 2.0]), (2140, [2.0, 1.0]), (20, rows[20][1]), (40, [9.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, shard int, rank int")
    got = {}
    for r in vptree.nearest(frame, k=20, every=20, factor=1.0, rows_per_shard=300, queries_per_block=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 20, 20)
    assert {q: sorted(v) for q, v in got.items()} == want


def test_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in frame.collect()], 20, 20)
    got = {}
    for r in vptree.nearest(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for _, i, _ in v}) for q, v in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_larger_factor_skips_more():
    random_ = np.random.default_rng(6)
    points = random_.normal(size=(3000, 4))
    queries = random_.normal(size=(50, 4))
    exact = [set(np.argsort(-(points @ q))[:20]) for q in queries]
    recall = []
    for factor in (1.0, 1.2, 50.0):
        found = vptree.VantagePointTree(points).nearest(queries, 20, factor)
        recall.append(np.mean([len(set(f) & e) / 20 for f, e in zip(found, exact)]))
    assert recall[0] == 1.0 and recall[0] >= recall[1] >= recall[2]
    assert recall[2] < 1.0


def test_empty_table(spark):
    assert vptree.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
