import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from postlake.llm import sharding

ROWS = [(n, f"text {n % 7}") for n in range(3000)] + [(None, "a"), (None, "a"), (None, None), (5000, None), (5001, ""), (5002, "\U0001f600"), (17, "text 3"), (17, "text 3")]


def descend(node, key):
    while node.children:
        draws = []
        for n, c in enumerate(node.children):
            bits = int(hashlib.md5(f"{c.name}|{key}".encode()).hexdigest()[:13], 16)
            draws.append((-math.log((bits + 0.5) / 16**13) / c.weight, n))
        node = node.children[min(draws)[1]] if len(node.children) > 1 else node.children[0]
    return node.shard


def test_against_plain_python(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, "o") for i, t in ROWS], "doc_id long, text string, shard int, slot int, own string").repartition(3)
    root = sharding.tree()
    got = sharding.digest(sharding.assign(docs, root, rows_per_chunk=50)).collect()
    assert len(got) == len(ROWS)
    texts = defaultdict(set)
    for i, t in ROWS:
        texts[i].add(t)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            (text,) = texts[r.doc_id]
            raw = (text or "").encode()
            assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
            assert r.shard == descend(root, str(r.doc_id))
            assert r.grown_shard == descend(sharding.grown(root), str(r.doc_id))
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) == set(range(16))
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) < 1.5 * len(ROWS) / 16
    assert 0.5 < sum(r.grown_shard == 16 for r in got) / (len(ROWS) / 17) < 1.5


def test_changed_weights_move_only_their_subtree(spark):
    root = sharding.tree()
    region, rack = root.children[1], root.children[1].children[0]
    a, b, *rest = rack.children
    changed = sharding.Node(rack.name, (sharding.Node(a.name, shard=a.shard, own_weight=1.5), sharding.Node(b.name, shard=b.shard, own_weight=0.5), *rest))
    other = sharding.Node(root.name, (root.children[0], sharding.Node(region.name, (changed, *region.children[1:]))))
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    moved = keys.select(sharding.descend(root, F.col("k")).alias("x"), sharding.descend(other, F.col("k")).alias("y")).where("x != y").collect()
    assert moved and {(m.x, m.y) for m in moved} <= {(x, a.shard) for x in (s.shard for s in rack.children)} | {(b.shard, s.shard) for s in rack.children}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.digest(sharding.assign(none, sharding.tree())).count() == 0
