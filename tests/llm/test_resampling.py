import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from postlake.llm import resampling
from tests.llm import brute

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = [(n, " ".join(f"Wort{(n * k) % 41}-é{k % 7}" for k in range(n % 37))) for n in range(300)]
DOCS += [(None, "word " * 25), (None, None), (400, ""), (401, None), (402, "same text " * 15), (402, "same text " * 15)]
DOCS += [(403, "long " * 500_000), (404, " ein wort 日本語 x٣y " * 12), (405, "a" * 3_000_000)]
TARGET = ["wort1 é3 wort2 word", None, "", "Same same text"]


def features(text, ngrams):
    w = WORD.findall(brute.lower(text or ""))
    return Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) for n in range(1, ngrams + 1) for k in range(len(w) - n + 1))


def expected(docs, target, ngrams=1, buckets=10_000, least=20, seed="2024"):
    found = [features(t, ngrams) for _, t in docs]
    s, t = np.zeros(buckets, int).tolist(), np.zeros(buckets, int).tolist()
    for f in found:
        for k, c in f.items():
            s[k % buckets] += c
    for text in target:
        for k, c in features(text, ngrams).items():
            t[k % buckets] += c
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + buckets) / ((s[k] + 1) * (sum(t) + buckets)))) for k in range(buckets)]
    rows = []
    for (i, text), f in zip(docs, found, strict=True):
        n = sum(f.values())
        weight = sum(gain[k % buckets] * c for k, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        words = len(WORD.findall(brute.lower(text or "")))
        rows.append([i, words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: 10 * len(fit) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=repr)


def frames(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in DOCS], "doc_id long, text string, at string, fits int").repartition(4)
    return docs, spark.createDataFrame([(n, t) for n, t in enumerate(TARGET)], "item_id int, text string")


@pytest.mark.parametrize(("ngrams", "buckets"), [(1, 10_000), (2, 97), (3, 10_000)])
def test_against_plain_python(spark, ngrams, buckets):
    docs, target = frames(spark)
    rows = resampling.resample(docs, target, ngrams=ngrams, buckets=buckets).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in rows), key=repr)
    assert got == expected(DOCS, TARGET, ngrams, buckets)


def test_slices_carry_words_over(monkeypatch):
    text = ("Zwei drei-vier, fünf " * 50).encode()
    want = {n: features(text.decode(), n) for n in (1, 2, 3, 4)}
    for size in (1, 7, 64):
        monkeypatch.setattr(resampling, "_SLICE", size)
        for n, w in want.items():
            assert resampling.hashes(text, n) == w


def test_drawn_documents(spark):
    docs, target = frames(spark)
    out = resampling.drawn_documents(docs, target)
    assert out.columns == docs.columns
    ranked = [r[0] for r in expected(DOCS, TARGET) if r[5]]
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted(ranked, key=repr)


def test_empty_tables(spark):
    docs, target = frames(spark)
    assert resampling.resample(docs.limit(0), target).count() == 0 == resampling.drawn_documents(docs.limit(0), target).count()
    got = resampling.resample(docs, target.limit(0)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got), key=repr) == expected(DOCS, [])
