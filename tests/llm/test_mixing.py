import hashlib
from collections import Counter, defaultdict

import pytest

from postlake.llm import mixing
from tests.llm import brute

ROWS = [(n, f"w{n} " * (n % 13), ["a", "b", "é", None, "hot"][n % 5 if n % 3 else 4]) for n in range(600)]
ROWS += [(None, "x y z", "a"), (None, None, "a"), (700, "", "empty"), (701, None, "empty"), (702, "one two three", "b"), (702, "one two three", "b"), (703, "q " * 3000, "c")]


def frame(spark):
    return spark.createDataFrame([(i, t, s, 1, "k", 9) for i, t, s in ROWS], "doc_id long, text string, source string, size int, key string, n_chars long").repartition(4)


def test_targets():
    assert mixing.targets({"a": 100, "b": 100}) == pytest.approx({"a": 200, "b": 100})
    assert mixing.targets({"a": 10, "b": 100, None: 1000}) == pytest.approx({"a": 20, "b": 200, None: 1445})
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0, "b": 0}) == {"a": 0, "b": 0}


def test_against_one_list(spark):
    got = mixing.mix(frame(spark), rows_per_range=20).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in ROWS)
    size = lambda t: len(brute.words(t))
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += size(t)
    target = mixing.targets(sizes)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = Counter()
    for source in sizes:
        own = [(md5("|".join(["mix", *([str(i)] if i is not None else []), md5(t) if t is not None else ""])), i, t) for i, t, s in ROWS if s == source]
        own.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        budget, before = int(target[source]), 0
        epochs = budget // sizes[source] if sizes[source] else 0
        for _, i, t in own:
            n = size(t)
            last = max(0, min(n, budget - epochs * sizes[source] - before))
            want[i, source, n, sizes[source], round(target[source], 6), epochs * n + last] += 1
            before += n
    assert Counter((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
    for source in sizes:
        assert sum(r.taken for r in got if r.source == source) == int(target[source])
    assert all(r.taken <= 2 * r.size for r in got)


def test_documents_of_the_mix(spark):
    docs = frame(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id, r.source] += len(brute.words(r.text))
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(words)


def test_equal_rows_lose_no_words(spark):
    rows = [(1, "one two three four five", "a")] * 7 + [(n, "x " * 20, "b") for n in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.3, 0.77, 1.5):
        words, want = Counter(), Counter()
        for r in mixing.mixed_documents(docs, share=share).collect():
            words[r.doc_id] += len(brute.words(r.text))
        for r in mixing.mix(docs, share=share).collect():
            want[r.doc_id] += r.taken
        assert +want == words


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
