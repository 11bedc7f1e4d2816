import random
import re
from collections import Counter

from postlake.llm import decontaminate


def windows(text, item, width=5):
    """The best weighted similarity of all windows of the item's length."""
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    want = re.findall("[0-9a-z\x80-\U0010ffff]+", (item or "").lower())
    if not words or not want:
        return 0.0
    w = min(width, len(want))
    gram = lambda x: [tuple(x[k : k + w]) for k in range(len(x) - w + 1)]
    b, s, best = Counter(gram(want)), gram(words), 0.0
    if not s:
        return 0.0
    for k in range(max(1, len(s) - b.total() + 1)):
        a = Counter(s[k : k + b.total()])
        best = max(best, (a & b).total() / (a | b).total())
    return best


def cases():
    random_ = random.Random(11)
    word = lambda: "".join(random_.choice("abcdefgh") for _ in range(4))
    items = [(n, " ".join(word() for _ in range(random_.choice((14, 20, 36, 59))))) for n in range(30)]
    items += [(100, "only four words here"), (101, ""), (102, None), (103, "..."), (104, items[0][1]), (None, "nobody names this item but it has words enough")]
    docs = []
    for n in range(160):
        words = [word() for _ in range(random_.randrange(0, 120))]
        item = random_.choice(items[:30])[1].split()
        for _ in range(random_.choice((0, 0, 1, 2, 5))):
            item[random_.randrange(len(item))] = word()
        if n % 4 == 3:
            del item[len(item) // 2 :]
        at = random_.randrange(len(words) + 1)
        docs.append((n, " ".join(words[:at] + item + words[at:])))
    docs += [(500, None), (501, ""), (502, "Only FOUR, words: here!"), (None, items[3][1]), (503, "x " * 30_000 + items[5][1]), (503, items[5][1].upper()), (504, items[7][1][: len(items[7][1]) // 2])]
    docs.append((505, "nobody names this item but it has words enough"))
    return docs, items


def test_against_all_windows(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(i, t, 0, "s") for i, t in docs], "doc_id long, text string, item_id int, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for at_once in (5000, 7):
        got = Counter((r.doc_id, r.item_id, round(r.similarity, 6)) for r in decontaminate.leaks(frame, bench, at_once).collect())
        want = Counter((d, i, round(j, 6)) for d, t in docs for i, x in items if (j := windows(t, x)) >= 0.8)
        assert got == want
    clean = decontaminate.clean(frame, bench)
    assert clean.columns == frame.columns
    dirty = [(d, t) for d, t in docs if any(windows(t, x) >= 0.8 for _, x in items)]
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(docs) - Counter(dirty)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.leaks(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert decontaminate.leaks(some, bench).count() == 0
    assert decontaminate.clean(some, bench).count() == 1


def test_windows_far_apart():
    # one word of 49 changed is similarity 0.8; these fingerprints are 21 or 22 bits apart
    for seed in (4597, 7125, 7977, 14538, 15542):
        random_ = random.Random(seed)
        item = [f"w{random_.randrange(10**9)}" for _ in range(49)]
        text = " ".join([*item[:20], "changed", *item[21:]])
        assert decontaminate.Index([(1, " ".join(item))]).matches(f"before it {text} and after") == [(1, 0.8, 2, 49)]
