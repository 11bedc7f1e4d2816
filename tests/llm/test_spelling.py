import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.llm import spelling
from tests.llm import brute


def counted(docs, every=None):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(n):
    near = defaultdict(list)
    for a in n:
        for b in n:
            if one_apart(a, b):
                near[a].append(b)
    form = {}
    for w in n:
        best = min(((-n[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def result(spark, docs, every=None):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    rows = spelling.variants(spelling.word_counts(frame, garble_every=every)).collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


TEXTS = {
    "letters letter lettera lettrs LETTERS Letters ": 30,
    "Éclair éclair eclair éclair Èclair éclairs": 6,
    "abcabc bcabca cabcab abcabd aabbcc ": 5,  # same letters, other order
    "anagram nagaram anagramm anagra anagrams ": 7,
    "x" * 3000 + " " + "x" * 3001 + " ": 5,
    "colour-colour_colour1color2colours ": 40,
    "short words only here and there, numbers 1234567 ": 9,
}


def test_against_all_pairs(spark):
    docs = [(n, t) for n, (t, k) in enumerate(TEXTS.items()) for _ in range(k)]
    docs += [(8, "chaina " * 125 + "chainab " * 25 + "chainabc " * 5), (None, "letters " * 400), (None, None), (5, None), (6, ""), (7, "lettrs " * 60), (7, "lettrs " * 60)]
    want = grouped(counted(docs))
    assert any(v[1] != v[0] for v in want.values() if v[0]) and sum(v[0] is None for v in want.values()) > 5
    assert result(spark, docs) == want
    assert result(spark, docs, every=3) == grouped(counted(docs, 3)) != want


def test_no_words(spark):
    assert result(spark, []) == {} == result(spark, [(1, None), (2, "a b c"), (3, "éé " * 9)])


def test_chain_of_forms(spark):
    words = ["roots" + "abcdefgh"[:k] for k in range(8)]
    table = spark.createDataFrame([(w, 7 * 5 ** (7 - k)) for k, w in enumerate(words)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.variants(table).collect()}
    assert got == {w: (words[k - 1] if k else None, words[0]) for k, w in enumerate(words)}


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", min_size=6, max_size=14), st.integers(0, 13), st.sampled_from("abcdé"), st.sampled_from("idr"))
def test_near_words_share_one_signature(word, at, letter, edit):
    at %= len(word)
    other = {"i": word[:at] + letter + word[at:], "d": word[:at] + word[at + 1 :], "r": word[:at] + letter + word[at + 1 :]}[edit]
    if other == word:
        return
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([word, other]), pa.array([1, 1], pa.int64())], names=["word", "n"])
    rows = [b.to_pydict() for b in spelling._signed(iter([batch]))][0]
    k = len(rows["word"]) // 2
    shared = []
    for a, b in zip(range(k), range(k, 2 * k), strict=True):
        if rows["signature"][a] == rows["signature"][b]:
            x, y = (bin(rows[c][a] ^ rows[c][b]).count("1") for c in ("first", "second"))
            if (x == y == 1) if rows["paired"][a] else x <= 2:
                shared.append(a)
    assert len(shared) == 1
