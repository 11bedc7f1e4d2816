import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postlake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = [(n, " ".join(f"Word{(n * k) % 97}, näh" for k in range(n * n % 211))) for n in range(250)]
EDGE = [(None, "no id at all"), (None, None), (400, ""), (401, None), (402, "same text twice"), (402, "same text twice")]
EDGE += [(403, "one long text " * 20_000), (404, " \n\t  spaces  and   odd ones  \x1c end "), (405, "x" * 9_000), (406, "<|endoftext|> as text <|endoftext|>")]


def plain(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def packed(spark, docs, length=2048, **settings):
    """The pieces, after checking that each id lies in one piece and each sequence is gapless."""
    frame = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id long, text string, length int, tail string").repartition(3)
    rows = packing.pack(frame, PATH, length=length, **settings).collect()
    ids = plain([t for _, t in docs])
    want, got = Counter(), Counter()
    for (i, _), x in zip(docs, ids, strict=True):
        want[i, len(x)] += len(x)
    known = defaultdict(list)
    for (i, _), x in zip(docs, ids, strict=True):
        known[i, len(x)].append(np.array(x, "<u4"))
    line = defaultdict(list)
    for r in rows:
        assert r.length > 0 and r.start >= 0
        assert r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in known[r.doc_id, r.doc_tokens]}
        got[r.doc_id, r.doc_tokens] += r.length
        line[r.sequence_id].append((r.offset, r.length))
    assert got == want
    starts = defaultdict(Counter)
    for r in rows:
        starts[r.doc_id, r.doc_tokens].update(range(r.start, r.start + r.length))
    assert all(set(c.values()) == {len(known[k])} for k, c in starts.items())
    for parts in line.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)
    return rows


def test_every_sequence_is_full(spark):
    rows = packed(spark, DOCS + EDGE)
    assert {r.doc_id for r in rows} == {i for i, _ in DOCS + EDGE}


def test_most_tails_stay_whole(spark):
    docs = [(n, "token " * (n * 37 % 190)) for n in range(4_000)]
    rows = packed(spark, docs, length=256, unit=4)
    cut_up = {r.doc_id for r in rows if r.length < r.doc_tokens}
    assert len(cut_up) < 0.06 * len(docs)


def test_equal_lengths_that_fit_badly(spark):
    """Two thirds of a sequence each: a third of all tokens must be cut to fill gaps."""
    rows = packed(spark, [(n, "token " * 170) for n in range(300)], length=256, unit=4)
    assert len({r.sequence_id for r in rows}) <= 300 * 171 // 256 + 9


def test_copies_of_one_document(spark):
    packed(spark, [(7, "one and the same text " * 9)] * 400 + DOCS[:40], length=128, unit=2)


def test_few_and_no_documents(spark):
    assert packed(spark, []) == []
    assert len(packed(spark, [(1, None)])) == 1
    assert len(packed(spark, [(1, "token" + " token" * 2046)])) == 1


def test_real_sequences(spark):
    docs = spark.createDataFrame(DOCS + EDGE, "doc_id long, text string")
    pieces = packing.pack(docs, PATH)
    laid = {r.sequence_id: r.ids for r in packing.sequences(docs, pieces, PATH).collect()}
    ids = plain([t for _, t in DOCS + EDGE])
    assert sum(map(len, laid.values())) == sum(map(len, ids))
    for r in pieces.collect():
        part = np.array(laid[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32


@pytest.mark.parametrize("seed", range(6))
def test_patterns(seed):
    random = np.random.default_rng(seed)
    demand = random.integers(0, [3, 50, 1_000_000][seed % 3], 64)
    demand[random.integers(0, 64, 20)] = 0
    patterns = packing.rounded(demand, 64)
    held = sum((p * n for p, n in patterns), np.zeros(64, int))
    assert (held == demand).all()
    assert all(p @ np.arange(1, 65) <= 64 for p, _ in patterns)
    program = sum(n for _, n in packing.solve(demand, 64))
    used, least = sum(n for _, n in patterns), demand @ np.arange(1, 65) / 64
    assert least - 1e-3 * least <= program <= used + 1e-3 * used and used <= program + 64


def test_knapsack_against_all_patterns():
    value = np.array([0.2, 0.45, 0.5, 0.95])
    best = max((a, b, c, d) for a in range(8) for b in range(4) for c in range(3) for d in range(2) if a + 2 * b + 3 * c + 4 * d <= 7 and abs(np.dot((a, b, c, d), value) - max(np.dot((w, x, y, z), value) for w in range(8) for x in range(4) for y in range(3) for z in range(2) if w + 2 * x + 3 * y + 4 * z <= 7)) < 1e-9)
    got = packing.best_pattern(np.concatenate([value, np.zeros(3)]), 7)
    assert abs(np.dot(got[:4], value) - np.dot(best, value)) < 1e-9


def test_ids_do_not_depend_on_slices(monkeypatch):
    texts = [t for _, t in EDGE] + ["a  b", " a b ", "it's 'n b's\n\nx  \n y", "日本 語 é́ \U0001f600 x", "tab\t x\u0085 y\x1f z"]
    want = [np.array(x[:-1], "<u4").tobytes() for x in plain(texts)]
    for size in (1 << 20, 5):
        monkeypatch.setattr(packing, "_SLICE", size)
        known = packing.Ids(PATH)
        assert known.of([t or "" for t in texts]) == want == [known.of([t or ""])[0] for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["word", "Öl", " ", "  ", "\n", ".", ",", "'", "'s", "1", "²", "-", "\t", "é", "ñ", "×", "日", "ǅ", "\u00a0", "\x1c", "e\u0301"]), max_size=14).map("".join))
def test_chunks_end_where_tokens_do(text):
    assert packing._ids(PATH).of([text])[0] == np.array(plain([text])[0][:-1], "<u4").tobytes()


def test_a_chunk_is_encoded_when_it_is_first_met(monkeypatch):
    known, asked = packing.Ids(PATH), []
    encode = known._of_chunk
    monkeypatch.setattr(known.known, "encode", lambda c: asked.append(c) or encode(c))
    texts = ["one two, one two, one", "two one two " + "x" * 41 + " " + "x" * 41]
    want = [known.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in known.of(texts)] == want
    assert sorted(c for c in asked if len(c) < 40) == sorted({c for t in texts for c in known.chunk.findall(t) if len(c) < 40})
    assert max(map(len, known.known)) < 40  # long ones are not kept
    monkeypatch.setattr(packing, "_KNOWN", 0)
    again = list(asked)
    assert [np.frombuffer(x, "<u4").tolist() for x in known.of(texts)] == want
    assert [c for c in asked[len(again) :] if len(c) < 40] == []  # what was seen before is taken over
