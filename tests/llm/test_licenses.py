import math

from postlake.llm import licenses
from tests.llm import brute

ODD = [
    (1, None),
    (2, ""),
    (3, "?!"),
    (4, "MIT License, mit-license;mit\nlicense. Apache\x7fLicense apache licenses"),
    (5, "the GENERAL public license general public license"),
    (6, "É MIT license ümit license \U0001f600 license"),
    (None, "Licensed under the\nApache License, Version 2.0."),
    (7, "x\n" * 30_000 + "This work is licensed under the GNU General Public License, version 3."),
    (8, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0."),
    (8, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0."),
    (9, "redistribution and use in source and binary forms with or without modification are"),
]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "k", 1, [2]) for i, t in ODD], "doc_id long, text string, key string, words int, labels array<int>")
    got = licenses.digest(licenses.find_licenses(docs)).collect()
    assert len(got) == len(ODD)
    for doc_id, text in ODD:
        want = brute.licenses(text)
        for r in got:
            if r.doc_id == doc_id:
                assert {k: r[k] for k in want} == want, doc_id
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].labels == "apache" and by_id[None].score == 1.0
    assert by_id[7].labels == "gpl" and by_id[8].labels == "cc-by,cc-by-nc" and by_id[9].labels == "bsd"
    assert by_id[8].base_labels == "" and by_id[9].score < 1.0
    assert by_id[3].score == 0.0 and by_id[3].n_words == 0


def test_join_is_exact(spark):
    words = "licensed under the apache license version two public gnu x y z".split()
    import random

    random_ = random.Random(1)
    docs = [(n, "\n".join(" ".join(random_.choices(words, k=random_.randrange(0, 9))) for _ in range(6))) for n in range(120)]
    templates = (("a", "licensed under the apache license version two"), ("b", "gnu public license"), ("c", "x y z x y"))
    frame = spark.createDataFrame(docs, "key long, text string")
    for threshold in (0.5, 0.8, 1.0):
        got = {(r.key, r.block, r.label): round(r.score, 9) for r in licenses.matches(frame, templates, threshold).collect()}
        want = {}
        for key, text in docs:
            lines = text.split("\n")
            for b, line in enumerate(lines):
                have = set(licenses.words_of(" ".join(lines[b : b + 2])))
                for label, t in templates:
                    t = set(licenses.words_of(t))
                    if len(have & t) >= math.ceil(threshold * len(t) - 1e-9):
                        want[key, b, label] = round(len(have & t) / len(t), 9)
        assert got == want


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in licenses.digest(licenses.find_licenses(docs)).collect()}
    for r in docs.collect():
        want = brute.licenses(r.text)
        assert {k: got[r.doc_id][k] for k in want} == want


def test_empty_table(spark):
    assert licenses.digest(licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def _wrap(text, lines, marker, between):
    w = text.split()
    cuts = [round(k * len(w) / lines) for k in range(lines + 1)]
    return f"\n{between}".join(marker + " ".join(w[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def test_wrapped_notices(spark):
    prose = "\n\nEin Satz aus Prosa, der nichts sagt.\n\n"
    docs, want = [], {}
    for n, (label, text) in enumerate(licenses.TEMPLATES):
        for lines in range(3, 9):
            for k, (marker, between) in enumerate((("", ""), (" * ", " *\n"), ("REM ", "REM\n"), ("", "\n\n"))):
                if len(text.split()) >= lines:
                    docs.append((1000 * n + 10 * lines + k, prose * 2 + _wrap(text, lines, marker, between) + prose))
                    want[docs[-1][0]] = ",".join(sorted({label, *brute.licenses(docs[-1][1])["base_labels"].split(",")} - {""}))
    # one of two notices lies in the other's block but not in its place
    docs.append((-1, "Licensed under CC BY 4.0.\n\nLicensed under\nCC BY-NC\n4.0."))
    want[-1] = "cc-by,cc-by-nc"
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.digest(licenses.find_licenses(frame)).collect()}
    assert got == {k: (v, 1.0) for k, v in want.items()}


def test_windows_are_exact(spark):
    import random

    words = "licensed under the apache license version two public gnu x y z q r s t".split()
    random_ = random.Random(2)
    docs = [(n, "\n".join(" ".join(random_.choices(words, k=random_.randrange(0, 4))) for _ in range(20))) for n in range(150)]
    templates = (("a", "licensed under the apache license version two"), ("b", "gnu public license two"), ("c", "x y z q r s"))
    frame = spark.createDataFrame(docs, "key long, text string")
    reach = 14
    for threshold in (0.8, 1.0):
        got = {(r.key, r.label) for r in licenses.matches(frame, templates, threshold).collect()}
        wide = licenses.wrapped(frame, templates, threshold).collect()
        want, wrapped = set(), 0
        for key, text in docs:
            lines = text.split("\n")
            blocks = [" ".join(lines[b : b + 2]).split() for b in range(len(lines))]
            blocks += [text.split()[k : k + reach] for k in range(len(text.split()))]
            for label, t in templates:
                t = set(t.split())
                if any(len(set(b) & t) >= math.ceil(threshold * len(t) - 1e-9) for b in blocks):
                    want.add((key, label))
        assert got | {(r.key, r.label) for r in wide} == want and got < want
        text = dict(docs)
        for r in wide:
            held = set(text[r.key].split()[r.start : r.end + 1]) & set(dict(templates)[r.label].split())
            assert round(len(held) / len(set(dict(templates)[r.label].split())), 9) == round(r.score, 9) and r.last - r.first > 1
