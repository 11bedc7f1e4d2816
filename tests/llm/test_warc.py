import gzip
import hashlib
import io
import os
import random
from collections import defaultdict

import pytest

from postlake.llm import warc

BIG = "".join(random.Random(1).choices("abcdefghijé <>\r\n", k=700_000))
ROWS = [(1, "u", None), (2, None, ""), (3, "http://x/é", "<p>a\r\n\r\nb</p>"), (4, "u", "y" * 1000), (5, "u", "y" * 1000), (6, "u", "y" * 999), (7, "u", "y" * 999), (8, "u", BIG), (9, "u", BIG), (10, "u\r\nX: 1", "z" * warc.CHUNK), (None, "u", "q" * 2000), (None, "u", "y" * 1000), (11, "u", "r" * 1500), (11, "u", "r" * 1500)]


def frame(spark):
    return spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in ROWS], "page_id long, url string, html string, digest string, chunk int").repartition(3)


def test_round_trip(spark):
    got = sorted((tuple(r) for r in warc.round_trip(frame(spark)).collect()), key=repr)
    by = defaultdict(list)
    for i, _, h in ROWS:
        if i is not None:
            by[h or ""].append(i)
    want = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        first = max(by[h or ""], default=None) if len(raw) >= 1000 else None
        again = first is not None and first != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)


def test_bodies_come_back(spark, tmp_path):
    archives = warc.write_archives(warc.records(frame(spark)), f"file://{tmp_path}/a", 2)
    archives = spark.createDataFrame(archives.collect(), archives.schema)
    rows = warc.read_archives(archives).collect()
    bodies = defaultdict(bytes)
    for r in sorted((r for r in rows if r.record_type == "response" and r.page_id in (3, 9, 10)), key=lambda r: (r.page_id, r.chunk)):
        bodies[r.page_id] += r.body
        assert len(r.body) <= warc.CHUNK and hashlib.sha1(bodies[r.page_id]).hexdigest() == r.digest
    texts = {i: h for i, _, h in ROWS}
    assert {i: b.decode() for i, b in bodies.items()} == {i: texts[i] for i in (3, 9, 10)}
    assert {r.url for r in rows if r.page_id == 3} == {"http://x/é"}
    name = max(os.listdir(tmp_path / "a"), key=lambda f: os.path.getsize(tmp_path / "a" / f))
    raw = gzip.decompress((tmp_path / "a" / name).read_bytes())
    assert raw.startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(gzip.compress(raw[:-9]))))


def test_empty_table(spark):
    assert warc.round_trip(frame(spark).where("page_id = 99")).count() == 0
