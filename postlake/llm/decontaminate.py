"""Benchmark decontamination by SimHash windows.

A window of an item's length slides over each document word by word. Windows and items get 64-bit
SimHash fingerprints: every five-word shingle, weighted by how often it stands there, votes on each
bit. Fingerprints within ``RADIUS`` bits are found by multi-index blocks: of eight blocks of eight
bits, two fingerprints within the radius differ in at most ``RADIUS // 8`` bits in at least one, so
tables of all block values that near an item's miss none. Two sets of similarity 0.8 differ in 10
bits on average, with a deviation of 3. Candidates are verified by the exact weighted similarity:
the sum of the smaller counts over the sum of the larger counts of all shingles, 0.8 or more.

A window that shares no shingle with an item has similarity 0 with it. Windows are therefore laid
only where a document has a shingle of some item, which is a lookup for each of its shingles; this
loses nothing.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item with fewer than
five words is one shingle. The benchmark is the stated query set: it is read in blocks of a bounded
number of items, and each block is one pass over all documents.

Cases: a NULL text or one without words matches nothing, as item or as document; a NULL doc_id or
item_id is carried along; repeated rows each get their own matches; of equally good windows the
first counts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import ALPHANUMERIC, distinct, mix, rolling, whole, word_hashes

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 23  # the most that blocks of two bits apart guarantee
#: Items that one pass over the documents looks for.
ITEMS_AT_ONCE = 5_000
_BLOCKS = 8
_FILTER_BITS = 20


def votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each shingle hash."""
    bits = np.unpackbits(mix(shingles ^ np.uint64(0x9E6C63D0876A9A35)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def window_fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint, as eight bytes, of every run of ``size`` shingles."""
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(votes(shingles), axis=0, out=sums[1:])
    return np.packbits(sums[size:] - sums[:-size] > 0, axis=1)


def _near_bytes(most: int) -> np.ndarray:
    """near[a, b]: bytes a and b differ in at most ``most`` bits."""
    values = np.arange(256, dtype=np.uint8)
    return np.bitwise_count(values[:, None] ^ values[None, :]) <= most


class Index:
    """The items of one block: their shingles, and tables of near block values by window length."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = []
        by_size: dict[int, list[int]] = {}
        owners: dict[int, set[int]] = {}
        for item_id, text in items:
            words = word_hashes(text, ALPHANUMERIC)
            if len(words) == 0:
                continue
            s = rolling(words, WIDTH)
            n = len(self.items)
            self.items.append((item_id, len(words), Counter(s.tolist())))
            width = min(WIDTH, len(words))
            by_size.setdefault((width, len(s)), []).append(n)
            for x in set(s.tolist()):
                owners.setdefault(x, set()).add(n)
        self.owners = owners
        self.widths = sorted({w for w, _ in by_size})
        self.known = np.array(sorted(owners), dtype=np.uint64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.known & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        near = _near_bytes(RADIUS // _BLOCKS)
        self.groups = {}
        for size, members in by_size.items():
            prints = np.array([self._print(n) for n in members], np.uint8).reshape(-1, _BLOCKS)
            tables = [near[:, prints[:, b]] for b in range(_BLOCKS)]
            self.groups[size] = (np.array(members), prints, tables)
        self.group_of = {n: size for size, members in by_size.items() for n in members}

    def _print(self, n: int) -> np.ndarray:
        counts = self.items[n][2]
        s = np.array(list(counts.elements()), dtype=np.uint64)
        return np.packbits(votes(s).sum(axis=0) > 0)

    def matches(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window for each item found."""
        words = word_hashes(text, ALPHANUMERIC)
        best: dict[int, tuple[float, int]] = {}
        for width in self.widths:
            if len(words) < width:
                continue
            s = rolling(words, width)
            at = np.flatnonzero(self.filter[(s & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            near = np.searchsorted(self.known, s[at])
            at = at[self.known[np.minimum(near, len(self.known) - 1)] == s[at]]
            places: dict[int, list[int]] = {}
            for p in at.tolist():
                for n in self.owners[int(s[p])]:
                    if self.group_of[n][0] == width:
                        places.setdefault(n, []).append(p)
            for size, found in itertools.groupby(sorted(places, key=self.group_of.__getitem__), self.group_of.__getitem__):
                self._search(s, size, {n: places[n] for n in found}, best)
        return [(self.items[n][0], j, start, self.items[n][1]) for n, (j, start) in sorted(best.items())]

    def _search(self, s: np.ndarray, size: tuple[int, int], places: dict[int, list[int]], best: dict) -> None:
        length = size[1]
        if len(s) < length:  # the document is shorter than the item: it is the only window
            for n in places:
                self._verify(s, n, 0, best)
            return
        members, prints, tables = self.groups[size]
        sharing = np.isin(members, list(places))  # the others have similarity 0
        starts = distinct(np.concatenate([np.array(p) for p in places.values()]))
        low = np.maximum(starts - length + 1, 0)
        high = np.minimum(starts, len(s) - length)
        for first, last in _ranges(low, high):
            bytes_ = window_fingerprints(s[first : last + length], length)
            near = reduce(np.logical_or, [t[bytes_[:, b]] for b, t in enumerate(tables)])
            rows, cols = np.nonzero(near)
            apart = np.bitwise_count(bytes_[rows] ^ prints[cols]).sum(axis=1)
            near = (apart <= RADIUS) & sharing[cols]
            for r, c in zip(rows[near].tolist(), cols[near].tolist(), strict=True):
                self._verify(s, int(members[c]), first + r, best)

    def _verify(self, s: np.ndarray, n: int, start: int, best: dict) -> None:
        want = self.items[n][2]
        have = Counter(s[start : start + want.total()].tolist())
        j = (want & have).total() / (want | have).total()
        if j >= SIMILARITY and (n not in best or j > best[n][0]):
            best[n] = (j, start)


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """The union of sorted ranges of window starts."""
    first, last = int(low[0]), int(high[0])
    for a, b in zip(low[1:].tolist(), high[1:].tolist(), strict=True):
        if a > last + 1:
            if first <= last:
                yield first, last
            first = a
        last = max(last, b)
    if first <= last:
        yield first, last


_INDEX: dict[int, Index] = {}


def _index_of(shared) -> Index:
    """The index of a broadcast block, built once in each worker."""
    if shared.id not in _INDEX:
        _INDEX.clear()
        _INDEX[shared.id] = Index(shared.value)
    return _INDEX[shared.id]


class _Block:
    """A broadcast block of items with a name of its own."""

    def __init__(self, spark, number: int, items: list):
        self.id = hash((number, tuple(items)))
        self.shared = spark.sparkContext.broadcast(items)

    @property
    def value(self):
        return self.shared.value


def blocks(benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> Iterator[_Block]:
    """The benchmark (item_id, text) in blocks of a bounded number of items."""
    rows = ((r[0], r[1]) for r in benchmark.select("item_id", "text").toLocalIterator())
    for number, block in enumerate(itertools.batched(rows, at_once)):
        yield _Block(benchmark.sparkSession, number, list(block))


_FOUND = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def leaks(docs: DataFrame, benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each item found in each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))

    def finder(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index_of(block)
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    out += [(doc_id.as_py(), *m) for m in index.matches(text.as_py())]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "item_id", "similarity", "start_word", "n_words"), r, strict=True)) for r in out],
                    schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())]),
                )

        return run

    parts = [texts.mapInArrow(finder(b), _FOUND) for b in blocks(benchmark, at_once)]
    if not parts:
        return docs.sparkSession.createDataFrame([], _FOUND)
    return reduce(DataFrame.union, parts)


def clean(docs: DataFrame, benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item of the benchmark is found."""
    for block in blocks(benchmark, at_once):
        docs = docs.where(~_leaking(block)(whole("text")))
    return docs


def _leaking(block: _Block):
    @F.pandas_udf("boolean")
    def leaking(text: pd.Series) -> pd.Series:
        index = _index_of(block)
        return text.map(lambda t: bool(index.matches(t)))

    return leaking
