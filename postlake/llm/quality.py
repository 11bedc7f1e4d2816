"""Quality scores by a factorisation machine.

A text is a sparse vector: hashed words by the root of their share, and one entry for the range that
each structure statistic and the recorded length fall in. The machine adds a weight for each entry
and, for each pair of entries, the product of two low-rank vectors; all pairs together are half of
(sum of the vectors)^2 - (sum of their squares), so a score costs no more than the entries. It is
fitted on the driver on at most ``TRAIN_ROWS`` labelled rows, the first in the order of a hash of the
doc_id; every row is scored, in batches on the executors.

Learned are only rows whose crc32(doc_id) mod 5 is not 0 and whose label is not NULL. Labels,
language, source and doc_id are never inputs of a score.

Cases: a NULL text is an empty one, and an empty text has a score from its structure alone; a NULL
doc_id counts as held out; repeated labels of one doc_id: the larger counts; repeated rows score
alike; other columns are ignored; without any label every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import whole

TRAIN_ROWS = 6_000
BUCKETS = 1 << 16
RANK = 8
#: Passes over the rows, and steps of 64 rows that few rows are at least given.
EPOCHS, STEPS = 8, 600
THRESHOLD = 0.3
FOLDS = 5

#: Byte classes: other, lower, upper, digit, space, line end, punctuation, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 7 if _b > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _b > 32 else 0
_SHARE = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8])
_COUNT = np.array([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384])
_WIDTH = np.array([1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 6, 7, 9, 12, 20])
_RANGES = 16
#: Statistics, each with the bounds of its ranges.
STATISTICS = (
    ("words", _COUNT), ("lines", _COUNT), ("words_per_line", _COUNT), ("word_length", _WIDTH), ("distinct", _SHARE),
    ("upper", _SHARE), ("digits", _SHARE), ("punctuation", _SHARE), ("spaces", _SHARE), ("beyond_ascii", _SHARE),
    ("repeated_lines", _SHARE), ("commonest_word", _SHARE), ("bare_punctuation", _SHARE), ("stuttered", _SHARE), ("marked_words", _SHARE), ("recorded_length", _COUNT),
)
SIZE = BUCKETS + _RANGES * len(STATISTICS)


class _Buckets(dict):
    """A word's bucket << 2, with bit 1 set for bare punctuation and bit 0 for a trailing run of marks."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        bare = not word.strip(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\")
        marked = len(word) > 2 and word[-1] == word[-2] and word[-1:] in b"!#$%&*?~="
        value = self[word] = (xxhash.xxh64_intdigest(word, 17) % BUCKETS) << 2 | bare << 1 | marked
        return value


def features(text: str | None, n_chars: int | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a text: their places and values."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / max(1, len(raw))
    words = raw.lower().split()
    n = len(words)
    known = np.array([buckets[w] for w in words], np.int64)
    places, counts = np.unique(known >> 2, return_counts=True)
    lines = [x for x in raw.split(b"\n") if x]
    values = (
        n, len(lines), n / max(1, len(lines)), sum(map(len, words)) / max(1, n), len(places) / max(1, n),
        kinds[2], kinds[3], kinds[6], kinds[4] + kinds[5], kinds[7],
        1 - len(set(lines)) / max(1, len(lines)), counts.max(initial=0) / max(1, n), int((known >> 1 & 1).sum()) / max(1, n), int((known[1:] == known[:-1]).sum()) / max(1, n), int((known & 1).sum()) / max(1, n), n_chars or 0,
    )
    ranges = [BUCKETS + k * _RANGES + int(np.searchsorted(bounds, v, "right")) for k, ((_, bounds), v) in enumerate(zip(STATISTICS, values, strict=True))]
    weight = np.sqrt(counts / max(1, n))
    return np.concatenate([places, ranges]), np.concatenate([weight, np.full(len(ranges), 0.5)])


@dataclass
class Machine:
    """``bias + w.x + sum over pairs of <v_i, v_j> x_i x_j``."""

    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    def parts(self, places, values, starts):
        v = self.vectors[places] * values[:, None]
        sums = np.add.reduceat(v, starts, axis=0)
        squares = np.add.reduceat((v * v).sum(axis=1), starts)
        linear = np.add.reduceat(self.weight[places] * values, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums, v

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        starts = np.cumsum([0, *[len(p) for p, _ in rows[:-1]]])
        raw, _, _ = self.parts(np.concatenate([p for p, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, steps: int = STEPS, rank: int = RANK, seed: int = 1) -> Machine:
    """Log loss by stochastic gradients whose steps shrink with what each place has moved."""
    random = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SIZE), random.normal(0, 0.01, (SIZE, rank)))
    if not rows:
        return Machine(0.0, machine.weight, np.zeros((SIZE, rank)))
    share = np.clip(labels.mean(), 0.01, 0.99)
    machine.bias = float(np.log(share / (1 - share)))
    moved_w, moved_v = np.full(SIZE, 1e-3), np.full((SIZE, rank), 1e-3)
    for _ in range(max(epochs, -(-64 * steps // len(rows)))):
        order = random.permutation(len(rows))
        for k in range(0, len(order), 64):
            chosen = order[k : k + 64]
            sizes = [len(rows[i][0]) for i in chosen]
            starts = np.cumsum([0, *sizes[:-1]])
            places, values = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
            raw, sums, v = machine.parts(places, values, starts)
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]
            each = np.repeat(error / len(chosen), sizes)
            d_w = each * values
            d_v = (each * values)[:, None] * (np.repeat(sums, sizes, axis=0) - v)
            at, of = np.unique(places, return_inverse=True)
            g_w = np.bincount(of, d_w, len(at)) + 1e-5 * machine.weight[at]
            g_v = np.stack([np.bincount(of, d_v[:, r], len(at)) for r in range(rank)], axis=1) + 1e-5 * machine.vectors[at]
            moved_w[at] += g_w * g_w
            moved_v[at] += g_v * g_v
            machine.weight[at] -= 0.1 * g_w / np.sqrt(moved_w[at])
            machine.vectors[at] -= 0.03 * g_v / np.sqrt(moved_v[at])
            machine.bias -= 0.05 * float(error.mean())
    return machine


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets = _Buckets()
    for batch in batches:
        rows = [features(t.as_py(), n.as_py(), buckets) for t, n in zip(batch.column(0), batch.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in rows], pa.list_(pa.int64())), pa.array([x for _, x in rows], pa.list_(pa.float64())), batch.column(2)],
            names=["places", "values", "quality"],
        )


def _length(docs: DataFrame) -> Column:
    """The recorded length; the text's own where none is recorded."""
    own = F.length(whole("text")).cast("long")
    return (F.coalesce(F.col("n_chars").cast("long"), own) if "n_chars" in docs.columns else own).alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """The machine fitted on at most ``rows`` labelled documents outside the held-out fold.

    Of rows that repeat a doc_id the one with the least text digest is learned from, so ``rows`` bounds
    what reaches the driver.
    """
    own = labels.where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id")) != 0)
    own = own.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", whole("text").alias("text"), _length(docs))
    each = texts.join(F.broadcast(own), "doc_id").groupBy("doc_id")
    chosen = each.agg(F.min_by(F.struct("text", "n_chars", "quality"), F.struct(F.md5("text"), "n_chars")).alias("row")).select("row.*")
    found = chosen.mapInArrow(_extracted, "places array<long>, values array<double>, quality int").toArrow()
    places, values = found.column("places").combine_chunks(), found.column("values").combine_chunks()
    data = [(places[k].values.to_numpy(), values[k].values.to_numpy()) for k in range(len(places))]
    order = sorted(range(len(data)), key=lambda k: (len(data[k][0]), data[k][0].tobytes()))  # not the order of arrival
    labels_ = found.column("quality").to_numpy().astype(float)
    del found, places, values
    return fit([data[k] for k in order], labels_[order])


def score(docs: DataFrame, machine: Machine) -> Column:
    """The score of a row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        buckets, model = _Buckets(), shared.value
        for texts, lengths in batches:
            out = []
            for k in range(0, len(texts), 256):
                rows = [features(t, n, buckets) for t, n in zip(texts[k : k + 256], lengths[k : k + 256], strict=True)]
                out.append(model.scores(rows))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return scored(whole("text"), _length(docs))


def assess(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    machine = train(docs, labels, rows)
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(True))
    out = docs.select("doc_id", held_out.alias("held_out"), score(docs, machine).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted to be good."""
    return docs.where(score(docs, train(docs, labels, rows)) >= THRESHOLD)
