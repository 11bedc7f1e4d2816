"""Importance resampling of documents towards a target distribution.

A text's features are its words and runs of up to ``ngrams`` words, hashed into buckets. One table of
256 bytes lower-cases A-Z and blanks what is no part of a word in the text's UTF-8 bytes,
``bytes.split`` yields the words, and CRC-32 with the value of the run so far as its seed extends each
run by a word; Counters reduce the hashes. From the bucket counts of all documents and of the target
comes each bucket's gain, the logarithm of how much likelier the target is to show it. A document's
weight is the mean gain of its features; with Gumbel noise added to it, the highest scores are a
sample drawn without replacement in proportion to the exponential of the weight.

Both passes go over whole texts, a slice of bytes at a time. Every task sums its buckets before
anything is shuffled, and only one number for each bucket, a parameter, goes through the driver.
Ranks come from one range-partitioned sort: rows get their place within a range, and only the sizes
of the ranges are added up.

Cases: a NULL or empty text has no features and the weight 0; a NULL doc_id draws as the empty text
and comes last among ties; every repeated row counts and is drawn by itself; equal scores go to the
smaller doc_id; other columns are ignored; an empty table gives no rows, and an empty target adds
nothing to any bucket.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import ALPHANUMERIC, whole
from postlake.session import cut

BUCKETS = 10_000
_SLICE = 1 << 20


def _slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of about a megabyte at a time."""
    start = 0
    while start < len(raw):
        end = start + _SLICE
        while 0 < end < len(raw):
            blank = raw.find(b" ", end, end + _SLICE)
            if blank >= 0:
                end = blank
                break
            end += _SLICE
        yield raw[start:end].split()
        start = end


def hashes(text: bytes, ngrams: int) -> Counter:
    """How often each CRC-32 of a run of 1 to ``ngrams`` words occurs in a text in UTF-8."""
    found: Counter = Counter()
    carried: list[bytes] = []
    for words in _slices(text.translate(ALPHANUMERIC)):
        old = len(carried)
        words = carried + words
        values = list(map(zlib.crc32, words))
        found.update(values[old:])
        if ngrams > 1:
            tails = [b" " + w for w in words]
            for width in range(2, ngrams + 1):
                values = list(map(zlib.crc32, tails[width - 1 :], values))
                found.update(values[max(0, old - width + 1) :])
            carried = words[-(ngrams - 1) :]
    return found


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text"):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def _counting(ngrams: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch):
                found = hashes(text, ngrams)
                keys = np.fromiter(found.keys(), np.int64, len(found)) % buckets
                np.add.at(total, keys, np.fromiter(found.values(), np.int64, len(found)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return counted


def bucket_counts(texts: DataFrame, ngrams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket."""
    each = texts.select(whole("text").alias("text")).mapInArrow(_counting(ngrams, buckets), "bucket long, n long")
    table = each.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket."""
    s, t, size = raw.tolist(), target.tolist(), len(raw)
    all_s, all_t = sum(s), sum(t)
    ratio = np.array([(b + 1) * (all_s + size) / ((a + 1) * (all_t + size)) for a, b in zip(s, t, strict=True)])
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighing(ngrams: int, gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [], [], []
            for text in _texts(batch):
                found = hashes(text, ngrams)
                n = np.fromiter(found.values(), np.int64, len(found))
                keys = np.fromiter(found.keys(), np.int64, len(found)) % len(gain)
                total = int(n.sum())
                features.append(total)
                words.append(total if ngrams == 1 else sum(map(len, _slices(text.translate(ALPHANUMERIC)))))
                weights.append(int(n @ gain[keys]) // total if total else 0)
            kept = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(weights, pa.int64())],
                names=[*(c for c in batch.schema.names if c != "text"), "n_words", "n_features", "weight"],
            )

    return weighed


def _weighted(rows: DataFrame, ngrams: int, gain: np.ndarray) -> DataFrame:
    """``rows`` with n_words, n_features and weight in place of their text."""
    fields = [f for f in rows.schema if f.name != "text"]
    new = [T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight")]
    return rows.mapInArrow(_weighing(ngrams, gain), T.StructType([*fields, *new]))


def noise(doc_id: str, seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))) of a number that a hash draws for the document."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _ranked(scored: DataFrame, share: tuple[int, int], least_words: int) -> DataFrame:
    """Add rank: the place among the long enough documents of those within the share, else NULL."""
    fits = F.col("n_words") >= least_words
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # written before it is sorted: finding the ranges would weigh every text once more
    placed = cut(scored.withColumn("fits", fits), "resampling-scores").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("at", F.monotonically_increasing_id()), "resampling-order")
    span = F.shiftright("at", 33)
    ranges = placed.groupBy(span.alias("span")).agg(F.count_if("fits").alias("n")).orderBy("span").collect()
    before, total = [], 0
    for r in ranges:  # one row for each range of the sort
        before.append((r["span"], total))
        total += r["n"]
    drawn = share[0] * total // share[1]
    heads = scored.sparkSession.createDataFrame(before, "of long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.join(F.broadcast(heads) if len(before) <= 100_000 else heads, span == F.col("of"), "left")
    return out.withColumn("rank", F.when(F.col("fits") & (rank <= drawn), rank)).drop("fits", "at", "of", "before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    ngrams: int = 1,
    buckets: int = BUCKETS,
    share: tuple[int, int] = (10, 100),
    least_words: int = 20,
    seed: str = "2024",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text).

    Of the documents with ``least_words`` words or more the share is drawn that scores highest; rank
    counts them from 1 and is NULL for all others. ``target`` has a text column.
    """
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    weighed = _weighted(docs.select("doc_id", whole("text").alias("text")), ngrams, gain)
    return _ranked(weighed.withColumn("score", F.col("weight") + noise("doc_id", seed)), share, least_words)


def drawn_documents(
    docs: DataFrame,
    target: DataFrame,
    ngrams: int = 1,
    buckets: int = BUCKETS,
    share: tuple[int, int] = (10, 100),
    least_words: int = 20,
    seed: str = "2024",
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns.

    Only the last drawn (score, doc_id) is looked up in the ranking; texts are weighed again and never
    shuffled. Rows that agree with that last one in both come out together.
    """
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    score = F.col("weight") + noise("doc_id", seed)
    weighed = _weighted(docs.select("doc_id", whole("text").alias("text")), ngrams, gain)
    ranked = _ranked(weighed.withColumn("score", score), share, least_words)
    last = ranked.where("rank is not null").orderBy(F.desc("rank")).select("score", "doc_id").first()
    if last is None:
        return docs.limit(0)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _weighted(docs.select(row, "doc_id", whole("text").alias("text")), ngrams, gain).withColumn("score", score)
    tie = F.lit(True) if last["doc_id"] is None else F.coalesce(F.col("doc_id") <= F.lit(last["doc_id"]), F.lit(False))
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tie))
    return rows.where(drawn).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
