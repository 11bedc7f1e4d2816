"""Grouping spelling variants: words one edit apart, found by partition and enumeration.

Words are runs of Latin letters, counted over all documents. A word is a binary vector with one
place for every (letter, how many times it has stood before). One inserted or deleted letter moves
it by a Hamming distance of one, one replaced letter by two, so words one edit apart lie at a
distance of at most two. The places fall into ``PARTS`` parts; vectors that near differ in one part
or in two, and so agree on all parts but one, or on all but two. A word therefore has one exact
signature for each part left out and one for each pair of parts left out, and near words share one:
an equi-join on signatures finds them all. Leaving out a pair finds only what differs in both of its
parts (then the lengths are equal and stand in the signature too), so every pair of words comes
up once. What the join finds is verified by the edit distance.

A bucket holds different words, never copies of one, and only verified pairs leave the join; bitmaps
of the parts left out settle most of its tests. A word's form is a near word that occurs at least
``RATIO`` times as often, so chains of forms are short and are followed by doubling.

Cases: a NULL or empty text has no words; a NULL doc_id counts as the empty text; every repeated row
counts; ties between forms go to the smaller word by code points; words of one spelling are one row;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import mix, whole
from postlake.session import cut

RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
PARTS = 8
RATIO = 5
_PAIRS = list(combinations(range(PARTS), 2))
#: Without NULLs both sides of the join read the same shuffle.
_SIGNED = T.StructType([
    T.StructField(name, kind, False)
    for name, kind in (
        ("signature", T.LongType()), ("word", T.StringType()), ("n", T.LongType()),
        ("paired", T.BooleanType()), ("first", T.LongType()), ("second", T.LongType()),
    )
])


def _lowered(run: Column) -> Column:
    """A-Z alone in lower case."""
    return F.when(run.rlike("[A-Z]"), F.translate(run, ascii_uppercase, ascii_lowercase)).otherwise(run)


def _garbled(doc_id: Column, run: Column, every: int) -> Column:
    """The run, with one letter deleted in one of ``every`` (document, run)."""
    draw = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (draw % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(draw % every == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, garble_every: int | None = None) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough.

    ``garble_every`` misspells a fixed share of the occurrences first, to see them found again.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(whole("text"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("doc_id", _lowered(F.col("run")).alias("run"))
    word = _garbled(F.col("doc_id"), F.col("run"), garble_every) if garble_every else F.col("run")
    words = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class _Places(dict):
    """The part, the random number and the bit of a place."""

    def __missing__(self, place: tuple[str, int]) -> tuple[int, int, int]:
        name = f"{place[0]}{place[1]}".encode()
        low, high = zlib.crc32(name), zlib.crc32(name, 0x5BD1E995)
        value = low % PARTS, (high << 32 | low) * 0x9E3779B97F4A7C15 % 2**64, 1 << (high >> 7) % 63
        self[place] = value
        return value


def _vector(word: str, places: _Places) -> tuple[list[int], list[int]]:
    """For each part a hash and a bitmap of the word's places in it."""
    sums, bits, seen = [0] * PARTS, [0] * PARTS, {}
    for letter in word:
        seen[letter] = nth = seen.get(letter, 0) + 1
        part, value, bit = places[letter, nth]
        sums[part] += value
        bits[part] ^= bit
    return sums, bits


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word with the signature that each part, and each pair of parts, leaves when taken out."""
    places = _Places()
    out_of = np.array([(p, p) for p in range(PARTS)] + _PAIRS)
    paired = out_of[:, 0] != out_of[:, 1]
    labels = mix(np.arange(1, len(out_of) + 1, dtype=np.uint64))
    for batch in batches:
        for start in range(0, batch.num_rows, 2_000):
            part = batch.slice(start, 2_000)
            words = part.column(0).to_pylist()
            vectors = [_vector(w, places) for w in words]
            sums = np.array([[s % 2**64 for s in v[0]] for v in vectors], np.uint64).reshape(-1, PARTS)
            bits = np.array([v[1] for v in vectors], np.int64).reshape(-1, PARTS)
            each = mix(sums + labels[:PARTS])
            lengths = np.array([len(w) for w in words], np.uint64)[:, None]
            left = each.sum(axis=1, dtype=np.uint64)[:, None] - each[:, out_of[:, 0]]
            left -= np.where(paired, each[:, out_of[:, 1]], np.uint64(0))
            signature = mix(left + labels + np.where(paired, lengths << np.uint64(32), np.uint64(0)))
            again = pa.array(np.repeat(np.arange(len(words)), len(out_of)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signature.ravel().view(np.int64)),
                    part.column(0).take(again),
                    part.column(1).take(again),
                    pa.array(np.tile(paired, len(words))),
                    pa.array(bits[:, out_of[:, 0]].ravel()),
                    pa.array(np.where(paired, bits[:, out_of[:, 1]], 0).ravel()),
                ],
                names=["signature", "word", "n", "paired", "first", "second"],
            )


def near_pairs(words: DataFrame, words_per_task: int = 8_000) -> DataFrame:
    """(a, n_a, b, n_b) with a < b: all words of ``words`` (word, n) that are one edit apart.

    The planner takes the signed words to be as few as the words, so the number of tasks is set
    here and a broadcast ruled out.
    """
    tasks = max(1, -(-words.count() // words_per_task))
    signed = words.mapInArrow(_signed, _SIGNED).repartition(tasks, "signature")
    one, other = signed.alias("l"), signed.hint("merge").alias("r")
    apart = lambda c: F.bit_count(F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}")))
    in_both = F.col("l.paired") & F.col("r.paired") & (apart("first") == 1) & (apart("second") == 1)
    in_one = ~F.col("l.paired") & ~F.col("r.paired") & (apart("first") <= 2) & (F.abs(F.length("l.word") - F.length("r.word")) <= 1)
    found = one.join(
        other,
        (F.col("l.signature") == F.col("r.signature"))
        & (F.col("l.word") < F.col("r.word"))
        & (in_both | in_one)
        & (F.levenshtein("l.word", "r.word", 1) == 1),
    )
    return found.select(F.col("l.word").alias("a"), F.col("l.n").alias("n_a"), F.col("r.word").alias("b"), F.col("r.n").alias("n_b"))


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root) for ``forms`` (word, form): each step multiplies the count by ``ratio`` at least."""
    chain = forms.select("word", F.col("form").alias("root"))
    depth = 1
    while ratio**depth < most:  # what one row spans doubles until no chain can be longer
        ahead = chain.select(F.col("word").alias("at"), F.col("root").alias("further"))
        chain = chain.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"))
        chain = cut(chain, "spelling-roots")
        depth *= 2
    return chain


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n), words being unique."""
    words = cut(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    pairs = near_pairs(words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    near = pairs.select(F.inline(sides)).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    )
    known = words.join(near, "word", "left").withColumn("form_n", -F.col("best.minus"))
    form = F.col("form_n") >= ratio * F.col("n")
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form, F.col("best.near")).alias("form"),
        F.when(form, F.col("form_n")).alias("form_n"),
    )
    known = cut(known, "spelling-forms")
    most = known.agg(F.max("n")).first()[0] or 0
    roots = _roots(known.where("form is not null"), most, ratio)
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
