"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlake.session import cut

#: What counts as a word in the contracts on whole texts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to this many rows of a few dozen bytes.
BROADCAST_ROWS = 500_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: str | Column) -> Column:
    """The text, NULL as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written down, and marked for broadcast only if it was counted to be small."""
    kept = cut(df, "bounded")
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def numbered(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    order: Sequence[str],
    sums: dict[str, str],
    rows: int,
    rows_per_chunk: int = 20_000,
) -> DataFrame:
    """Add, for each ``out: column``, the sum of ``column`` over the rows before this one in its group.

    ``key`` is a column of 15 or more random hex digits that comes first in the order. Its leading
    digits cut a group of any size into ranges of about ``rows_per_chunk`` rows; each range is
    summed on its own, and only the sums of the ranges are scanned across the group.
    """
    digits = 0
    while rows > rows_per_chunk * 16**digits and digits < 6:
        digits += 1
    chunk = "__range"
    base = df.withColumn(chunk, F.substring(key, 1, digits) if digits else F.lit(""))
    totals = base.groupBy(*group, chunk).agg(*[F.sum(c).alias(f"__sum_{o}") for o, c in sums.items()])
    across = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(
        *[F.col(g).alias(f"__at_{g}") for g in group],
        F.col(chunk).alias("__at_range"),
        *[F.coalesce(F.sum(f"__sum_{o}").over(across), F.lit(0)).alias(f"__head_{o}") for o in sums],
    )
    within = (
        Window.partitionBy(*group, chunk).orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = base.withColumns({f"__in_{o}": F.coalesce(F.sum(c).over(within), F.lit(0)) for o, c in sums.items()})
    same = F.col(chunk) == F.col("__at_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__at_{g}"))
    return (
        local.join(heads, same)
        .withColumns({o: F.col(f"__head_{o}") + F.col(f"__in_{o}") for o in sums})
        .drop(chunk, "__at_range", *[f"__at_{g}" for g in group], *[f"__{k}_{o}" for k in ("head", "in") for o in sums])
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _folded(is_word) -> bytes:
    """A translation of bytes: A-Z lower-cased, what is no part of a word to blanks."""
    return bytes(32 if not is_word(c) else c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Words are what stands between ASCII white space.
SPACED = _folded(lambda c: c not in (32, 9, 10, 11, 12, 13))
#: Words are runs of letters, digits and non-ASCII characters.
ALPHANUMERIC = _folded(lambda c: c > 127 or chr(c).isalnum())

_PIECE = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


_POWERS = _powers(int(_BASE), _PIECE)
_INVERSE = _powers(pow(int(_BASE), -1, 2**64), _PIECE)


def word_hashes(text: str | None, folding: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text.

    A word's bytes, each as a random number, are the coefficients of a polynomial modulo 2^64. All
    words of a piece of text come from one running sum, divided by the power at which they start.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(folding), np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(raw) <= _PIECE:
        return _hashes(raw, starts, ends, _POWERS, _INVERSE)
    out, first = [], 0
    while first < len(starts):  # as many whole words as fit, but one at least
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _PIECE, "right")))
        begin, end = int(starts[first]), int(ends[last - 1])
        powers, inverse = _POWERS, _INVERSE
        if end - begin > _PIECE:
            powers, inverse = _powers(int(_BASE), end - begin), _INVERSE
        out.append(_hashes(raw[begin:end], starts[first:last] - begin, ends[first:last] - begin, powers, inverse))
        first = last
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hashes(raw, starts, ends, powers, inverse) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_OF_BYTE[raw] * powers[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words; of the whole sequence if it is shorter."""
    if len(words) == 0:
        return words
    w = min(width, len(words))
    n = len(words) - w + 1
    out = words[:n] * _BASE + np.uint64(w)
    for k in range(1, w):
        out ^= out >> np.uint64(29)
        out += words[k : k + n]
        out *= _BASE
    return mix(out)
