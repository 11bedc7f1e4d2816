"""Packing documents into token sequences, as a cutting-stock problem solved by column generation.

A document is its token ids and one closing id. Whole sequences' worth of it are cut off first and
each fills a sequence; what is left, its tail, is a piece to be packed. Tails are ranked at random
within their length class (``UNIT`` tokens wide, so the classes are as many as a sequence has units),
and the histogram of classes is all that reaches the driver. There a linear program over patterns
(how many tails of each class share a sequence) is solved by column generation, a knapsack dynamic
program pricing the next pattern. Patterns are used as often as the solution says, rounded down; what
rounding leaves is packed by first fit, largest first, and makes patterns of its own. A tail finds
its sequence from its class and rank alone.

The gaps that classes and patterns leave are filled by cutting: a share of the tails, drawn by hash
and only as large as the gaps, is left out of the program, laid end to end and cut where gaps end.
What is left of these makes sequences of full length and, at last, of powers of two, which need
no padding. So every sequence is full.

Cases: NULL and empty texts are a closing id alone; a NULL doc_id is carried along; repeated rows are
packed each for itself; other columns are ignored; an empty table gives no rows. Long texts are
tokenized a slice at a time and keep two or four bytes for each id.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import numbered, whole
from postlake.session import cut

LENGTH = 2048
UNIT = 16
END = 1
#: Tails fall into so many classes by hash; the first ones fill gaps.
DRAWS = 256
#: The line of filling tails is cut into cells of so many tokens.
CELL = 1 << 16
_SLICE = 1 << 20
_KNOWN = 450_000
#: What a vocabulary takes for white space, as a class: Python's own would add four control characters.
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class _Known(dict[str, bytes]):
    """The ids of chunks; those of a chunk not seen before are found when it is asked for."""

    def __init__(self, older: dict[str, bytes], encode: Callable[[str], bytes]):
        self.older, self.encode = older, encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= 40:
            self[chunk] = ids
        return ids


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    A byte-level vocabulary's tokens never reach over the chunks that ``chunk`` cuts: a word with the
    blank before it, stops after a word, other visible runs, and white space. Every chunk is
    tokenized by itself, and those seen before are looked up.
    """

    chunk = re.compile(
        f" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+(?![^{_BLANKS}.,])|[.,]+(?![^{_BLANKS}])|[{_BLANKS}]+(?![^{_BLANKS}])| ?[^{_BLANKS}]+|[{_BLANKS}]+"
    )
    between = re.compile(f"(?<=[^{_BLANKS}]) (?=[^{_BLANKS}])")

    #: A chunk that is one word or stop to the vocabulary as it stands.
    single = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+|[.,]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # without looking for words in words
        self.four = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.known = _Known({}, self._of_chunk)
        # how a byte-level vocabulary writes each byte of such a chunk
        spelled = {c: pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(c)[0][0] for c in " .,Aé"}
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in own)}
        self.bytes = {b: other.get(b, b) for b in range(256)}
        if any(self._spelled(c) != v for c, v in spelled.items()):
            raise ValueError(f"{path} is no byte-level vocabulary")

    def _spelled(self, chunk: str) -> str:
        return chunk.encode().decode("latin-1").translate(self.bytes)

    def _of_chunk(self, chunk: str) -> bytes:
        if self.single.fullmatch(chunk):
            return b"".join([self.four[t.id] for t in self.model.tokenize(self._spelled(chunk))])
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _slices(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            found = self.between.search(text, start + _SLICE) if start + _SLICE < len(text) else None
            end = found.start() if found else len(text)
            yield text[start:end]
            start = end

    def _of_group(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _KNOWN:  # what is not used again until the next time goes
            self.known.older = {}
            self.known = _Known(self.known, self._of_chunk)
        of = self.known.__getitem__
        return [b"".join(map(of, self.chunk.findall(t))) for t in texts]

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; about a megabyte is worked on at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        group, places, load = [], [], 0
        for n, text in enumerate(texts):
            for part in self._slices(text):
                group.append(part)
                places.append(n)
                load += len(part)
                if load >= _SLICE:
                    for k, ids in zip(places, self._of_group(group), strict=True):
                        out[k].append(ids)
                    group, places, load = [], [], 0
        for k, ids in zip(places, self._of_group(group), strict=True):
            out[k].append(ids)
        return [b"".join(parts) for parts in out]


@cache
def _ids(path: str) -> Ids:
    return Ids(path)


def _documents(path: str, texts: list[str], end: int) -> list[bytes]:
    closing = end.to_bytes(4, "little")
    return [ids + closing for ids in _ids(path).of(texts)]


def _tokenized(path: str, length: int, end: int):
    """Rows (doc_id, key, text) measured; checksums are those of the whole sequences and of the tail."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, full = TaskContext.get(), 0, 0
        task = task.partitionId() if task else 0
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                tokens, tails, fulls, checks, orders = [], [], [], [], []
                for key, ids in zip(part.column(1).to_pylist(), _documents(path, part.column(2).to_pylist(), end), strict=True):
                    n = len(ids) // 4
                    tokens.append(n)
                    tails.append(n % length)
                    fulls.append(full)
                    full += n // length
                    checks.append([zlib.crc32(ids[k : k + 4 * length]) for k in range(0, len(ids), 4 * length)])
                    orders.append(f"{zlib.crc32(f'{key}:{task}:{row}'.encode()):08x}{key[:24]}")
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(orders, pa.string()),
                        pa.array([task] * part.num_rows, pa.int32()),
                        pa.array(tokens, pa.int64()),
                        pa.array(tails, pa.int64()),
                        pa.array(fulls, pa.int64()),
                        pa.array(checks, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "spread", "task", "doc_tokens", "tail", "full_before", "checks"],
                )

    return measured


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that depends on doc_id and text alone."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(whole("text"))))
    return docs.select("doc_id", key.alias("key"), whole("text").alias("text"))


def best_pattern(value: np.ndarray, capacity: int) -> np.ndarray:
    """How many pieces of 1, 2, ... units make the dearest sequence of ``capacity`` units."""
    best, chosen = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        sums = best[room - 1 :: -1][: len(value)] + value[:room]
        piece = int(sums.argmax())
        if sums[piece] > best[room - 1] + 1e-12:
            best[room], chosen[room] = sums[piece], piece + 1
        else:
            best[room], chosen[room] = best[room - 1], 0
    pattern, room = np.zeros(len(value), np.int64), capacity
    while room > 0:
        if chosen[room]:
            pattern[chosen[room] - 1] += 1
        room -= max(1, int(chosen[room]))
    return pattern


def solve(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used by the linear program that covers ``demand`` with fewest sequences."""
    sizes = np.flatnonzero(demand) + 1
    if len(sizes) == 0:
        return []
    wanted = demand[sizes - 1] * (1 + 1e-9 * np.arange(1, len(sizes) + 1))  # no ties between leaving columns
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(50 * len(sizes) + 1_000):
        used = np.linalg.solve(basis, wanted)
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value = np.zeros(capacity)
        value[sizes - 1] = np.maximum(price, 0)
        column = best_pattern(value, capacity)[sizes - 1].astype(float)
        if column @ price <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        falls = step > 1e-9
        ratio = np.where(falls, used / np.where(falls, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    out = []
    for k in range(len(sizes)):
        pattern = np.zeros(capacity, np.int64)
        pattern[sizes - 1] = basis[:, k].round().astype(np.int64)
        out.append((pattern, float(used[k])))
    return out


def rounded(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold exactly ``demand`` pieces of each size."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, used in sorted(solve(demand, capacity), key=lambda p: -p[1]):
        held = pattern > 0
        times = min(int(used + 1e-6), int((left[held] // pattern[held]).min()))
        if times > 0:
            out.append((pattern, times))
            left -= times * pattern
    open_: list[list] = []
    for size in range(capacity, 0, -1):  # a few pieces for each pattern of the program
        for _ in range(int(left[size - 1])):
            place = next((o for o in open_ if o[1] >= size), None)
            if place is None:
                open_.append(place := [np.zeros(capacity, np.int64), capacity])
            place[0][size - 1] += 1
            place[1] -= size
    rest = Counter(tuple(o[0]) for o in open_)
    return out + [(np.array(p), n) for p, n in rest.items()]


class Plan:
    """Which tails fill gaps, and the patterns of all others."""

    def __init__(self, histogram: dict[tuple[int, int], tuple[int, int]], length: int, unit: int):
        """``histogram``: (draw, class) to the number of tails and the sum of their tokens."""
        self.capacity = length // unit
        self.filling = 0
        while True:  # the fewest draws, doubled, whose tails are enough to fill the gaps of the rest
            demand, tokens, spare = np.zeros(self.capacity, np.int64), 0, 0
            for (draw, size), (n, total) in histogram.items():
                if draw < self.filling:
                    spare += total
                else:
                    demand[size - 1] += n
                    tokens += total
            self.patterns = rounded(demand, self.capacity)
            self.sequences = sum(n for _, n in self.patterns)
            self.gaps = self.sequences * length - tokens
            if self.gaps <= spare or self.filling >= DRAWS:
                self.spare = spare
                return
            self.filling = max(1, 2 * self.filling)

    def places(self) -> dict[int, tuple[np.ndarray, ...]]:
        """By class, in the order of ranks: the first rank of an entry, its pattern's first sequence,
        its number of sequences and its pattern."""
        out: dict[int, list] = {}
        first, rank = 0, np.zeros(self.capacity, np.int64)
        for k, (pattern, n) in enumerate(self.patterns):
            for size in np.flatnonzero(pattern):
                out.setdefault(int(size) + 1, []).append((rank[size], first, n, k))
                rank[size] += n * pattern[size]
            first += n
        return {size: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for size, rows in out.items()}


def _seated(places: dict[int, tuple[np.ndarray, ...]]):
    """The sequence of each tail, from its class and rank."""

    def seated(sizes, ranks):
        import pandas as pd

        out = np.zeros(len(sizes), np.int64)
        sizes, ranks = sizes.to_numpy(), ranks.to_numpy()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            rank, first, n, _ = places[int(size)]
            at = np.searchsorted(rank, ranks[rows], "right") - 1
            out[rows] = first[at] + (ranks[rows] - rank[at]) % n[at]
        return pd.Series(out)

    return F.pandas_udf(seated, "long")


def _cells(rows: DataFrame, start: str, size: str) -> DataFrame:
    """One row for each cell that a stretch of the line touches, and where it begins there."""
    cell = F.explode(F.sequence(F.floor(F.col(start) / CELL), F.floor((F.col(start) + F.col(size) - 1) / CELL)))
    return rows.withColumn("cell", cell).withColumn("at", F.greatest(F.col(start), F.col("cell") * CELL))


def _filled(tails: DataFrame, gaps: DataFrame, total: int) -> DataFrame:
    """Pieces where stretches of tails (tail_at, tail, ...) and of gaps (gap_at, gap, ...), each laid end to end, overlap."""
    one = F.struct(*tails.columns).alias("of")
    other = F.struct(*gaps.columns).alias("into")
    none_of, none_into = F.lit(None).cast(tails.select(one).schema["of"].dataType), F.lit(None).cast(gaps.select(other).schema["into"].dataType)
    marks = (
        _cells(tails, "tail_at", "tail").select("cell", "at", one, none_into.alias("into"))
        .union(_cells(gaps, "gap_at", "gap").select("cell", "at", none_of.alias("of"), other))
    )
    line = Window.partitionBy("cell").orderBy("at")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce(F.lead("at").over(line), F.least((F.col("cell") + 1) * CELL, F.lit(total)))
    return marks.select(
        "at",
        (until - F.col("at")).alias("length"),
        F.last("of", True).over(so_far).alias("of"),
        F.last("into", True).over(so_far).alias("into"),
    ).where("length > 0 and of is not null and into is not null")


def _checked(path: str, end: int):
    """The checksum of a piece of a document's ids."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                zlib.crc32(memoryview(ids.as_buffer())[4 * s : 4 * (s + n)])
                for ids, s, n in zip(batch.column("ids"), batch.column("start").to_pylist(), batch.column("length").to_pylist(), strict=True)
            ]
            names = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(values, pa.int64())], names=[*names, "ids_crc32"])

    return checked


def _tail_ids(path: str, length: int, end: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                tails = [ids[len(ids) // (4 * length) * 4 * length :] for ids in _documents(path, part.column(1).to_pylist(), end)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails, pa.binary())], names=["of_key", "ids"])

    return encoded


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, unit: int = UNIT, end: int = END, rows_per_range: int = 20_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, key): one row for each piece.

    ``docs`` has doc_id and text; ``tokenizer`` is a tokenizer's file on every executor. ``key`` tells
    documents apart that differ in doc_id or text.
    """
    spark = docs.sparkSession
    fields = "key string, spread string, task int, doc_tokens long, tail long, full_before long, checks array<long>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = cut(_keyed(docs).mapInArrow(_tokenized(tokenizer, length, end), f"doc_id {kind}, {fields}"), "packing-sizes")
    draw = F.conv(F.substring("key", 1, 2), 16, 10).cast("int")
    size = F.ceil(F.col("tail") / unit).cast("int")
    tails = sized.where("tail > 0").select(
        "doc_id", "key", "spread", "doc_tokens", "tail", draw.alias("draw"), size.alias("size"), F.element_at("checks", -1).alias("check")
    )
    counts = tails.groupBy("draw", "size").agg(F.count("*").alias("n"), F.sum("tail").alias("tokens")).collect()
    plan = Plan({(r["draw"], r["size"]): (r["n"], r["tokens"]) for r in counts}, length, unit)
    of_class: dict[int, int] = {}
    for r in counts:
        of_class[r["size"]] = of_class.get(r["size"], 0) + r["n"]

    # Whole tails into the sequences of their patterns.
    seats = tails.where(F.col("draw") >= plan.filling).withColumn("one", F.lit(1))
    seats = numbered(seats, ["size"], "spread", ["key"], {"rank": "one"}, max(of_class.values(), default=0), rows_per_range)
    seats = seats.withColumn("sequence_id", _seated(plan.places())(F.col("size"), F.col("rank")))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("tail"), "spread").rowsBetween(Window.unboundedPreceding, -1)
    seats = seats.withColumn("offset", F.coalesce(F.sum("tail").over(within), F.lit(0)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "key"]
    start = F.col("doc_tokens") - F.col("tail")
    seats = cut(seats.select("doc_id", start.alias("start"), F.col("tail").alias("length"), F.col("check").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "key"), "packing-seats")

    # The other tails, end to end, into the gaps.
    free = seats.groupBy("sequence_id").agg(F.sum("length").alias("offset")).where(F.col("offset") < length)
    free = free.select("sequence_id", "offset", (length - F.col("offset")).alias("gap"), F.md5(F.col("sequence_id").cast("string")).alias("spread"))
    free = numbered(free, [], "spread", ["sequence_id"], {"gap_at": "gap"}, plan.sequences, rows_per_range)
    free = free.select("sequence_id", "offset", "gap", "gap_at")
    gaps, spare = plan.gaps, plan.spare
    rest = max(0, spare - gaps)
    more = rest // length
    if more:
        k = F.col("id")
        free = free.union(spark.range(more).select(k + plan.sequences, F.lit(0).cast("long"), F.lit(length).cast("long"), k * length + gaps))
    ends, at, n = [], gaps + more * length, plan.sequences + more
    for power in reversed(range(length.bit_length())):
        if rest % length & (1 << power):
            ends.append((n, 0, 1 << power, at))
            n, at = n + 1, at + (1 << power)
    if ends:
        free = free.union(spark.createDataFrame(ends, "sequence_id long, offset long, gap long, gap_at long"))
    pieces = seats
    if spare:
        filler = tails.where(F.col("draw") < plan.filling)
        filler = numbered(filler, [], "spread", ["key"], {"tail_at": "tail"}, sum(of_class.values()), rows_per_range)
        filler = filler.select("doc_id", "key", "doc_tokens", "tail", "tail_at")
        parts = _filled(filler, free, spare).select(
            "of.doc_id", (F.col("at") - F.col("of.tail_at")).alias("start"), "length", "of.doc_tokens", "of.tail",
            "into.sequence_id", (F.col("into.offset") + F.col("at") - F.col("into.gap_at")).alias("offset"), "of.key",
        )
        texts = _keyed(docs).where(draw < plan.filling).select("key", "text")
        known = texts.mapInArrow(_tail_ids(tokenizer, length, end), "of_key string, ids binary").dropDuplicates(["of_key"])
        parts = parts.join(known, F.col("key") == F.col("of_key")).drop("of_key")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != "ids")
        parts = parts.mapInArrow(_checked(tokenizer, end), fields + ", ids_crc32 long")
        pieces = pieces.union(parts.withColumn("start", F.col("start") + F.col("doc_tokens") - F.col("tail")).select(names))

    # Whole sequences' worth of documents, numbered after all others.
    heads = sized.groupBy("task").agg(F.max(F.col("full_before") + F.floor(F.col("doc_tokens") / length)).alias("n"))
    heads = heads.select(F.col("task").alias("of_task"), F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    full = sized.where(F.col("doc_tokens") >= length).join(heads, F.col("task") == F.col("of_task"))
    full = full.select("*", F.posexplode(F.slice("checks", 1, F.floor(F.col("doc_tokens") / length).cast("int"))).alias("nth", "check"))
    full = full.select(
        "doc_id", (F.col("nth") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.col("check").alias("ids_crc32"),
        "doc_tokens", (F.col("before") + F.col("full_before") + F.col("nth") + n).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "key",
    )
    return pieces.union(full.select(names))


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from the texts and the pieces that ``pack`` gave."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p["sequence_id"], p["offset"], text, p["start"], p["length"]) for text, ps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in ps]
            last, ids = None, b""
            out = []
            for _, _, text, s, n in rows:
                if text is not last:
                    last, ids = text, _documents(tokenizer, [text], end)[0]
                out.append(np.frombuffer(ids[4 * s : 4 * (s + n)], "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(out, pa.list_(pa.int32()))],
                names=["sequence_id", "offset", "ids"],
            )

    texts = _keyed(docs).dropDuplicates(["key"]).select(F.col("key").alias("of_key"), "text")
    places = pieces.select("key", F.struct("sequence_id", "offset", "start", "length").alias("piece"))
    cuts = places.join(texts, F.col("key") == F.col("of_key")).select("text", F.array("piece").alias("pieces"))
    parts = cuts.mapInArrow(sliced, "sequence_id long, offset long, ids array<int>")
    laid = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # a sequence's length at most
    return laid.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
