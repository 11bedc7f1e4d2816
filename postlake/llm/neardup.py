"""Near-duplicate groups by SuperMinHash.

Signature. Every shingle ranks the bins of a signature by a permutation of its own, and a bin keeps
the least rank (with a random fraction) over all shingles. One shingle gives different ranks to
different bins, so the bins' errors are negatively correlated and the estimate varies less than with
independent hashes. Ranks are worked off layer by layer, all shingles of many texts at once, and a
text stops when no bin can sink any more: long texts need one or two layers. The number of bins is a
prime p and a permutation is rank -> (u * rank + v) mod p; it maps pairs of bins uniformly to pairs
of ranks, as a random permutation does, and the estimate's mean and variance depend on no more.

Banding. 47 bands of 7 bins: a pair of similarity 0.8 is missed with a probability of 1.6e-5, one of
0.85 with 1e-8; a pair of similarity 0.2 becomes a candidate with 6e-4. Bins of small sets are too
few to be independent, so sets of less than ``SMALL`` shingles are indexed exactly: two sets as
similar as asked share one of their first shingles by hash (all but as many as they must have in
common, and one), which are the keys of small sets, and further keys of sets just large enough to be
near one. Small sets pass the comparison of signatures below in any case. So links of short texts are
all found.

Verification. Texts with equal words are one class and take part once. In every band bucket the
members are first compared with a pivot, and each pair is verified once on the whole shingle sets; so
groups of copies become components at one comparison for each member and bucket. Buckets whose
members are then still in different components are searched in blocks of bounded size: members of
different components whose signatures agree in ``NEAR`` bins or more (a pair of similarity 0.8 does
not with a probability of 1e-7; the first bins of the signatures are compared beforehand) are
verified on their sets inside the block, in the first band that they share. Only links leave a block. So no link that a bucket holds is lost to a group's size.

Grouping. Distributed union-find (`components`).

Words are what stands between ASCII white space, A-Z lower-cased; the set of a text are its distinct
runs of ``width`` words, or the whole sequence if it is shorter. Shingles are told apart by 64-bit
hashes.

Cases: a NULL or blank text has an empty set and no links; ties take the least doc_id; rows that agree
in doc_id and text are one node, rows that share a doc_id and differ in text are told apart (`_told_apart`); a
row with a NULL doc_id takes no part: it is kept, with component_id NULL; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import SPACED, bounded, distinct, mix, rolling, whole, word_hashes
from postlake.llm.components import components
from postlake.session import cut

BINS = 331  # prime
BANDS, ROWS = 47, 7
#: Bins of two signatures that agree where their sets may be near.
NEAR = 225
#: The same for the first so many bins, which tell beforehand which members are worth a closer look.
SKETCH, NEAR_SKETCH = 128, 76
#: Sets of fewer shingles are indexed by their first shingles.
SMALL = 20
#: Members of a bucket that are compared in one piece.
BLOCK = 512
#: Shingles that are ranked together.
_AT_ONCE = 60_000


def shingles(text: str | None, width: int) -> tuple[np.ndarray, bytes]:
    """The distinct shingle hashes of a text, and a digest of its words."""
    words = word_hashes(text, SPACED)
    if len(words) == 0:
        return words, b""
    return distinct(rolling(words, width)), hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit hashes, as rank << 32 | fraction; empty sets keep the maximum."""
    top = np.uint64(2**64 - 1)
    out = np.full((len(sets), bins), top, dtype=np.uint64)
    at = 0
    while at < len(sets):
        end, load = at, 0
        while end < len(sets) and (end == at or load + len(sets[end]) <= _AT_ONCE):
            load += len(sets[end])
            end += 1
        if len(sets[at]) > _AT_ONCE:  # a long text in pieces; the state of its bins goes on
            for k in range(0, len(sets[at]), _AT_ONCE):
                _rank(out[at : at + 1], sets[at][k : k + _AT_ONCE], np.zeros(min(_AT_ONCE, len(sets[at]) - k), np.int64), bins)
        else:
            sizes = [len(s) for s in sets[at:end]]
            if load:
                _rank(out[at:end], np.concatenate(sets[at:end]), np.repeat(np.arange(end - at), sizes), bins)
        at = end
    return out


def _rank(state: np.ndarray, items: np.ndarray, owner: np.ndarray, bins: int) -> None:
    """Lower ``state`` by the ranks of ``items``, whose texts ``owner`` names."""
    p = np.uint64(bins)
    step = mix(items ^ np.uint64(0x51ED270B35A1C9F7))
    bin_ = (mix(items ^ np.uint64(0x2545F4914F6CDD1D)) % p).astype(np.int64)
    step = (step % (p - np.uint64(1)) + np.uint64(1)).astype(np.int64)
    fraction = mix(items + np.uint64(0x632BE59BD9B4E019))
    flat = state.reshape(-1)
    for rank in range(bins):
        values = (np.uint64(rank) << np.uint64(32)) | (mix(fraction + np.uint64(rank)) >> np.uint64(32))
        np.minimum.at(flat, owner * bins + bin_, values)
        worst = state.max(axis=1) >> np.uint64(32)
        going = (worst > np.uint64(rank))[owner]
        if not going.any():
            return
        if going.all():
            bin_ = (bin_ + step) % bins
        else:
            owner, step, fraction = owner[going], step[going], fraction[going]
            bin_ = (bin_[going] + step) % bins


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(rows):
        out = mix(out ^ parts[:, :, r]) + np.uint64(r)
    return out.view(np.int64)


def first_keys(shingles_: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two small sets of ``percent`` similarity or more share one; sets are sorted by hash."""
    n = len(shingles_)
    if n == 0 or n * percent >= SMALL * 100:
        return np.empty(0, np.int64)
    return mix(shingles_[: n - -(-n * percent // 100) + 1] ^ np.uint64(0x7F4A7C15F39CC060)).view(np.int64)


def keys_of(sets: list[np.ndarray], ranks: np.ndarray, percent: int) -> np.ndarray:
    """A row of bucket keys for each set; 0 where there is none."""
    most = SMALL * (100 - percent) // percent + 2
    out = np.zeros((len(sets), BANDS + most), np.int64)
    out[:, :BANDS] = band_keys(ranks)
    for k, s in enumerate(sets):
        if len(s) < SMALL:
            out[k, :BANDS] = 0
        first = first_keys(s, percent)
        out[k, BANDS : BANDS + len(first)] = first
    return out


def _signed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                both = [shingles(t.as_py(), width) for t in part.column(1)]
                sets = [s for s, _ in both]
                ranks = signatures(sets)
                keys = keys_of(sets, ranks, percent)
                full = np.array([len(s) > 0 for s in sets])
                bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), keys.shape[1]).cast(pa.list_(pa.int64()))
                bands = pc.if_else(pa.array(full), bands, pa.scalar(None, bands.type))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d or None for _, d in both], pa.binary()),
                        bands,
                        pa.array([r.tobytes() for r in (mix(ranks) & np.uint64(255)).astype(np.uint8)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "words", "bands", "bins"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(t.as_py(), width)[0] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return run


def _shared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, x, y in zip(*[batch.column(k) for k in range(4)], strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                if (100 + percent) * shared >= percent * (len(one) + len(two)):
                    kept.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in kept], pa.int64()) for n in (0, 1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have ``percent`` or more of their union in common."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = texts.join(bounded(ids), "id", "left_semi").mapInArrow(_sets(width), "id long, shingles binary")
    sets = cut(sets, "sets")
    left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    small, large = F.least(F.length("set_a"), F.length("set_b")), F.greatest(F.length("set_a"), F.length("set_b"))
    both = pairs.join(left, "a").join(right, "b").where(100 * small >= percent * large)
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_shared(percent), "a long, b long")


def _mixed(buckets: DataFrame, grouped: DataFrame) -> DataFrame:
    """The (bucket, id, component) rows of the buckets that hold more than one component."""
    named = buckets.drop("component").join(grouped, F.col("id") == F.col("node"), "left")
    named = named.select("bucket", "id", F.coalesce("component", "id").alias("component"))
    many = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return named.join(many.select("bucket"), "bucket")


def _pivot_pairs(buckets: DataFrame) -> DataFrame:
    """Each member of a bucket with the least."""
    pivots = buckets.groupBy("bucket").agg(F.min("id").alias("pivot"))
    pairs = buckets.join(pivots, "bucket").where("id != pivot")
    return pairs.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()


def _in_blocks(mixed: DataFrame) -> DataFrame:
    """Members dealt to blocks: each pair of a bucket's pieces, and each piece with itself, is one block."""
    sizes = mixed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))
    dealt = mixed.join(sizes, "bucket").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    keys = [F.col("bucket"), F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high")]
    names = [c for c in mixed.columns if c != "bucket"]
    dealt = dealt.select(*keys, "piece", *names)
    return dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that arrive in the order of their block, block by block."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = (row["bucket"], row["low"], row["high"])
            if at != key:
                if rows:
                    yield key, rows
                key, rows = at, []
            rows.append(row)
    if rows:
        yield key, rows


def _near(key: tuple, rows: list[dict], least: int, first: bool) -> Iterator[tuple[int, int]]:
    """Pairs of rows of different components that agree in ``least`` bins; ``first``: only in the
    first bucket that they share."""
    bucket, low, high = key
    component = np.array([r["component"] for r in rows])
    piece = np.array([r["piece"] for r in rows])
    small = np.array([r["small"] for r in rows])
    bins = np.frombuffer(b"".join(r["bins"] for r in rows), np.uint8).reshape(len(rows), -1)
    if first:
        bands = np.array([r["bands"] for r in rows], np.int64)
        before = (np.cumsum(bands == bucket, axis=1) == 0) & (bands != 0)  # the bands ahead of this bucket's
    for x in range(len(rows) - 1):
        rest = slice(x + 1, None)
        fit = component[rest] != component[x]
        if low != high:
            fit &= piece[rest] != piece[x]
        if not fit.any():
            continue
        fit &= ((bins[rest] == bins[x]).sum(axis=1) >= least) | small[rest] | small[x]
        if first:
            fit &= ~((bands[rest] == bands[x]) & before[x]).any(axis=1)
        for y in np.flatnonzero(fit).tolist():
            yield x, x + 1 + y


def _near_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (bucket, id) rows that have a near one in their bucket."""
    for key, rows in _blocks(batches):
        found = {rows[z]["id"] for pair in _near(key, rows, NEAR_SKETCH, first=False) for z in pair}
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())], names=["bucket", "id"])


def _block_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _blocks(batches):
            links = []
            for x, y in _near(key, rows, NEAR, first=True):
                one, two = (np.frombuffer(rows[z]["shingles"], np.uint64) for z in (x, y))
                if 100 * min(len(one), len(two)) >= percent * max(len(one), len(two)):
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    if (100 + percent) * shared >= percent * (len(one) + len(two)):
                        links.append(sorted((rows[x]["id"], rows[y]["id"])))
            yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in links], pa.int64()) for n in (0, 1)], names=["a", "b"])

    return run


def linked(signed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have links, as all links of their band buckets connect them.

    ``signed`` has (id, bands, bins, small), one row for each class; ``texts`` has (id, text).
    """
    buckets = signed.select("id", F.explode("bands").alias("bucket")).where("bucket <> 0")
    many = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    buckets = cut(buckets.join(many, "bucket").select("bucket", "id", F.lit(None).cast("long").alias("component")), "buckets")
    stars = cut(_verified(cut(_pivot_pairs(buckets), "pairs"), texts, width, percent), "links")
    grouped = components(stars)
    mixed = cut(_mixed(buckets, grouped), "mixed")
    blocks = _in_blocks(mixed.join(signed.select("id", F.substring("bins", 1, SKETCH).alias("bins"), "small"), "id"))
    near = cut(blocks.mapInArrow(_near_members, "bucket long, id long").distinct(), "near")
    if near.isEmpty():
        return grouped
    sets = texts.join(bounded(near.select("id").distinct()), "id", "left_semi").mapInArrow(_sets(width), "id long, shingles binary")
    sets = cut(sets, "near-sets")
    rest = mixed.join(near, ["bucket", "id"], "left_semi").join(signed, "id").join(sets, "id")
    found = cut(_in_blocks(rest).mapInArrow(_block_links(percent), "a long, b long").distinct(), "links")
    return components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))


def _told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(row, doc_id, text, node) for the rows of ``docs``, and the ids given out (of_id, alias), if any.

    A node is the doc_id, but for rows whose doc_id other rows have with another text: each of these
    texts is a node of its own, numbered below all doc_ids.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = bounded(ids.select(F.col("doc_id").alias("again")))
    if repeated.isEmpty():
        return rows.withColumn("node", F.col("doc_id")), None
    digest = F.md5("text")
    texts = rows.join(repeated, F.col("doc_id") == F.col("again"), "left_semi").groupBy("doc_id", digest.alias("digest")).count()
    below = min(0, rows.agg(F.min("doc_id")).first()[0]) - 1
    alias = F.lit(below) - F.monotonically_increasing_id()
    given = bounded(texts.select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), alias.alias("alias")))
    named = rows.join(given, (F.col("doc_id") == F.col("of_id")) & (digest == F.col("of_digest")), "left")
    return named.select("row", "doc_id", "text", F.coalesce("alias", "doc_id").alias("node")), given.select("of_id", "alias")


def _grouped(texts: DataFrame, width: int, percent: int, repeated: bool) -> tuple[DataFrame, DataFrame]:
    """The sets' sizes (node, n_shingles) of ``texts`` (node, text), and their (of, group)."""
    signed = texts.select("node", "text").mapInArrow(_signed(width, percent), "node long, n_shingles long, words binary, bands array<long>, bins binary")
    signed = cut(signed, "signed")
    classes = (
        signed.where("words is not null and node is not null")
        .groupBy("words")
        .agg(F.min("node").alias("id"), F.min_by(F.struct("bands", "bins", "n_shingles"), "node").alias("print"))
        .select("words", "id", "print.bands", "print.bins", (F.col("print.n_shingles") < SMALL).alias("small"))
    )
    classes = cut(classes, "classes")
    own = texts.select(F.col("node").alias("id"), "text")
    own = own.groupBy("id").agg(F.first("text").alias("text")) if repeated else own  # one row for each node
    found = linked(classes.select("id", "bands", "bins", "small"), own, width, percent)
    members = signed.where("node is not null").select(F.col("node").alias("of"), "words").join(classes.select("words", "id"), "words").select("of", "id")
    members = members.distinct() if repeated else members
    # A class is named by its least node, so the least class of a group is its least node too.
    grouped = members.join(found, F.col("id") == F.col("node"), "left").select("of", F.coalesce("component", "id").alias("group"))
    return signed.select("node", "n_shingles"), grouped


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    rows, given = _told_apart(docs.select("doc_id", "text"))
    sizes, grouped = _grouped(rows, width, percent, given is not None)
    out = sizes.join(grouped, F.col("node") == F.col("of"), "left").withColumn("group", F.coalesce("group", "node"))
    if given is None:
        out = out.withColumns({"doc_id": F.col("node"), "component_id": F.col("group")})
    else:
        out = cut(out.join(given, F.col("node") == F.col("alias"), "left").withColumn("doc_id", F.coalesce("of_id", "node")), "named")
        least = out.groupBy(F.col("group").alias("least_of")).agg(F.min("doc_id").alias("component_id"))
        out = out.join(least, F.col("group") == F.col("least_of"), "left")
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept: one for each group of near copies.

    It is one with the least doc_id of its group; of rows that agree in doc_id and text one stays. Rows
    that share a doc_id and differ in text each stand for themselves. Rows with a NULL doc_id all stay.
    """
    rows, given = _told_apart(docs)
    _, grouped = _grouped(rows, width, percent, given is not None)
    if given is not None:  # ids given out come before all others, so groups name their first anew
        grouped = cut(grouped.join(given, F.col("of") == F.col("alias"), "left"), "named")
        first = F.min_by("of", F.struct(F.coalesce("of_id", "of"), F.col("of")))
        grouped = grouped.join(grouped.groupBy(F.col("group").alias("of_group")).agg(first.alias("first")), F.col("group") == F.col("of_group"))
        grouped = grouped.select("of", F.col("first").alias("group"))
    gone = bounded(grouped.where("of <> group").select(F.col("of").alias("gone")))
    rows = rows.select("row", "node").join(gone, F.col("node") == F.col("gone"), "left_anti")
    if given is None:
        return rows.select("row.*")
    again = given.select(F.col("alias").alias("again"))
    single = rows.join(again, F.col("node") == F.col("again"), "left_anti").select("row.*")
    several = rows.join(again, F.col("node") == F.col("again"), "left_semi").groupBy("node").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.union(several.select("row.*"))
