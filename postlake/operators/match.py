"""Which stored posting an incoming row belongs to.

The steps of the cascade differ only in the key they compare, so every row is turned into its
keys, each tagged with its step, and one equi-join serves all steps. The stored side is reduced
to the best posting per key first. A key shared by a third of all postings is then one row, no
pairs are made within a key, and nothing has to be dropped to escape such a key.

Keys are pairs of 64-bit hashes of the compared columns, and postings get numbers in the order in
which they win, so all that is aggregated and joined are whole numbers.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.urls import with_address
from postlake.session import cut
from postlake.sources.pages import usable_link

#: Steps in the order in which they are tried.
IDENTITY, OBSERVED, CANONICAL, SOURCE_URL, APPLICATION, SHARED_URL, CONTENT = range(7)
#: What the cascade reads of an incoming row.
COMPARED = (
    "batch_seq", "source_key", "source_item_id", "canonical_url", "source_url", "apply_url", "explicit",
    "institution", "country", "title", "deadline", "content_hash",
)
#: A step and a posting's number in one: whole numbers are told apart by their leading bits.
_STEP_BITS = 59


def with_application(rows: DataFrame) -> DataFrame:
    """Add ``apply_usable`` (the address may be applied at) and ``explicit`` (and is not the page)."""
    none = F.lit(None).cast("struct<host:string,path:string>")
    rows = with_address(rows, "apply_url", "__apply")
    rows = rows.withColumn("apply_usable", usable_link(F.col("apply_url"), F.col("__apply"), none))
    return rows.drop("__apply").withColumn("explicit", explicit_application(F.col))


def explicit_application(get) -> Column:
    """``explicit`` from ``apply_usable`` and the addresses of the row itself."""
    differs = lambda a, b: ~F.coalesce(a.eqNullSafe(b), F.lit(False))
    return (
        F.coalesce(get("apply_usable"), F.lit(False))
        & differs(get("apply_url"), get("source_url"))
        & differs(get("apply_url"), get("canonical_url"))
    )


def _key(tag: str, *parts: Column) -> Column:
    """Tagged key, NULL if any part is NULL."""
    stated = [p.isNotNull() for p in parts]
    both = F.struct(F.xxhash64(F.lit(tag), *parts).alias("high"), F.xxhash64(F.lit(f"{tag} again"), *parts).alias("low"))
    return F.when(reduce(and_, stated), both)


def _title_key() -> Column:
    return _key("t", F.lower("institution"), F.lower("title"), F.col("deadline"))


def _hash_key() -> Column:
    return _key("h", F.col("content_hash"), F.lower("institution"), F.lower("country"))


def _of(pairs: list[tuple[int, Column]], steps: tuple[int, ...]) -> list[tuple[int, Column]]:
    """The pairs of ``steps``, all if none are named. A key meets only keys of its own step."""
    return [(s, k) for s, k in pairs if not steps or s in steps]


def own_keys(*steps: int) -> list[Column]:
    """Keys under which a posting can be found by its own columns, of some steps or all."""
    pairs = [
        (IDENTITY, _key("i", F.col("source_key"), F.col("source_item_id"))),
        (CANONICAL, _key("c", F.col("source_key"), F.col("canonical_url"))),
        (SOURCE_URL, _key("u", F.col("source_url"))),
        (APPLICATION, _key("a", F.col("apply_url"))),
        (SHARED_URL, _key("k", F.col("canonical_url"))),
        (CONTENT, _title_key()),
        (CONTENT, _hash_key()),
    ]
    return [k for _, k in _of(pairs, steps)]


def search_keys(*steps: int) -> Column:
    """Keys an incoming row looks for in some steps, each with its step; NULL where it has none."""
    item = F.col("source_item_id")
    is_reference = item.rlike("[A-Za-z]") & item.rlike("[0-9]")
    pairs = [
        (IDENTITY, _key("i", F.col("source_key"), item)),
        (OBSERVED, _key("o", F.col("source_key"), item)),
        (CANONICAL, _key("c", F.col("source_key"), F.nullif("canonical_url", F.lit("")))),
        (SOURCE_URL, _key("u", F.nullif("source_url", F.lit("")))),
        (APPLICATION, F.when(F.col("explicit"), _key("a", F.col("apply_url")))),
        (SHARED_URL, _key("k", F.col("canonical_url"))),
        (CONTENT, F.when(is_reference, _key("r", F.lower("institution"), item))),
        (CONTENT, _title_key()),
        (CONTENT, _hash_key()),
    ]
    return F.array(*[F.struct(F.lit(s).alias("step"), k.alias("key")) for s, k in _of(pairs, steps)])


def observed_keys(*steps: int) -> list[Column]:
    """Keys under which a posting can be found by an observation of it, of some steps or all."""
    pairs = [
        (OBSERVED, _key("o", F.col("source_key"), F.col("source_item_id"))),
        (CONTENT, _key("r", F.lower("institution"), F.col("source_item_id"))),
    ]
    return [k for _, k in _of(pairs, steps)]


def stored_keys(jobs: DataFrame, observations: DataFrame) -> DataFrame:
    """(high, low, first_seen_at, job_id) of every collected posting, through its own columns and
    through its observations."""
    own = jobs.where((F.col("origin_type") == "collected") & ~F.col("is_demo"))
    direct = own.select(
        F.explode(F.array(*own_keys())).alias("key"), "first_seen_at", F.col("id").alias("job_id")
    )
    seen = observations.select("job_id", "source_key", "source_item_id").join(
        own.select(F.col("id").alias("job_id"), "first_seen_at", "institution"), "job_id"
    )
    observed = seen.select(F.explode(F.array(*observed_keys())).alias("key"), "first_seen_at", "job_id")
    return direct.unionByName(observed).where(F.col("key").isNotNull()).select("key.high", "key.low", "first_seen_at", "job_id")


def wanted_keys(incoming: DataFrame, *steps: int) -> DataFrame:
    """(batch_seq, step, high, low): the keys that incoming rows look for in some steps."""
    wanted = incoming.select("batch_seq", F.inline(search_keys(*steps))).where(F.col("key").isNotNull())
    return wanted.select("batch_seq", "step", "key.high", "key.low")


def in_order(jobs: DataFrame) -> DataFrame:
    """(job_id, no): numbers of postings that grow with the time they were first seen, then with their id."""
    slim = jobs.where((F.col("origin_type") == "collected") & ~F.col("is_demo")).select("first_seen_at", F.col("id").alias("job_id"))
    sorted_ = slim.repartitionByRange("first_seen_at", "job_id").sortWithinPartitions("first_seen_at", "job_id")
    return cut(sorted_.select("job_id", F.monotonically_increasing_id().alias("no")), "order")


def match_step(incoming: DataFrame, jobs: DataFrame, observations: DataFrame, *steps: int) -> DataFrame:
    """First hit among the given steps per incoming row: ``batch_seq, job_id, step``.

    Within a step the posting first seen wins, then the smaller id. Rows without a hit are left
    out. Stored keys are reduced to their best posting in each task before anything is shuffled, so
    a key that a third of the postings share is a row from each task.
    """
    if jobs.isEmpty():
        return incoming.sparkSession.createDataFrame([], "batch_seq long, job_id string, step int")
    wanted = wanted_keys(incoming, *steps)
    order = in_order(jobs)
    own = jobs.join(order, F.col("id") == F.col("job_id"))
    sides = []
    if direct := own_keys(*steps):
        sides.append(own.select(F.explode(F.array(*direct)).alias("key"), "no"))
    if observed := observed_keys(*steps):
        known = own.select(F.col("id").alias("job_id"), "institution", "no")
        seen = observations.select("job_id", "source_key", "source_item_id").join(known, "job_id")
        sides.append(seen.select(F.explode(F.array(*observed)).alias("key"), "no"))
    keys = reduce(DataFrame.union, sides).where(F.col("key").isNotNull())
    best = keys.groupBy("key.high", "key.low").agg(F.min("no").alias("no"))
    first = (
        wanted.join(best, ["high", "low"])
        .groupBy("batch_seq")
        .agg(F.min(F.shiftleft(F.col("step").cast("long"), _STEP_BITS) + F.col("no")).alias("first"))
        .select("batch_seq", F.col("first").bitwiseAND(F.lit((1 << _STEP_BITS) - 1)).alias("no"), F.shiftright("first", _STEP_BITS).cast("int").alias("step"))
    )
    return first.join(order, "no").select("batch_seq", "job_id", "step")


def match_cascade(incoming, jobs, observations) -> DataFrame:
    """First hit of the whole cascade."""
    return match_step(incoming, jobs, observations, *range(7))


def match_identity(incoming, jobs, observations) -> DataFrame:
    return match_step(incoming, jobs, observations, IDENTITY, OBSERVED)


def match_canonical(incoming, jobs, observations) -> DataFrame:
    return match_step(incoming, jobs, observations, CANONICAL)


def match_source_url(incoming, jobs, observations) -> DataFrame:
    return match_step(incoming, jobs, observations, SOURCE_URL)


def match_cross_source(incoming, jobs, observations) -> DataFrame:
    return match_step(incoming, jobs, observations, APPLICATION, SHARED_URL, CONTENT)


def identity_firsts(incoming: DataFrame) -> DataFrame:
    """(batch_seq, id, first, first_id): each row with the first row of its identity, itself if it has none."""
    item = ["source_key", "source_item_id"]
    stated = F.col("source_key").isNotNull() & F.col("source_item_id").isNotNull()
    firsts = incoming.where(stated).groupBy(*item).agg(F.min(F.struct("batch_seq", "id")).alias("head"))
    return incoming.select("batch_seq", "id", *item).join(firsts, item, "left").select(
        "batch_seq", "id", F.coalesce("head.batch_seq", "batch_seq").alias("first"),
        F.when(F.col("head").isNotNull(), F.col("head.id")).otherwise(F.col("id")).alias("first_id"),
    )


#: Steps in which rows of different identity can meet inside a batch.
_BEYOND_IDENTITY = (CANONICAL, SOURCE_URL, APPLICATION, SHARED_URL, CONTENT)


def _near_rows(incoming: DataFrame) -> DataFrame:
    """The rows of a batch that share a key with a row of another identity, and all without identity.

    Only these can lead or follow beyond their identity. A key is told by half its hash here, so a row
    may be near without need but none is missed; keys that one identity alone holds go no further.
    """
    stated = F.col("source_key").isNotNull() & F.col("source_item_id").isNotNull()
    owner = F.when(stated, F.xxhash64("source_key", "source_item_id")).otherwise(F.xxhash64("batch_seq"))
    # A canonical address shared within a source is one shared at all.
    held = [k["high"] for k in (*own_keys(SOURCE_URL, APPLICATION, SHARED_URL, CONTENT), *observed_keys(CONTENT))]
    keys = incoming.select("batch_seq", owner.alias("owner"), F.explode(F.array(*held)).alias("high")).where(F.col("high").isNotNull())
    shared = cut(
        keys.groupBy("high").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least <> most").select("high"),
        "shared",
    )
    near = incoming.where(~stated).select("batch_seq")
    if not shared.isEmpty():
        near = near.union(keys.join(shared, "high", "left_semi").select("batch_seq").distinct()).distinct()
    rows = incoming.select(*COMPARED)
    return cut(rows.join(cut(near, "near"), "batch_seq", "left_semi"), "near-rows")


def found_leaders(incoming: DataFrame, firsts: DataFrame) -> DataFrame:
    """``batch_seq, leader, step`` of first rows that match an earlier row by more than their identity."""
    near = _near_rows(incoming)
    searching = near.join(firsts.where(F.col("first") < F.col("batch_seq")).select("batch_seq"), "batch_seq", "left_anti")
    own = (*own_keys(*_BEYOND_IDENTITY), *observed_keys(CONTENT))
    first = (
        near.select("batch_seq", F.explode(F.array(*own)).alias("key"))
        .where(F.col("key").isNotNull())
        .groupBy("key.high", "key.low")
        .agg(F.min("batch_seq").alias("leader"))
    )
    return (
        wanted_keys(searching, *_BEYOND_IDENTITY).join(first, ["high", "low"])
        .where(F.col("leader") < F.col("batch_seq"))
        .groupBy("batch_seq")
        .agg(F.min(F.struct("step", "leader")).alias("best"))
        .select("batch_seq", F.col("best.leader").alias("leader"), F.col("best.step").alias("step"))
    )


def batch_leaders(incoming: DataFrame) -> DataFrame:
    """For each row, the earlier row of the batch it would match by the cascade:
    ``batch_seq, leader, step``.

    A row that repeats an identity follows the first row of it, as no step comes before; so only first
    rows, and rows without an identity, look for their other keys.
    """
    firsts = cut(identity_firsts(incoming), "firsts")
    repeats = firsts.where(F.col("first") < F.col("batch_seq")).select(
        "batch_seq", F.col("first").alias("leader"), F.lit(IDENTITY).alias("step")
    )
    return repeats.unionByName(found_leaders(incoming, firsts))


def link_runs(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs with the request they serve; ``reject_reason`` marks runs that may not proceed."""
    owner = requests.groupBy("collection_run_id").agg(
        F.min("id").alias("request_id"), F.max_by("status", "requested_at").alias("request_status")
    ).where(F.col("collection_run_id").isNotNull())
    return runs.join(owner, "collection_run_id", "left").withColumn(
        "reject_reason",
        F.when(F.col("request_id").isNull(), "orphan run").when(
            F.col("request_status").isin("success", "partial", "no_results", "failed"), "request closed"
        ),
    )
