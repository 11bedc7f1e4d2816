"""Mixing sources to target weights.

Every document gets a random key from a hash. Within a source the documents stand in the order of
their keys, distributed prefix sums of their word counts give each its place, and the source is cut
at exactly its budget: whole epochs first, then the documents before the cut once more, and of the
document at the cut the words up to it. Reruns give the same mix.

Sources by code point, NULL last, get ``weights`` in turn and share ``share`` of all words; a source
asked for more than ``most_epochs`` times its words stops there, and the others share the excess by
weight until none is above.

Cases: a NULL text has no words and is never taken; NULL is a source of its own; a NULL doc_id is
carried along; equal keys (ties, repeated rows) follow the doc_id, and rows that agree in everything
are interchangeable; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import WORD, numbered, whole
from postlake.session import cut

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.5, most_epochs: float = 2.0):
    """The words that each source is to give, from the words that it has."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    out, open_, rest = {}, list(names), share * sum(sizes.values())
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most_epochs * sizes[s]]
        if not above:
            return out | {s: unit * weight[s] for s in open_}
        for s in above:
            out[s] = most_epochs * sizes[s]
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most_epochs: float = 2.0, seed: str = "mix", rows_per_range: int = 4_000
) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, taken): the words that the mix takes of each row.

    ``docs`` has doc_id, text and source. Only one row per source passes through the driver.
    """
    sized = docs.select(
        "doc_id",
        "source",
        _key(seed).alias("key"),
        F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("size"),
    )
    sized = cut(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("words")).collect()
    sizes = {r["source"]: r["words"] for r in per_source}
    wanted = targets(sizes, weights, share, most_epochs)
    table = docs.sparkSession.createDataFrame(
        [(s, sizes[s], wanted[s]) for s in wanted], "of string, source_size long, target double"
    )
    most = max((r["rows"] for r in per_source), default=0)
    placed = numbered(sized, ["source"], "key", ["doc_id"], {"before": "size"}, most, rows_per_range)
    placed = placed.join(F.broadcast(table) if len(wanted) <= 100_000 else table, F.col("source").eqNullSafe(F.col("of")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    last = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("before")))
    return placed.select(
        "doc_id", "source", "key", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken")
    )


def _key(seed: str):
    """A random key that tells rows apart unless they agree in doc_id and text."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.coalesce(F.md5("text"), F.lit(""))))


def mixed_documents(docs: DataFrame, seed: str = "mix", **settings) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A document is repeated for every epoch that takes it; the one at a source's cut ends at the cut
    (and n_chars, if there, follows). Rows that agree in doc_id, source and text share what is taken
    of them in equal parts, and the words that are left over come from one of them.
    """
    takes = mix(docs, seed=seed, **settings).where("taken > 0")
    takes = takes.groupBy(F.col("key").alias("of_key"), F.col("source").alias("of_source")).agg(
        F.floor(F.sum("taken") / F.count("*")).alias("taken"), (F.sum("taken") % F.count("*")).alias("over"), F.max("size").alias("size")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), _key(seed).alias("key"), "source")
    rows = rows.join(takes, (F.col("key") == F.col("of_key")) & F.col("source").eqNullSafe(F.col("of_source")))
    one = F.min_by(F.struct("row", "size", F.col("over").alias("taken")), F.xxhash64("row")).alias("one")
    over = rows.where("over > 0").groupBy("key", "source").agg(one).select("one.*")
    rows = rows.where("taken > 0").select("row", "size", "taken").union(over)
    whole_times = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") - whole_times * F.col("size")).cast("int")
    parts = F.concat(F.array_repeat(F.col("size").cast("int"), whole_times), F.when(rest > 0, F.array(rest)).otherwise(F.array()))
    rows = rows.select("row", "size", F.explode(parts).alias("words"))
    start = F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("words"))
    text = F.when(F.col("words") < F.col("size"), F.array_join(start, "")).otherwise(F.col("row.text"))
    out = rows.select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast(dict(docs.dtypes).get("n_chars", "long")), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
