"""Nearest neighbours by inner product with vantage-point trees.

Inner products are turned into distances: with one more coordinate sqrt(M^2 - |x|^2), M the largest
norm of a shard, every vector has norm M, and a query q (with 0 there) is at distance
sqrt(|q|^2 + M^2 - 2 q.x), least where the inner product is largest. Distances obey the triangle
inequality, so a subtree whose vectors lie between lo and hi from its vantage point is no nearer to a
query at distance d from that point than max(d - hi, lo - d). A subtree is skipped if ``factor``
times this bound exceeds the query's worst distance so far: factor 1 is exact, larger factors skip
more.

Vectors are spread over shards of a bounded number of rows by a hash of their id, queries over blocks
of a bounded number; every (shard, block) is one group that builds the shard's tree and answers the
block. Equal vectors of a shard are one point of the tree. Scores are computed anew from the original
vectors in double precision, coordinate by coordinate, so equal vectors have equal scores.

Cases: vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor do rows
without vec_id; rows that repeat a vec_id count once, with the least vector; queries compare with
vectors of their own dimension; ties go to the smaller vec_id; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.session import cut

ROWS_PER_SHARD = 4096
QUERIES_PER_BLOCK = 4096
#: Beyond 1, subtrees are skipped that may still hold a neighbour. Measured recall is in the README.
FACTOR = 1.1
_LEAF = 128


class VantagePointTree:
    """Over the rows of ``points`` (doubles), all of norm ``radius`` once they get one more coordinate."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.points = points
        square = np.einsum("ij,ij->i", points, points)
        self.square = float(square.max(initial=0.0))
        self.extra = np.sqrt(np.maximum(self.square - square, 0.0))
        self._random = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.root = self._grow(np.arange(len(points)))

    def _from(self, center: int, rows: np.ndarray) -> np.ndarray:
        inner = self.points[rows] @ self.points[center] + self.extra[rows] * self.extra[center]
        return np.sqrt(np.maximum(2 * self.square - 2 * inner, 0.0))

    def _grow(self, rows: np.ndarray) -> int:
        """The node over ``rows``: a leaf, or a vantage point with an inner and an outer half."""
        if len(rows) <= _LEAF:
            self.nodes.append((None, rows))
            return len(self.nodes) - 1
        tries = self._random.choice(rows, min(4, len(rows)), replace=False)
        spread = [self._from(int(t), rows) for t in tries]
        best = int(np.argmax([d.std() for d in spread]))
        center, away = int(tries[best]), spread[best]
        order = np.argsort(away, kind="stable")
        order = order[rows[order] != center]
        halves = []
        for part in np.array_split(order, 2):
            halves.append((float(away[part[0]]), float(away[part[-1]]), self._grow(rows[part])))
        self.nodes.append((center, halves))
        return len(self.nodes) - 1

    def nearest(self, queries: np.ndarray, k: int, factor: float = FACTOR) -> np.ndarray:
        """For each query the rows of about its k nearest points, -1 where there are fewer."""
        base = np.einsum("ij,ij->i", queries, queries) + self.square
        found = np.full((len(queries), k), np.inf)
        rows = np.full((len(queries), k), -1, dtype=np.int64)

        def offer(active: np.ndarray, among: np.ndarray) -> np.ndarray:
            away = np.sqrt(np.maximum(base[active, None] - 2 * (queries[active] @ self.points[among].T), 0.0))
            every = np.concatenate([found[active], away], axis=1)
            names = np.concatenate([rows[active], np.broadcast_to(among, away.shape)], axis=1)
            keep = np.argpartition(every, k - 1, axis=1)[:, :k]
            found[active] = np.take_along_axis(every, keep, axis=1)
            rows[active] = np.take_along_axis(names, keep, axis=1)
            return away

        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            node, active, bound = todo.pop()
            going = factor * bound <= found[active].max(axis=1)
            active = active[going]
            if not len(active):
                continue
            center, content = self.nodes[node]
            if center is None:
                if len(content):
                    offer(active, content)
                continue
            away = offer(active, np.array([center]))[:, 0]
            inside = away <= (content[0][1] + content[1][0]) / 2
            for nearer in (False, True):  # put last, the nearer half of each query is worked off first
                for (low, high, child), own in zip(content, (inside, ~inside), strict=True):
                    chosen = own if nearer else ~own
                    d = away[chosen]
                    todo.append((child, active[chosen], np.maximum(np.maximum(d - high, low - d), 0.0)))
        return rows


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, summed coordinate by coordinate."""
    out = np.zeros(len(left))
    for d in range(left.shape[1]):
        out += left[:, d] * right[:, d]
    return out


_HITS = "query_id long, vec_id long, score double"


def search_shard(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, factor: float) -> pd.DataFrame:
    """The k best vectors of one shard for each query of one block."""
    if not len(queries) or not len(vectors):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    vectors = vectors.sort_values("vec_id")
    ids = vectors["vec_id"].to_numpy()
    points, of_row = np.unique(np.stack(vectors["embedding"].to_numpy()).astype(np.float64), axis=0, return_inverse=True)
    order = np.argsort(of_row, kind="stable")  # members of a point by id
    first = np.searchsorted(of_row[order], np.arange(len(points) + 1))
    asked = np.stack(queries["embedding"].to_numpy()).astype(np.float64)
    rows = VantagePointTree(points).nearest(asked, min(len(points), k + 8), factor)
    out = []
    which, slot = np.nonzero(rows >= 0)
    hit = rows[which, slot]
    scores = exact_scores(asked[which], points[hit])
    copies = np.minimum(first[hit + 1] - first[hit], k + 1)  # more copies of one point can't be among the k best
    rep = np.repeat(np.arange(len(hit)), copies)
    nth = np.arange(len(rep)) - np.repeat(np.cumsum(copies) - copies, copies)
    out = pd.DataFrame(
        {
            "query_id": queries["vec_id"].to_numpy()[which[rep]],
            "vec_id": ids[order[first[hit[rep]] + nth]],
            "score": scores[rep],
        }
    )
    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.groupby("query_id").head(k)


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    factor: float = FACTOR,
    rows_per_shard: int = ROWS_PER_SHARD,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all other vectors for each vec_id divisible by ``every``."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    taken = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").where(sound)
    taken = cut(taken.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vectors")
    n_vectors, n_queries = taken.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).collect()[0]
    shards = max(1, math.ceil(n_vectors / rows_per_shard))
    blocks = max(1, math.ceil(n_queries / queries_per_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = taken.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    left = left.select("*", each(shards).alias("shard"))
    right = taken.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).select("*", each(blocks).alias("block"))
    keys = ("dim", "shard", "block")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, v: search_shard(q, v, k, factor), _HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
