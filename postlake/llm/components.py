"""Connected components of a links table, without collecting it anywhere.

Links are first reduced, Arrow batch by Arrow batch, by union-find to spanning forests. Then two steps repeat
until all trees are flat: every node hangs its larger neighbours on its least one (large star), and its
smaller neighbours and itself on the least of them (small star). Trees get flat in a logarithmic
number of rounds. A node with very many neighbours is a sum of partial minima and a join that Spark
may split; nothing gathers its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.session import cut

_EDGES = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent=parent) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        pairs = [(x, find(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"]
        )


def _hung(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b) after one step."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).withColumn("m", F.least("node", "m"))
    side = both.join(least, F.col("a") == F.col("node"))
    if large:
        out = side.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = side.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a != b").distinct()


def _is_flat(edges: DataFrame) -> bool:
    """Whether every node that hangs on another hangs on one only, on which all others of its tree hang too."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    both = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.where("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of ``links`` (a, b) the least node it is connected with.

    Nodes without links are not listed; links of a node with itself count for nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    edges = cut(edges.mapInArrow(_forest, _EDGES), "forest")
    while not _is_flat(edges):
        edges = cut(_hung(_hung(edges, large=True), large=False), "stars")
    tails = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tails.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
