"""Sharding by a hierarchical weighted hash tree.

A row descends from region to rack to shard. At each level every child draws -ln(u) / weight with u
from a hash of the child's name and the row's key, and the least draw wins, so a child gets rows in
proportion to its weight. A draw depends on nothing but the child, its weight and the key: a changed
weight moves rows only into or out of the children whose weight changed, and inside a subtree that
kept its weights nothing moves.

A shard hung into an old rack would raise the weights above it and draw rows into its siblings too,
so a tree grows by a region of its own (`grown`): rows then move only into the new shard.

Cases: a NULL text has no bytes (size 1) and the checksum of the empty text; a row with a NULL doc_id
is placed by its text; equal keys (repeated rows) go to one shard and follow each other; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.once import with_once
from postlake.llm.common import numbered, whole
from postlake.session import cut


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard with a number and a weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(regions: int = 2, racks: int = 2, shards: int = 4) -> Node:
    """A tree of equal shards, numbered from 0."""
    number = iter(range(regions * racks * shards))
    return Node(
        "root",
        tuple(
            Node(f"region{r}", tuple(
                Node(f"region{r}/rack{k}", tuple(Node(f"shard{n}", shard=n) for _, n in zip(range(shards), number)))
                for k in range(racks)
            ))
            for r in range(regions)
        ),
    )


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a rack and a region of its own."""
    n = max(x.shard for x in leaves(root)) + 1
    shard = Node(f"shard{n}", shard=n, own_weight=weight)
    region = Node(f"region-of-{n}", (Node(f"region-of-{n}/rack0", (shard,)),))
    return Node(root.name, (*root.children, region))


def _unit(name: str, key: Column) -> Column:
    """A number in (0, 1) from a hash of a node's name and the key."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(name), key)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(16**13)


def descend(node: Node, key: Column) -> Column:
    """The shard that the key ends in."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(node.children[0], key)
    draws = [
        F.struct((-F.log(_unit(c.name, key)) / F.lit(c.weight)).alias("draw"), F.lit(n).alias("child"))
        for n, c in enumerate(node.children)
        if c.weight > 0
    ]
    won = F.array_min(F.array(*draws))["child"]
    below = [descend(c, key) for c in node.children]
    if all(not c.children for c in node.children):
        return F.element_at(F.array(*below), won + 1)
    return F.transform(F.array(won), lambda w: _case(w, below))[0]


def _case(won: Column, below: list[Column]) -> Column:
    out = F.when(won == 0, below[0])
    for n, b in enumerate(below[1:], 1):
        out = out.when(won == n, b)
    return out


def assign(docs: DataFrame, root: Node, rows_per_chunk: int = 20_000) -> DataFrame:
    """(doc_id, key, size, text_crc32, shard, slot, grown_shard) for every row.

    Slots number a shard's rows from 0 in the order of a random key, by distributed counts.
    """
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(whole("text"))))
    placed = docs.select(
        "doc_id",
        own.alias("own"),
        F.md5(F.concat_ws("|", F.lit("slot"), own, F.md5(whole("text")))).alias("key"),
        (F.octet_length(whole("text")) + 1).cast("long").alias("size"),
        F.crc32(whole("text").cast("binary")).alias("text_crc32"),
    )
    placed = with_once(placed, "shard", descend(root, F.col("own")))
    placed = with_once(placed, "grown_shard", descend(grown(root), F.col("own")))
    placed = cut(placed.drop("own").withColumn("one", F.lit(1).cast("long")), "shards")
    most = placed.groupBy("shard").count().agg(F.max("count")).collect()[0][0] or 0
    return numbered(placed, ["shard"], "key", ["doc_id"], {"slot": "one"}, most, rows_per_chunk).drop("one")


def digest(assigned: DataFrame) -> DataFrame:
    """The contract's columns of `assign`."""
    return assigned.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
