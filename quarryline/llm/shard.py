"""Sharding by a hierarchical weighted hash tree.

A row descends from the root: at each level every child draws an exponential variate -ln(u) / weight from a hash
of the row's key and the child's name, and the smallest draw wins, so a child is chosen in proportion to its
weight (the sum of the weights below it). A child's draw depends on its own name and weight alone: if weights
change in one subtree, rows move only into or out of that subtree and its ancestors' siblings keep their order,
and a child that is added beside others only takes rows. A tree is grown by one shard as a new branch at the
root, so all rows that move go into the new shard.

Null keys draw like one more key; repeated rows go where their key goes. Null texts have size 1 (their line end).
An empty table gives no rows. Other columns, whatever their names, pass through place() untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, rank_within, read_table, row_ids


@dataclass(frozen=True)
class Node:
    """A shard (a number and no children) or a group of them."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def balanced_tree(regions: int = 2, racks: int = 2, shards: int = 4, extra: int = 0) -> Node:
    """regions x racks x shards of equal weight, and `extra` shards that came later, each a branch of its own."""
    number, top = 0, []
    for r in range(regions):
        rows = []
        for k in range(racks):
            leaves = tuple(Node(f"r{r}/k{k}/s{i}", shard=number + i) for i in range(shards))
            number += shards
            rows.append(Node(f"r{r}/k{k}", tuple(leaves)))
        top.append(Node(f"r{r}", tuple(rows)))
    top += [Node(f"x{i}", shard=number + i) for i in range(extra)]
    return Node("root", tuple(top))


def draw(key: Column, child: Node) -> Column:
    """-ln(u) / weight with u in (0, 1] from the upper 52 bits of a hash; a weight of 0 never wins."""
    if child.weight <= 0:
        return F.lit(float("inf"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(child.name), key), 12) + 1).cast("double") / float(1 << 52)
    return -F.ln(u) / child.weight


def descend(key: Column, node: Node) -> Column:
    """The number of the shard below node that key goes to."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    best = F.array_min(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))
    chosen = best["i"]
    out = F.when(chosen == 0, descend(key, node.children[0]))
    for i, c in enumerate(node.children[1:], 1):
        out = out.when(chosen == i, descend(key, c))
    return out


def place(rows: DataFrame, tree: Node, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """rows with the int column `name`: the shard of each."""
    return rows.withColumn(name, descend(col(key), tree).cast("int"))


SHARDS = 16


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard of 16 by doc_id, its slot there, and its shard of 17."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    light = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(place(light, balanced_tree()), balanced_tree(extra=1), name="grown_shard")
    ranked = rank_within(row_ids(placed, "rid"), ["shard"], "rid", "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op5_shard": op5_shard}
ORACLE_SQL: dict[str, str] = {}
