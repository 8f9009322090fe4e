import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.llm import common
from quarryline.llm.common import rank_within, row_ids
from quarryline.llm.shard import Node, balanced_tree, op5_shard, place


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_shard(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.doc_id, r.shard, r.grown_shard) for r in op5_shard(spark, sf_dir).collect()} == {(r.doc_id, r.shard, r.grown_shard) for r in rows}


def test_placement_equals_a_plain_descent(spark):
    """Every row by a walk from the root: the smallest of -ln(u) / weight, u from the hash of the child's name and the key."""
    tree = balanced_tree(extra=1)
    names = []

    def collect(node):
        for c in node.children:
            names.append(c.name)
            collect(c)

    collect(tree)
    hashed = spark.range(500).select("id", *[F.xxhash64(F.lit(n), F.col("id")).alias(str(i)) for i, n in enumerate(names)]).collect()
    got = {r.doc_id: r.shard for r in place(spark.range(500).withColumnRenamed("id", "doc_id"), tree).collect()}

    def weight(node):
        return sum(map(weight, node.children)) if node.children else node.own_weight

    for r in hashed:
        node = tree
        while node.children:
            draws = []
            for c in node.children:
                h = r[str(names.index(c.name))] % (1 << 64)
                draws.append((-math.log(((h >> 12) + 1) / (1 << 52)) / weight(c), c.name, c))
            node = min(draws, key=lambda d: d[0])[2]
        assert got[r.id] == node.shard


def shards_of(spark, tree, n=8000):
    return [r.shard for r in place(spark.range(n).withColumnRenamed("id", "doc_id"), tree).orderBy("doc_id").collect()]


@pytest.mark.parametrize("extra", [0, 1, 4])
def test_one_more_shard_takes_rows_only_into_itself(spark, extra):
    now, then = shards_of(spark, balanced_tree(extra=extra)), shards_of(spark, balanced_tree(extra=extra + 1))
    moved = [(a, b) for a, b in zip(now, then, strict=True) if a != b]
    assert moved and {b for _, b in moved} == {16 + extra}
    share = len(moved) / len(now)
    assert abs(share - 1 / (17 + extra)) < 0.02


def test_shares_follow_weights_and_movement_stays_in_its_subtree(spark):
    def tree(w):
        left = Node("l", (Node("l/a", shard=0, own_weight=w), Node("l/b", shard=1, own_weight=4 - w)))
        return Node("root", (left, Node("r", (Node("r/a", shard=2, own_weight=3), Node("r/b", shard=3, own_weight=1)))))

    one, two = shards_of(spark, tree(1)), shards_of(spark, tree(2))
    n = Counter(one)
    assert [round(n[s] / len(one) * 8) for s in range(4)] == [1, 3, 3, 1]
    assert {(a, b) for a, b in zip(one, two, strict=True) if a != b} == {(1, 0)}
    gone = shards_of(spark, tree(0))
    assert 0 not in gone and {(a, b) for a, b in zip(one, gone, strict=True) if a != b} == {(0, 1)}


def test_edge_rows(spark):
    rows = [(None, None, 1), (None, "x", 2), (1, "", 3), (1, "a" * 300_000, 4), (1, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid int")
    placed = place(docs, balanced_tree())
    assert placed.columns == [*docs.columns, "shard"] and placed.where("shard is null").count() == 0
    assert len({r.shard for r in placed.where("doc_id = 1").collect()}) == 1
    assert place(docs.limit(0), balanced_tree()).count() == 0


def test_ranks_are_gapless_whatever_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BITS", 3)
    hot = spark.range(0, 1000, 1, 7).withColumn("key", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2))
    ranked = rank_within(row_ids(hot.withColumn("chunk", F.lit("x")), "r"), ["key"], "r", "rank").collect()
    by = {}
    for r in ranked:
        by.setdefault(r.key, []).append((r.r, r["rank"]))
    assert all([k for _, k in sorted(v)] == list(range(len(v))) for v in by.values())
    assert len(ranked) == 1000 and set(ranked[0].asDict()) == {"id", "key", "chunk", "r", "rank"}
