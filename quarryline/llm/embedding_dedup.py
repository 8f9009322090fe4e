"""Near-duplicate embeddings by a pivot-permutation index.

Equal vectors are merged first. Reference points (pivots) are about 2 * sqrt(n) of the distinct vectors, at most
MOST_PIVOTS (and what vectors.PIVOT_BYTES hold), sampled by hash; every vector is then described by the ordered list of
its PREFIX nearest pivots. Candidates are pairs that share SHARED of these or more. Counting comes before any cosine,
and on the numbers of pivots alone: in one order of all pivots, the rarest first, two sets of PREFIX that share SHARED
have one in common among the first PREFIX - SHARED + 1 of each. So the inverted list of a pivot holds the vectors that
have it among those, and the longest lists are hardly used. A pair is verified by cosine in double precision in the
list of the rarest pivot it shares there, and every pair so found is linked.

A dense region draws many pivots, among which its vectors' prefixes scatter. So the pivots are thinned, in their
order, to leaders that have cosines below APART with each other: a group of near-copies holds about one of them,
whatever its share of the rows. Each vector is also in the cell of its nearest leader, and all pairs of a cell are
candidates, taken there and nowhere else. The tests hold recall on such groups against brute force (0.9 is required).

A list of any length is dealt into blocks of BLOCK rows and compared block pair by block pair, so no task holds more
than two blocks; what leaves it is a count of links per vector and a spanning forest, never all pairs.
Pivots (a stated, bounded sample) are all that the driver holds of the vectors.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing: n_links 0, their own
vec_id as component. Shorter vectors count as filled with zeros. Repeated rows are vectors that link with each
other; a row with a null vec_id links too but names no component and is not kept. Ties cannot arise: all links at
or above the threshold count. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, row_ids, settle, small_batches
from .components import connected_components
from .vectors import is_finite, pivots_for, sample_vectors, stack

THRESHOLD = 0.9
MOST_PIVOTS = 1 << 16
PREFIX = 16
SHARED = 3
APART = 0.7
BLOCK = 2048
#: Pairs whose prefixes are compared at once, and vectors that are copied to their lists at once.
PAIRS_AT_ONCE = 50_000
ROWS_AT_ONCE = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow or underflow on the way; rows of zeros stay."""
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k pivots of largest cosine of each row, nearest first (ties: the smaller number)."""
    k = min(k, len(pivots))
    out = []
    for at in range(0, len(x), 1024):
        s = np.round(x[at : at + 1024] @ pivots.T, 12)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.lexsort((near, -np.take_along_axis(s, near, 1)), axis=1)
        out.append(np.take_along_axis(near, order, 1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def leaders(pivots: np.ndarray) -> np.ndarray:
    """The pivots that are left if each one drops those after it that have a cosine of APART or more with it."""
    out, rest = [], np.arange(len(pivots))
    while len(rest):
        out.append(rest[0])
        rest = rest[1:][pivots[rest[1:]] @ pivots[rest[0]] < APART]
    return pivots[out]


def index(rows: DataFrame, pivots: np.ndarray, width: int, kind: str) -> DataFrame:
    """(node, n, vec, prefix): each distinct vector's numbers (of numpy kind `kind`), its cell and its nearest pivots in order.

    The cell comes first in prefix, as a number below zero.
    """
    heads = leaders(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = stack(b.column("embedding"), width)
            u = unit(x)
            prefix = np.c_[-1 - nearest(u, heads, 1), nearest(u, pivots, PREFIX)].astype(np.int32)
            vec = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), vec, pa.array(list(prefix), pa.list_(pa.int32()))], ["node", "n", "vec", "prefix"])

    return rows.select("node", "n", "embedding").mapInArrow(run, "node long, n long, vec binary, prefix array<int>")


def linked_pairs(xa: np.ndarray, pa_: np.ndarray, xb: np.ndarray, pb: np.ndarray, pivot: int, threshold: float) -> np.ndarray:
    """Which pairs are linked and belong to this pivot's list: a boolean matrix.

    A pair belongs to its cell's list, if both are of one cell, else to that of the first pivot that both are indexed by.
    """
    near = xa @ xb.T >= threshold
    if pivot < 0:
        return near
    near &= pa_[:, :1] != pb[:, 0]
    pa_, pb = pa_[:, 1:], pb[:, 1:]
    left, right = np.nonzero(near)
    for at in range(0, len(left), PAIRS_AT_ONCE):
        i, j = left[at : at + PAIRS_AT_ONCE], right[at : at + PAIRS_AT_ONCE]
        both = (pa_[i][:, :, None] == pb[j][:, None, :]).any(2)
        near[i, j] = np.where(both, pa_[i], np.iinfo(np.int32).max).min(1) == pivot
    return near


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    out, rest = [], np.ones(len(near), bool)
    for i in range(len(near)):
        if not rest[i]:
            continue
        front, rest[i] = [i], False
        while front:
            x = front.pop()
            found = np.flatnonzero(near[x] & rest)
            rest[found] = False
            out += [(x, int(y)) for y in found]
            front += found.tolist()
    return out


def _block_pair(threshold: float, kind: str):
    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        pivot, i, j = (k.as_py() for k in key)
        nodes, n, block = (rows.column(c).to_numpy() for c in ("node", "n", "block"))
        x = unit(np.frombuffer(b"".join(rows.column("vec").to_pylist()), kind).reshape(len(nodes), -1).astype(float))
        prefix = rows.column("prefix").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
        near = np.zeros((len(nodes), len(nodes)), bool)
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(a) and len(b):
            near[np.ix_(a, b)] = linked_pairs(x[a], prefix[a], x[b], prefix[b], pivot, threshold)
            near |= near.T
        np.fill_diagonal(near, False)
        links = near @ n
        some = np.flatnonzero(links)
        edges = np.array(forest(near) if len(some) else [], np.int64).reshape(-1, 2)
        columns = {
            "a": np.r_[nodes[some], nodes[edges[:, 0]]],
            "b": np.r_[np.full(len(some), -1), nodes[edges[:, 1]]],
            "links": np.r_[links[some], np.zeros(len(edges))],
        }
        return pa.table({k: pa.array(v.astype(np.int64)) for k, v in columns.items()})

    return compare


def rarest_first(sizes: dict[int, int], n: int) -> np.ndarray:
    """The place of each of n pivots in the order of how many vectors have it in their prefix."""
    order = sorted(range(n), key=lambda p: (sizes.get(p, 0), p))
    place = np.zeros(n, np.int32)
    place[order] = np.arange(n)
    return place


def deal(indexed: DataFrame, place: np.ndarray, blocks: dict[int, int]) -> DataFrame:
    """Each vector once for its cell and each pivot it is indexed by (as places), and each pair of blocks of that list it takes part in."""
    used = max(1, min(PREFIX, len(place)) - SHARED + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                nodes = b.column("node").to_numpy()
                prefix = b.column("prefix").flatten().to_numpy().reshape(len(nodes), -1)
                prefix = np.c_[prefix[:, 0], np.sort(place[prefix[:, 1:]], axis=1)[:, :used]]
                rows, p, i, j, block = [], [], [], [], []
                for r in range(len(nodes)):
                    for pivot in prefix[r].tolist():
                        nb = blocks.get(pivot, 1)
                        own = (int(nodes[r]) * 0x9E3779B97F4A7C15 >> 20) % nb
                        for other in range(nb):
                            rows.append(r)
                            p.append(pivot)
                            i.append(min(own, other))
                            j.append(max(own, other))
                            block.append(own)
                taken = b.take(pa.array(rows, pa.int64()))
                lists = pa.array(list(prefix[rows]), pa.list_(pa.int32()))
                arrays = [*(pa.array(x, pa.int32()) for x in (p, i, j, block)), *(taken.column(c) for c in ("node", "n", "vec")), lists]
                yield pa.RecordBatch.from_arrays(arrays, ["pivot", "i", "j", "block", "node", "n", "vec", "prefix"])

    return indexed.mapInArrow(run, "pivot int, i int, j int, block int, node long, n long, vec binary, prefix array<int>")


def dedup_vectors(vectors: DataFrame, threshold: float = THRESHOLD, n_pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding). n_pivots: in place of the rule's number."""
    small_batches(vectors.sparkSession)
    light = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    valid = is_finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    distinct = light.where(valid).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    distinct = row_ids(distinct, "node")
    count, width = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
    alone = light.select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    )
    if not count:
        return alone
    pivots = unit(sample_vectors(distinct, "embedding", n_pivots or pivots_for(count, MOST_PIVOTS, width), width))
    kind = "<f4" if dict(distinct.dtypes)["embedding"] == "array<float>" else "<f8"
    indexed = settle(index(distinct, pivots, width, kind))
    held = indexed.select(F.explode("prefix").alias("pivot")).groupBy("pivot").count().collect()  # one row a pivot
    sizes = {r["pivot"]: r["count"] for r in held}
    place = rarest_first(sizes, len(pivots))
    lists = {p if p < 0 else int(place[p]): n for p, n in sizes.items()}  # a list holds at most all that have its pivot
    blocks = {p: -(-n // BLOCK) for p, n in lists.items() if n > BLOCK}
    found = settle(
        deal(indexed, place, blocks)
        .groupBy("pivot", "i", "j")
        .applyInArrow(_block_pair(threshold, kind), "a long, b long, links long")
    )
    parts = settle(connected_components(found.where("b >= 0").select("a", "b")))
    links = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = distinct.join(links, "node", "left").join(parts, "node", "left")
    named = settle(
        named.select("embedding", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    )
    smallest = settle(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = settle(named.join(smallest, "component").select("embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"))
    linked = (
        light.where(valid)
        .join(named, "embedding")
        .select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )
    rest = light.where(~valid | valid.isNull()).select("vec_id")
    return linked.unionByName(
        rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and keep mark of every embedding."""
    return dedup_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLE_SQL: dict[str, str] = {}
