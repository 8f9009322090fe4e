"""Exact top-k inner products by a Voronoi kNN join.

Components become integers floor(SCALE * x); a score is their inner product. Pivots split all rows into Voronoi
cells. Per cell, the summaries that bound the join are its number of rows, its number of queries, their greatest
distance R from the pivot p, and a threshold: every query is first solved exactly against the SEEDS rows (by hash) of
its own cell and of the cells whose pivots score highest with p, until these hold a few times k; the k-th best so found
can only rise, and the least of a cell's queries is the threshold t. For every row x and query q of the cell

    q.x  <=  p.x + R |x|

so x is needed for a cell only if that bound reaches t. Cells with queries, near ones together, form groups of about
QUERY_BLOCK queries; a row is copied once to each group that has a cell which needs it, and nowhere else. The rows that
a group needs are counted first, and dealt by that count into blocks of DATA_BLOCK, its queries into blocks of
QUERY_BLOCK; each pair of blocks is solved by one matrix product, exactly, and keeps k rows a query, of which a window
per query takes the best. No task holds more than two blocks. Where vectors form clusters a row goes to the groups near
it; where they point all ways alike no bound can spare any, and each group needs all rows once.

Queries are the rows whose vec_id is divisible by EVERY; candidates are all other rows, rows that repeat a query's
vec_id included. Ties go to the smaller vec_id (nulls last, then any order among rows of the same vec_id). Vectors
that are null, empty or hold null or non-finite components take no part; shorter ones count as filled with zeros.
Integers beyond 64 bits are cut there, and scores beyond 64 bits wrap. An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, row_ids, settle, small_batches
from .vectors import is_finite, pivots_for, sample_vectors, stack

K = 20
EVERY = 20
SCALE = 64.0
MOST_PIVOTS = 4096
SEEDS = 1024
QUERY_BLOCK = 8192
DATA_BLOCK = 16384
#: Rows whose bounds are taken at once.
ROWS_AT_ONCE = 512
MAX_ID = (1 << 63) - 1


def to_integers(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) in 64 bits."""
    y = np.floor(np.clip(x * scale, -(2.0**63), 2.0**63))
    out = np.clip(y, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out[y >= 2.0**63] = MAX_ID
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integer rows of a and b; in doubles where these are exact."""
    if len(a) and len(b) and float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] < 2.0**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0))


def vectors_of(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def cells(rows: DataFrame, pivots: np.ndarray, width: int, kind: str = "<i8") -> DataFrame:
    """(rid, vec_id, query, vec, cell, dist): each row's integers (of numpy kind `kind`), its cell and its distance to the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = to_integers(stack(b.column("embedding"), width))
            cell, dist = np.zeros(len(v), np.int32), np.zeros(len(v))
            for at in range(0, len(v), 1024):
                x = v[at : at + 1024].astype(float)
                cell[at : at + 1024] = near = distances(x, pivots).argmin(1)
                dist[at : at + 1024] = np.sqrt(((x - pivots[near]) ** 2).sum(1))
            query = pa.array([x is not None and x % EVERY == 0 for x in b.column("vec_id").to_pylist()], pa.bool_())
            vec = pa.array([r.tobytes() for r in v.astype(kind)], pa.binary())
            arrays = [b.column("rid"), b.column("vec_id"), query, vec, pa.array(cell), pa.array(dist)]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "vec_id", "query", "vec", "cell", "dist"])

    kinds = "rid long, vec_id long, query boolean, vec binary, cell int, dist double"
    return rows.select("rid", "vec_id", "embedding").mapInArrow(run, kinds)


def _mix(rid: np.ndarray, n: int) -> np.ndarray:
    return ((rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def thresholds(placed: DataFrame, pivots: np.ndarray, width: int, k: int, kind: str = "<i8") -> pd.DataFrame:
    """cell, queries, radius, threshold: one row for each cell with queries, at most one a pivot."""
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("query").cast("int")).alias("queries")).toPandas()
    held = sizes["cell"].to_numpy()
    n = np.minimum(sizes["n"].to_numpy(), SEEDS)
    parts = {int(c): max(1, -(-int(q) // QUERY_BLOCK)) for c, q in zip(held, sizes["queries"], strict=True) if q}
    users: dict[int, list[int]] = {int(c): [] for c in held}  # for each cell, the cells whose queries look at its seeds
    for c in parts:
        order = np.argsort(-(pivots[held] @ pivots[c]), kind="stable")
        order = np.r_[np.flatnonzero(held == c), order[held[order] != c]]
        enough = int(np.searchsorted(np.cumsum(n[order]), 4 * (k + 1))) + 1
        for at in order[: max(2, enough)].tolist():
            users[int(held[at])].append(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, seed, query = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "seed", "query"))
            take, cell, part, side = [], [], [], []
            for i, c in enumerate(b.column("cell").to_pylist()):
                if query[i]:
                    take, cell, part, side = take + [i], cell + [c], part + [int(_mix(rid[i : i + 1] + 1, parts[c])[0])], side + [0]
                for user in users[c] if seed[i] else ():
                    for p in range(parts[user]):
                        take.append(i)
                        cell.append(user)
                        part.append(p)
                        side.append(1)
            taken = b.take(pa.array(take, pa.int64()))
            arrays = [pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(side, pa.int32()), *(taken.column(c) for c in ("rid", "vec", "dist"))]
            yield pa.RecordBatch.from_arrays(arrays, ["cell", "part", "side", "rid", "vec", "dist"])

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        side, rid, dist = (rows.column(c).to_numpy() for c in ("side", "rid", "dist"))
        x, least = vectors_of(rows.column("vec"), kind, width).astype(np.int64), np.inf
        seeds, own = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        for at in range(0, len(own), 1024):
            some = own[at : at + 1024]
            score = products(x[some], x[seeds]).astype(float)
            score[rid[some][:, None] == rid[seeds]] = -np.inf
            kth = np.partition(score, -k, axis=1)[:, -k].min() if len(seeds) >= k else -np.inf
            least = min(least, kth)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "queries": [len(own)], "radius": [float(dist[own].max(initial=0))], "threshold": [float(least)]})

    ranked = placed.withColumn("at", F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("rid"), "rid")))
    seeds = ranked.where(F.col("at") <= SEEDS).withColumn("seed", F.lit(True)).withColumn("query", F.lit(False))
    both = seeds.select("rid", "vec", "cell", "dist", "seed", "query").unionByName(
        placed.where("query").select("rid", "vec", "cell", "dist", F.lit(False).alias("seed"), "query")
    )
    dealt = both.mapInArrow(run, "cell int, part int, side int, rid long, vec binary, dist double")
    found = dealt.groupBy("cell", "part").applyInArrow(solve, "cell int, queries long, radius double, threshold double")
    per = found.groupBy("cell").agg(F.sum("queries").alias("queries"), F.max("radius").alias("radius"), F.min("threshold").alias("threshold"))
    return per.toPandas().query("queries > 0").sort_values("cell", ignore_index=True)


@dataclass
class Groups:
    """Cells with queries (their pivots, radii and thresholds), the group of each, and each group's number of query blocks."""

    cell: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    threshold: np.ndarray
    group: np.ndarray
    blocks: list[int]

    def wanted(self, x: np.ndarray) -> np.ndarray:
        """Which groups need each row of x."""
        out = np.zeros((len(x), len(self.blocks)), bool)
        for at in range(0, len(x), ROWS_AT_ONCE):
            some = x[at : at + ROWS_AT_ONCE]
            upper = some @ self.centre.T + np.linalg.norm(some, axis=1)[:, None] * self.radius
            row, cell = np.nonzero(upper + 1e-9 * np.abs(upper) >= self.threshold)
            out[at + row, self.group[cell]] = True
        return out


def group_queries(asked: pd.DataFrame, pivots: np.ndarray) -> Groups:
    """Cells with queries, each with the nearest of as many heads as there are blocks of queries."""
    cell, queries = asked["cell"].to_numpy(), asked["queries"].to_numpy()
    n = max(1, min(len(cell), -(-int(queries.sum()) // QUERY_BLOCK)))
    heads = pivots[cell[np.argsort(-queries, kind="stable")[:n]]]
    _, group = np.unique(distances(pivots[cell], heads).argmin(1), return_inverse=True)
    blocks = [max(1, -(-int(q) // QUERY_BLOCK)) for q in np.bincount(group, queries)]
    t = asked["threshold"].to_numpy()
    slack = 1e-6 * (1 + np.abs(np.where(np.isfinite(t), t, 0)))
    return Groups(cell, pivots[cell], asked["radius"].to_numpy() * (1 + 1e-9), t - slack, group, blocks)


def needed(placed: DataFrame, groups: Groups, width: int, kind: str = "<i8") -> DataFrame:
    """placed with array<int> `groups`: those that need the row, in place of its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = groups.wanted(vectors_of(b.column("vec"), kind, width).astype(float))
            lists = pa.array([np.flatnonzero(w).astype(np.int32) for w in wanted], pa.list_(pa.int32()))
            names = ["rid", "vec_id", "query", "vec", "cell"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), lists], [*names, "groups"])

    return placed.drop("dist").mapInArrow(run, "rid long, vec_id long, query boolean, vec binary, cell int, groups array<int>")


def replicate(marked: DataFrame, groups: Groups, data_blocks: dict[int, int]) -> DataFrame:
    """(grp, qb, db, side, rid, vec_id, vec): queries for each data block of their group, rows for each group that needs them."""
    home = dict(zip(groups.cell.tolist(), groups.group.tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, query, cell = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "query", "cell"))
            lists = b.column("groups")
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            of = lists.flatten().to_numpy(zero_copy_only=False)
            own = np.array([home.get(c, -1) for c in cell.tolist()], np.int64)
            parts = [(np.zeros(0, np.int64), 0, np.zeros(0, np.int64), np.zeros(0, np.int64), 1)]
            for g, n in enumerate(groups.blocks):
                blocks = data_blocks.get(g, 1)
                at = row[of == g]
                parts += [(at, g, q, _mix(rid[at], blocks), 1) for q in range(n)]
                asks = np.flatnonzero(query & (own == g))
                parts += [(asks, g, _mix(rid[asks] + 1, n), d, 0) for d in range(blocks)]
            take = pa.array(np.concatenate([p[0] for p in parts]))
            spread = lambda k: pa.array(np.concatenate([np.broadcast_to(p[k], len(p[0])) for p in parts]).astype(np.int32))
            taken = b.take(take)
            arrays = [*(spread(k) for k in (1, 2, 3, 4)), *(taken.column(c) for c in ("rid", "vec_id", "vec"))]
            yield pa.RecordBatch.from_arrays(arrays, ["grp", "qb", "db", "side", "rid", "vec_id", "vec"])

    kinds = "grp int, qb int, db int, side int, rid long, vec_id long, vec binary"
    return marked.mapInArrow(run, kinds)


def _solver(k: int, width: int, kind: str = "<i8"):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        queries, data = rows[rows["side"] == 0], rows[rows["side"] == 1]
        out: dict[str, list] = {"query": [], "query_id": [], "vec_id": [], "rid": [], "score": []}
        if len(queries) and len(data):
            data = data.sort_values(["vec_id", "rid"], na_position="last", kind="stable")
            x = lambda side: np.frombuffer(b"".join(side["vec"]), kind).reshape(len(side), width).astype(np.int64)
            d_rid, d_id = data["rid"].to_numpy(), data["vec_id"].to_numpy(object)
            xs = x(data)
            for at in range(0, len(queries), 256):
                some = queries.iloc[at : at + 256]
                score = products(x(some), xs)
                own = some["rid"].to_numpy()
                for row, rid, query_id in zip(score, own.tolist(), some["vec_id"].to_numpy().tolist(), strict=True):
                    others = d_rid != rid
                    row, ids, rids = row[others], d_id[others], d_rid[others]
                    if len(row) > k:
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        pick = np.flatnonzero(row >= least)
                    else:
                        pick = np.arange(len(row))
                    pick = pick[np.argsort(-row[pick], kind="stable")[:k]]
                    out["query"] += [rid] * len(pick)
                    out["query_id"] += [int(query_id)] * len(pick)
                    out["vec_id"] += ids[pick].tolist()
                    out["rid"] += rids[pick].tolist()
                    out["score"] += row[pick].tolist()
        frame = pd.DataFrame(out)
        frame["vec_id"] = frame["vec_id"].astype("Int64")
        return frame.astype({"query": "int64", "query_id": "int64", "rid": "int64", "score": "int64"})

    return solve


def top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row of vectors (vec_id, embedding)."""
    small_batches(vectors.sparkSession)
    light = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(is_finite(F.col("embedding")))
    rows = row_ids(light, "rid")
    count, width, asked, largest = rows.agg(
        F.count("*"), F.max(F.size("embedding")), F.coalesce(F.sum(F.when(F.col("vec_id") % EVERY == 0, 1)), F.lit(0)),
        F.max(F.array_max(F.transform("embedding", F.abs))).cast("double"),
    ).first()
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = "<i2" if largest * SCALE + 1 < 1 << 15 else "<i8"
    pivots = to_integers(sample_vectors(rows, "embedding", pivots_for(count, MOST_PIVOTS, width), width)).astype(float)
    placed = settle(cells(rows, pivots, width, kind))
    groups = group_queries(thresholds(placed, pivots, width, k, kind), pivots)
    marked = settle(needed(placed, groups, width, kind))
    counts = marked.select(F.explode("groups").alias("g")).groupBy("g").count().collect()  # one row a group
    dealt = replicate(marked, groups, {r["g"]: -(-r["count"] // DATA_BLOCK) for r in counts})
    best = dealt.groupBy("grp", "qb", "db").applyInPandas(
        _solver(k, width, kind), "query long, query_id long, vec_id long, rid long, score long"
    )
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "rid")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest scores of every twentieth embedding against all others."""
    return top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Scores by brute force; every row but the query's own is a candidate.
SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.rid <> c.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""

QUERIES = {"op7_topk": op7_topk}
ORACLE_SQL = {"op7_topk": SQL}
