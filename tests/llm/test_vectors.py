import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import embedding_dedup as E
from quarryline.llm import topk as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, differences  # noqa: E402

KIND = "vec_id long, embedding array<float>, label int"


def brute_force(ids, x, threshold=0.9):
    """Links and components of rows of x."""
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    part = np.arange(len(ids))
    while True:
        new = np.array([min(part[i], part[near[i]].min(initial=part[i])) for i in range(len(ids))])
        if (new == part).all():
            break
        part = new
    return near.sum(1), np.array([min(ids[j] for j in np.flatnonzero(part == part[i])) for i in range(len(ids))])


def clustered(seed, groups=(40, 25, 3, 2), singles=150, width=64, spread=0.02):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=(singles, width))]
    for n in groups:
        centre = rng.normal(size=width)
        rows.append(centre + spread * np.linalg.norm(centre) / 8 * rng.normal(size=(n, width)) * rng.uniform(0.5, 8, size=(n, 1)))
    return np.concatenate(rows).astype(np.float32)


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 16)])
def test_links_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(E, "BLOCK", block)
    x = clustered(seed)
    ids = np.random.default_rng(seed).permutation(len(x)) * 3 + 1
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)]
    rows += [(10_000 + k, x[-1].tolist(), 1) for k in range(30)]  # copies of one vector
    got = {r.vec_id: r for r in E.dedup_vectors(spark.createDataFrame(rows, KIND)).collect()}
    all_ids = [r[0] for r in rows]
    links, part = brute_force(all_ids, np.array([r[1] for r in rows], float))
    found = np.array([got[i].n_links for i in all_ids])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()  # recall, and no link below the threshold
    assert [got[i].component_id for i in all_ids] == part.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def hot_cluster(n, cosine, width=64):
    """Rows of which a third are distinct vectors with about that cosine between any two; the rest is random."""
    rng = np.random.default_rng(n)
    to_unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    own = to_unit(rng.normal(size=(n, width)))
    own[: n // 3] = np.sqrt(cosine) * to_unit(rng.normal(size=(1, width))) + np.sqrt(1 - cosine) * own[: n // 3]
    return own.astype(np.float32)


def recall_of_links(spark, x):
    """The share of the links of brute force that the operator finds; it may find no others."""
    u = x / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    links = np.concatenate([(u[at : at + 1000] @ u.T >= 0.9).sum(1) for at in range(0, len(u), 1000)]) - 1
    table = pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    rows = E.dedup_vectors(spark.createDataFrame(table)).collect()
    found = np.zeros(len(x), int)
    found[[r.vec_id for r in rows]] = [r.n_links for r in rows]
    assert len(rows) == len(x) and (found <= links).all()
    return found.sum() / links.sum()


@pytest.mark.parametrize("n", [4_000, 12_000])
def test_recall_on_a_hot_cluster_at_two_sizes(spark, n):
    assert recall_of_links(spark, hot_cluster(n, 0.95)) >= 0.99


@pytest.mark.parametrize("n, cosine", [(24_000, 0.95), (24_000, 0.86), (48_000, 0.91)])
def test_recall_on_a_cluster_that_crowds_the_pivots(spark, n, cosine):
    assert recall_of_links(spark, hot_cluster(n, cosine)) >= 0.99


@pytest.mark.parametrize("n_pivots, width", [(400, 64), (2_000, 64), (16_384, 64), (2_000, 256)])
def test_recall_of_pairs_near_the_threshold(spark, n_pivots, width):
    rng = np.random.default_rng(n_pivots)
    own = rng.normal(size=(18_000, width))
    a = own[:1500] / np.linalg.norm(own[:1500], axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    c = rng.uniform(0.9005, 0.92, (len(a), 1))
    x = np.concatenate([own, c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b, axis=1, keepdims=True)]).astype(np.float32)
    table = pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    found = sum(r.n_links for r in E.dedup_vectors(spark.createDataFrame(table), n_pivots=n_pivots).where("n_links > 0").collect())
    assert 0.99 * 2 * len(a) <= found <= 2 * len(a)


def test_query_has_the_links_of_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    links, part = brute_force([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    got = {r.vec_id: r for r in E.op6_embedding_dedup(spark, sf_dir).collect()}
    assert [got[r.vec_id].n_links for r in rows] == links.tolist() and [got[r.vec_id].component_id for r in rows] == part.tolist()


def test_dedup_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0]), (9, [1e30, 0.0]), (9, [1e30, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, node string")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in E.dedup_vectors(vectors).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)]
    assert got == sorted([*alone, (7, 4, 7, True), (8, 4, 7, False), (9, 4, 7, False), (9, 4, 7, False), (0, 4, 7, False)], key=str)
    assert E.dedup_vectors(vectors.limit(0)).count() == 0
    assert E.dedup_vectors(vectors.where("vec_id < 4")).count() == 3


def test_top_k_equals_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differences(T.op7_topk(spark, sf_dir), connect(sf_dir), T.SQL) == ""


def model_top_k(rows, k=20):
    """rows: (vec_id, integers); every row but the query's own."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q is not None and q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), c is None, c or 0) for j, (c, w) in enumerate(rows) if j != i]
            out += [(q, n, None if c[1] else c[2], -c[0]) for n, c in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 16)])
def test_top_k_with_groups_ties_and_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(T, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(T, "DATA_BLOCK", blocks[1])
    x = clustered(5, groups=(60, 30), singles=60, width=8, spread=0.3)
    x = np.concatenate([x, np.repeat(x[:1], 40, axis=0)])  # one very common vector
    rows = [(int(i), v.tolist(), 0) for i, v in zip(np.arange(len(x)) * 4, x, strict=True)]
    got = sorted((tuple(r) for r in T.top_k(spark.createDataFrame(rows, KIND)).collect()), key=str)
    assert got == model_top_k([(i, T.to_integers(np.array(v, float)).tolist()) for i, v, _ in rows])


def test_bounds_spare_rows_that_cannot_serve(spark):
    rng = np.random.default_rng(4)
    near = np.r_[np.full((60, 4), 50.0) + rng.normal(size=(60, 4)), np.full((200, 4), -50.0) + rng.normal(size=(200, 4))]
    rows = [(20 * i if i < 3 else 20 * i + 1, v.tolist(), 0) for i, v in enumerate(near)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    placed, width = T.row_ids(data, "rid"), 4
    pivots = T.to_integers(near[[0, 100]]).astype(float)
    cells = T.settle(T.cells(placed, pivots, width))
    groups = T.group_queries(T.thresholds(cells, pivots, width, 20), pivots)
    dealt = T.replicate(T.needed(cells, groups, width), groups, {0: 1})
    assert dealt.where("side = 1").count() == 60


def test_rows_go_to_the_groups_near_them(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BLOCK", 32)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 64))
    x = (centres[rng.integers(0, 30, 6000)] + 0.08 * rng.normal(size=(6000, 64))).astype(np.float32)
    data = T.row_ids(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], KIND), "rid")
    pivots = T.to_integers(x[:155].astype(float)).astype(float)
    cells = T.settle(T.cells(data, pivots, 64))
    groups = T.group_queries(T.thresholds(cells, pivots, 64, 20), pivots)
    copies = T.needed(cells, groups, 64).selectExpr("sum(size(groups))").first()[0]
    assert len(groups.blocks) >= 8 and copies < 0.35 * len(x) * len(groups.blocks)


def test_repeated_ids_are_candidates_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(int(i), v.tolist(), 0) for i, v in zip(rng.integers(0, 60, 200), rng.normal(size=(200, 16)), strict=True)]
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert differences(T.op7_topk(spark, str(tmp_path)), connect(str(tmp_path)), T.SQL) == ""


def test_top_k_edge_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, -0.5]), (0, [1.0, -0.5]), (20, [2.0]), (None, [0.3, 0.3]), (3, None), (40, []), (60, [nan, 1.0]), (80, [None, 1.0]), (5, [1.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    used = [(i, v) for i, v in rows if v and all(c is not None and c == c for c in v)]
    ints = [(i, T.to_integers(np.array([*v, 0.0][:2])).tolist()) for i, v in used]
    assert sorted((tuple(r) for r in T.top_k(vectors).collect()), key=str) == model_top_k(ints)
    assert T.top_k(vectors.limit(0)).count() == 0 and T.top_k(vectors.where("vec_id = 5")).count() == 0
    assert T.top_k(vectors.where("vec_id = 20")).count() == 0


def test_integers_and_products_beyond_doubles():
    assert T.to_integers(np.array([[1e300, -1e300, 0.999, -0.001]])).tolist() == [[(1 << 63) - 1, -(1 << 63), 63, -1]]
    a = np.array([[1 << 40, 3]], np.int64)
    assert T.products(a, a).tolist() == [[((1 << 80) + 9) % (1 << 64)]]
    b = np.array([[(1 << 30) + 1, 1]], np.int64)
    assert T.products(b, b).tolist() == [[((1 << 30) + 1) ** 2 + 1]]
