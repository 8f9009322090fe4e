import math

import pytest
from pyspark.sql import functions as F

from quarryline.llm import mix as M


def model_targets(sizes, weights, cap=3.0):
    """Targets by resharing until none is above its cap; sizes in order of source, null last."""
    total = sum(sizes)
    target, capped = [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left, w = total - sum(cap * sizes[i] for i in capped), sum(weights[i % len(weights)] for i in free)
        for i in free:
            target[i] = left * weights[i % len(weights)] / w
        for i in capped:
            target[i] = cap * sizes[i]
        over = [i for i in free if target[i] > cap * sizes[i]]
        if not over:
            return target
        capped |= set(over)
        if len(capped) == len(sizes):
            return [cap * s for s in sizes]


def model_rates(sizes, target, cap=3.0):
    """By bisection on the tilt."""
    mean = sum(sizes) / len(sizes)
    rate = lambda lam, t: min(cap, math.exp(min(50, lam * t / mean)))
    lo, hi = -1e6, 1e6
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(t * rate(mid, t) for t in sizes) > target else (mid, hi)
    return [rate((lo + hi) / 2, t) for t in sizes]


def check(out, weights=M.WEIGHTS):
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    want = model_targets([sum(r["size"] for r in by[s]) for s in order], weights)
    for s, t in zip(order, want, strict=True):
        own = by[s]
        size = sum(r["size"] for r in own)
        assert all(r.source_size == size and math.isclose(r.target, t, rel_tol=1e-9, abs_tol=1e-6) for r in own)
        assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in own)
        taken, smallest = sum(r.taken for r in own), min([r["size"] for r in own if r["size"] and r.copies < 3], default=0)
        assert abs(t - taken) <= max(smallest / 2, 0.02 * t) + 1
        sizes = [r["size"] for r in own if r["size"]]
        if sizes and t < 3 * size * (1 - 1e-9):
            for r, x in zip([r for r in own if r["size"]], model_rates(sizes, t), strict=True):
                assert math.isclose(r.rate, x, rel_tol=1e-4, abs_tol=1e-4)
                assert math.floor(x - 1e-4) <= r.copies <= math.floor(x + 1e-4) + 3
    return rows


def test_query(spark, sf_dir):
    out = M.op10_mix(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d.doc_id]["size"] == len((d.text or "").translate({c: " " for c in range(9, 14)}).replace("\n", " ").split(" ")) - (d.text or "").translate({c: " " for c in range(9, 14)}).split(" ").count("")
    again = {r.doc_id: r.taken for r in M.op10_mix(spark, sf_dir).collect()}
    assert again == {i: r.taken for i, r in rows.items()}


def test_mix_equals_a_plain_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(M.mix(docs))


def test_hot_and_small_sources_and_caps(spark):
    rows = [(i, "w " * (1 + i % 40), "hot") for i in range(3000)] + [(5000 + i, "w " * (5 + i), "small") for i in range(4)] + [(6000, "w w", None), (7000, "", "empty"), (7001, None, "empty")]
    got = check(M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert {r.copies for r in got if r.source is None} == {3} and {r.copies for r in got if r.source == "empty"} == {1}


def test_repeated_rows_are_shared_out(spark):
    rows = [(1, "w w w w", "a")] * 300 + [(2, "w w w", "b")] * 100 + [(None, "w w", "a")] * 50
    out = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), weights=(1.0, 1.0))
    got = check(out, (1.0, 1.0))
    assert len(got) == 450


X = (1, 2, 3, 4, 5)


def test_edge_rows(spark):
    kind = "doc_id long, text string, source string, size string, copies string, lam int, `odd.name` int, edge int, fit int, more int, key int, n int"
    rows = [(1, "a b", "x", "s", "c", 1, 2, *X), (2, "a", "y", "s", "c", 1, 2, *X), (3, "long " * 100_000, "y", "s", "c", 1, 2, *X)]
    docs = spark.createDataFrame(rows, kind)
    out = M.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "lam", "odd.name", "edge", "fit", "more", "key", "n", "size", "source_size", "target", "rate", "copies", "taken"]
    assert out.agg(F.sum("size")).first()[0] == 100_003
    assert M.mix(docs.limit(0)).count() == 0
    alone = M.mix(docs.where("doc_id = 1")).first()
    assert (alone.copies, alone.taken, alone.target) == (1, 2, 2.0)


@pytest.mark.parametrize("sizes, weights", [([10, 10, 10], (1, 2, 3)), ([1, 100, 100], (1, 2, 3)), ([0, 5, 50], (3, 2, 1)), ([0, 0], (1, 2)), ([7], (2,)), ([1, 1, 1000], (1, 1, 5))])
def test_targets(spark, sizes, weights):
    rows = [(f"s{i}", s, 1) for i, s in enumerate(sizes)]
    got = M.targets(spark.createDataFrame(rows, "source string, words long, filled long"), tuple(map(float, weights)), 3.0)
    want = model_targets(sizes, weights)
    assert [r.target for r in got.orderBy("source").collect()] == pytest.approx(want)
