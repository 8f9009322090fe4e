import math
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from quarryline.llm import quality as Q


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = Q.op8_quality(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in labels]
    right = [r.predicted == labels[r.doc_id] for r in tested]
    assert len(right) > 50 and sum(right) / len(right) > 0.95
    again = {r.doc_id: r.score for r in Q.op8_quality(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, Q.FEATURES)) for n in (1, 3, 2)]
    model = Q.fit([np.abs(b) for b in bags], np.array([0.0, 1.0, 1.0]))
    x, first, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([0.0, 1.0, 1.0])

    def loss():
        p = model.forward(x, first)["y"]
        weights = sum(Q.DECAY / 2 * (v**2).sum() for k, v in model.p.items() if k not in ("b", "d"))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + weights

    got = model.gradients(x, first, y)
    for k, v in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in v.shape)
            old, step = v[at], 1e-5
            v[at] = old + step
            up = loss()
            v[at] = old - step
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * step) - got[k][at]) < 1e-5


def test_scores_equal_a_plain_model():
    """Passages, attention and score by loops over words and numbers."""
    text = "One two two three, four! 5 six seven.\nEight nine ten " * 9
    words = text.split()
    rng = np.random.default_rng(2)
    model = Q.fit([np.abs(rng.normal(size=(3, Q.FEATURES))) for _ in range(6)], np.array([0.0, 1.0] * 3))
    x = Q.passages(text.encode())
    assert len(x) == math.ceil(len(words) / Q.PASSAGE)
    for k in range(len(x)):
        own = words[k * Q.PASSAGE : (k + 1) * Q.PASSAGE]
        repeats = sum(a == b for a, b in zip(own, own[1:]))
        assert np.allclose(x[k, -4:], [repeats / len(own), len(set(own)) / len(own), sum(map(len, own)) / len(own) / 10, math.log1p(len(own)) / 5])
        in_groups = x[k, Q.KINDS**2 : -4] ** 2 * len(own)  # words by group: whole numbers that add up, alike for alike words
        assert np.allclose(in_groups, np.rint(in_groups)) and round(in_groups.sum()) == len(own)
        assert max(in_groups) >= max(Counter(own).values()) - 1e-6
        assert abs((x[k, : Q.KINDS**2] ** 2).sum() - 1) < 0.02  # all pairs of bytes, but for the passage's last
    p = {k: v.tolist() for k, v in model.p.items()}
    hidden, gates = [], []
    for row in ((x - model.mean) / model.scale).tolist():
        h = [math.tanh(sum(a * w[j] for a, w in zip(row, p["W"])) + p["b"][j]) for j in range(Q.HIDDEN)]
        t = [math.tanh(sum(a * v[j] for a, v in zip(h, p["V"]))) for j in range(Q.GATE)]
        s = [1 / (1 + math.exp(-sum(a * u[j] for a, u in zip(h, p["U"])))) for j in range(Q.GATE)]
        hidden.append(h)
        gates.append(math.exp(sum(a * b * w for a, b, w in zip(t, s, p["w"]))))
    mean = [sum(g * h[j] for g, h in zip(gates, hidden)) / sum(gates) for j in range(Q.HIDDEN)]
    want = 1 / (1 + math.exp(-sum(a * c for a, c in zip(mean, p["c"])) - p["d"][0]))
    assert abs(model.score(x) - want) < 1e-9


def test_held_out_ranking(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in Q.op8_quality(spark, sf_dir).where("held_out").collect() if r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    wins = sum(a > b for a in good for b in bad) / len(good) / len(bad)
    assert len(rows) > 500 and wins > 0.999
    assert sum(a >= Q.THRESHOLD for a in good) / len(good) > 0.995 and sum(b < Q.THRESHOLD for b in bad) / len(bad) > 0.95


def test_passages_cover_whole_texts(monkeypatch):
    text = b" ".join(b"word%d" % i for i in range(1000)) + b"\n"
    whole = Q.passages(text)
    assert whole.shape == (-(-1000 // Q.PASSAGE), Q.FEATURES)
    monkeypatch.setattr(Q, "PASSAGES_AT_ONCE", 3)
    parts = Q.passages(text)
    assert parts.shape == whole.shape and np.abs(parts - whole).max() < 0.2
    assert Q.passages(b"").shape == Q.passages(b" \n").shape == (1, Q.FEATURES)
    assert Q.passages(b"a a a b").tolist()[0][-4] == 0.5


def test_blocks_score_like_the_whole():
    rng = np.random.default_rng(4)
    model = Q.fit([np.abs(rng.normal(size=(3, Q.FEATURES))) for _ in range(8)], np.array([0.0, 1.0] * 4))
    x = rng.normal(size=(50, Q.FEATURES)) * np.linspace(0, 9, 50)[:, None]
    want = model.forward((x - model.mean) / model.scale, np.zeros(1, np.int64))["y"][0]
    for cuts in ([], [1, 2, 30], [49]):
        assert abs(model.score_blocks(np.split(x, cuts)) - want) < 1e-12


def test_attention_weighs_passages_of_a_bag():
    rng = np.random.default_rng(3)
    bags, labels = [], []
    for i in range(200):
        b = rng.normal(size=(5, Q.FEATURES)) * 0.1
        if i % 2:
            b[rng.integers(5), 0] += 3
        bags.append(b)
        labels.append(float(i % 2))
    model = Q.fit(bags, np.array(labels))
    scores = np.array([model.score(b) for b in bags])
    assert ((scores > 0.5) == (np.array(labels) == 1)).mean() > 0.97


def test_edge_rows(spark):
    rows = [(None, "A text."), (1, None), (2, ""), (3, "word " * 300_000), (4, "same"), (4, "same")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (4, 0, 0), (9, 1, 0), (None, 1, 0), (1, None, 0), (2, 5, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    got = Q.score(docs, model, "s").collect()
    assert len(got) == 6 and all(0 <= r.s <= 1 for r in got) and len({r.s for r in got if r.text == "same"}) == 1
    assert Q.train(docs, labels.limit(0)) is None and {r.score for r in Q.score(docs, None).collect()} == {0.5}
    assert Q.score(docs.limit(0), model).count() == 0
    assert Q.train(docs.limit(0), labels) is None


def test_stage_rejects_junk_and_keeps_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, sf_dir).select("doc_id").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) / len(good) > 0.99 and sum(i in kept for i in bad) / len(bad) < 0.1
