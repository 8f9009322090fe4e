import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quarryline.llm import simhash
from quarryline.llm import simhash as S
from quarryline.llm.components import connected_components
from quarryline.llm.simhash import anchors_of, fingerprint, keep_one_of_each_group, op9_simhash, simhash_components


def model_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def model_components(ids, fps, distance=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                parent[a] = b
    return {ids[i]: min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB é\t\n\x0b\x1c\xa0x"), max_size=40))
def test_fingerprint_is_that_of_the_model(text):
    assert fingerprint(text.encode()) == model_fingerprint(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", "é", "long-word"]), max_size=30), st.sampled_from([" ", "\n\n", " \t"]), st.integers(1, 12))
def test_a_text_in_slices_is_the_text(words, joint, size):
    text, whole = joint.join(words), simhash.SLICE
    simhash.SLICE = size
    try:
        assert b"".join(simhash.slices(text.encode())) == text.encode()
        assert fingerprint(text.encode()) == model_fingerprint(text)
    finally:
        simhash.SLICE = whole


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_fingerprints_two_bits_apart_share_an_anchor(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    anchors, index = anchors_of(np.array([x, y], np.uint64))
    assert set(anchors[index == 0].tolist()) & set(anchors[index == 1].tolist())
    assert max(np.bincount(index)) <= 32


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 60))
def test_forest_connects_what_links_connect(seed, n):
    rng = np.random.default_rng(seed)
    fps = np.unique(np.bitwise_xor(rng.integers(0, 2**63, dtype=np.uint64), np.uint64(1) << rng.integers(0, 12, n).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 12, n).astype(np.uint64)))
    left, right = simhash._forest(fps)
    assert all(bin(int(fps[a]) ^ int(fps[b])).count("1") <= 2 for a, b in zip(left, right, strict=True))
    want = model_components(list(range(len(fps))), [int(x) for x in fps])
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(left, right, strict=True):
        parent[find(a)] = find(b)
    assert len({find(i) for i in range(len(fps))}) == len(set(want.values()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (5000, 5001), (5001, 5000), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + k: 1000 for k in range(50)} | {5000: 5000, 5001: 5000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [model_fingerprint(texts[i]) for i in ids]
    want = model_components(ids, fps)
    got = op9_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in zip(ids, fps, strict=True)}
    assert {r.doc_id: r.component_id for r in got} == want


WORDS = [f"w{i}" for i in range(400)]


def test_edge_rows(spark):
    long = " ".join(WORDS * 200)
    rows = [(5, None), (4, ""), (9, " \n"), (3, long), (2, long), (2, long), (None, long), (None, "one two"), (None, "one two"), (7, "ONE two")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash_components(docs).collect()))
    assert got == [(False, 2, 2), (False, 2, 2), (False, 3, 2), (False, 4, 4), (False, 5, 4), (False, 7, 7), (False, 9, 4), (True, 0, 2), (True, 0, 7), (True, 0, 7)]
    kept = keep_one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 7]
    assert keep_one_of_each_group(docs.limit(0)).count() == 0
    unnamed = keep_one_of_each_group(docs.where("doc_id is null")).collect()
    assert sorted(len(r.text) for r in unnamed) == [7, len(long)]


def test_large_groups_of_copies_and_near_copies(spark):
    copies = [(i, " ".join(WORDS)) for i in range(500)]
    near = [(1000 + i, " ".join([*WORDS[i % 7 :], "end"])) for i in range(200)]
    docs = spark.createDataFrame(copies + near, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_components(docs).collect()}
    fps = {i: model_fingerprint(t) for i, t in dict(copies[:1] + near[:7]).items()}
    want = model_components(list(fps), list(fps.values()))
    assert {got[i] for i in range(500)} == {want[0]}
    assert all(got[1000 + i] == want[1000 + i % 7] for i in range(200))


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_groups(texts):
    """{id: smallest id of its group} by the similarity of all pairs of texts {id: text}."""
    ids = sorted(texts)
    sets, part = {i: shingles(texts[i]) for i in ids}, {i: i for i in ids}

    def top(i):
        return i if part[i] == i else top(part[i])

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                a, b = sorted((top(i), top(j)))
                part[b] = a
    return {i: top(i) for i in ids}


def test_word_prints_equal_a_plain_model():
    text = "One two TWO three two " * 50
    counts = Counter({w: min(n, 2) for w, n in Counter(text.lower().split()).items()})
    for k, got in enumerate(S.word_prints(text.encode()).tolist()):
        sums = [0] * 64
        for w, n in counts.items():
            h = (xxhash.xxh64_intdigest(w, 42) ^ (k * 0x632BE59BD9B4E019) % 2**64) * 0x9E3779B97F4A7C15 % 2**64
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
            h ^= h >> 32
            for i in range(64):
                sums[i] += n * (h >> i & 1)
        assert got == sum(1 << i for i in range(64) if sums[i] * 2 > counts.total())


def test_stage_finds_near_copies_and_leaves_the_rest(spark):
    rng, words = random.Random(4), [f"w{i}" for i in range(3000)]
    rows, edits = [], []
    for i in range(400):
        text = [rng.choice(words) if rng.random() < 0.5 else rng.choice(words[:40]) for _ in range(rng.randint(60, 400))]
        copy = list(text)
        for _ in range(max(1, round(len(text) * rng.uniform(0.004, 0.02)))):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    rows += [(5000 + i, rows[0][1]) for i in range(300)]  # copies of one text
    hot = rows[2][1].split()
    for i in range(300):  # near copies of another
        copy = list(hot)
        copy[rng.randrange(len(copy))] = f"e{i}"
        rows.append((6000 + i, " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows}
    near = {i for i in range(0, 800, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    kept = {r.doc_id for r in keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in range(800) if i % 2 == 0} <= kept and {i + 1 for i in range(0, 800, 2) if i not in near} <= kept
    found = sum(i + 1 not in kept for i in near)
    assert len(near) > 250 and found >= 0.93 * len(near)
    assert not any(5000 <= i < 6000 for i in kept) and sum(i >= 6000 for i in kept) <= 30


@pytest.mark.parametrize("columns", [("doc_id", "text", "lang", "source", "n_chars")])
def test_stage_keeps_columns(spark, sf_dir, columns):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert tuple(corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir).columns) == columns
