import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarryline.llm.pack import STEP_TOKENS, TIERS, default_tokenizer, op3_pack, pack, pack_rest, pack_window
from quarryline.llm.tokens import PART_CHARS, Words, parts, words_of


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = st.text(st.sampled_from("aAbZéÉßÿİΣσςñ ́'’<|>.,!?-_0９१\n\t  　\x1c\x85ﬁ中😀é"), max_size=40)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=60), ODD, st.lists(st.sampled_from(["<|endoftext|>", "it's", "we'll", "Ab,", "x"]), max_size=6).map(" ".join)))
def test_ids_are_those_of_the_library(text):
    from tokenizers import Tokenizer

    whole = _whole.setdefault("t", None) or _whole.update(t=Tokenizer.from_file(default_tokenizer())) or _whole["t"]
    assert np.frombuffer(words_of(default_tokenizer()).ids(text), "<u2").tolist() == ids_of(whole, text)


_whole: dict = {}


def test_long_texts_are_cut_at_white_space():
    text = ("word " * 10 + "\n") * (PART_CHARS // 20)
    cut = list(parts(text))
    assert len(cut) > 1 and "".join(cut) == text and all(x[0].isspace() for x in cut[1:])
    assert list(parts("x" * (2 * PART_CHARS))) == ["x" * (2 * PART_CHARS)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=30))
def test_windows_are_full_and_lose_nothing(lengths):
    full, left = pack_window(lengths)
    rest = pack_rest(left)
    for size, pieces in [*full, *rest]:
        assert sum(p[0] for p in pieces) == size and size & (size - 1) == 0 and size <= TIERS[-1]
    assert all(size in TIERS for size, _ in full)
    seen = sorted((i, at, n) for _, pieces in [*full, *rest] for n, i, at in pieces)
    for i, n in enumerate(lengths):
        at = 0
        for _, start, length in [x for x in seen if x[0] == i]:
            assert start == at
            at += length
        assert at == n


def check(rows, texts, tokenizer):
    """rows hold each document's ids once, in gapless sequences; returns the padding."""
    per, sequences = {}, {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert per.keys() == texts.keys()
    for doc_id, pieces in per.items():
        want = [*ids_of(tokenizer, texts[doc_id]), 2]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want))
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_query_is_an_exact_round_trip(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_pack(spark, sf_dir).collect()
    assert check(rows, texts, tokenizer) == 0
    steps = {}
    for r in rows:
        steps[r.step_group] = steps.get(r.step_group, 0) + r.length
    assert max(steps.values()) <= 1 << 17


def test_step_groups_are_full_over_all_tasks(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    rows = pack(docs, default_tokenizer()).groupBy("tier", "step_group").agg({"length": "sum"}).collect()
    short = {}
    for tier, group, n in rows:
        assert n <= STEP_TOKENS
        short.setdefault(tier, []).extend([group] if n < STEP_TOKENS else [])
    assert all(len(own) <= 1 and own == [max(g for t, g, _ in rows if t == tier)][: len(own)] for tier, own in short.items())
    assert sum(n == STEP_TOKENS for *_, n in rows) >= 3


def test_other_tokenizers_go_to_the_library_whole(tmp_path, tokenizer):
    said = json.loads(Path(default_tokenizer()).read_text())
    said["normalizer"] = None  # no lower-casing
    (tmp_path / "other.json").write_text(json.dumps(said))
    text = "Some TEXT  with\tCapitals, isn't it? " * 3
    whole = Tokenizer.from_file(str(tmp_path / "other.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(Words(str(tmp_path / "other.json")).ids(text), "<u2").tolist() == whole
    assert Words(default_tokenizer()).known and whole != ids_of(tokenizer, text)


def test_edge_rows(spark, tokenizer):
    long = "Wort für Wort, " * 100_000
    rows = [(None, None, 1), (1, "", 2), (2, long, 3), (3, "a b", 4), (4, "a b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(2)
    assert check(pack(docs, default_tokenizer()).collect(), {r[0]: r[1] for r in rows}, tokenizer) == 0
    again = spark.createDataFrame([(7, "a b"), (7, "a b")], "doc_id long, text string")
    assert sum(r.length for r in pack(again, default_tokenizer()).collect()) == 2 * 3
    assert pack(docs.limit(0), default_tokenizer()).count() == 0
    with_ids = pack(docs.where("doc_id = 3"), default_tokenizer(), with_ids=True).collect()
    assert [i for r in sorted(with_ids, key=lambda r: r.start) for i in r.ids] == [*ids_of(tokenizer, "a b"), 2]
