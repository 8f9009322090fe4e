import bisect
import itertools
import math
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarryline.llm import licenses as L
from quarryline.llm.license_rules import BASE, FORMS, LICENSES, NOTICES
from quarryline.llm.licenses import GATE, RULES, char_spans, detect, op1_license_scan, scan_licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_places(text):
    words, starts, labels = WORDS.findall(lower(text)), [], set()
    for phrase, label in BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), sorted(starts), labels


PIECES = st.sampled_from(["mit", "MIT", "license", "License,", "apache", "general", "public", "-", "\n", "é", "mitx", "license.", "the", "7", " "])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=30), st.sampled_from([" ", "", "_", "\n\n"]))
def test_base_places_are_those_of_brute_force(pieces, joint):
    text = joint.join(pieces)
    n, found = detect(text.encode().lower())
    got = [(r, a) for r, a, _, _ in found if r.base]
    assert (n, sorted(a for _, a in got), {r.label for r, _ in got}) == base_places(text)


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.number}-{r.label}-{r.kind}")
def test_keywords_stand_in_whatever_a_rule_matches(rule):
    plain = re.sub(rb"\(\?(?:=|!|<!)[^)]*\)", b"", rule.pattern.pattern)

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck), database=None)
    @given(st.from_regex(re.compile(plain), fullmatch=True))
    def check(match):
        joined = re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", match).strip() + b" 4 0"
        if rule.pattern.search(joined):
            assert rule in GATE.open(joined)

    check()


def test_there_are_hundreds_of_rules_in_priority_order():
    assert len(RULES) > 300
    assert [r.priority for r in RULES] == sorted((r.priority for r in RULES), reverse=True)


def test_a_longer_surer_detection_suppresses_what_it_holds():
    _, found = detect(b"licensed under the apache license, version 2.0.")
    kept = {(r.label, r.kind) for r, _, _, k in found if k}
    assert kept == {("apache-2.0", "grant")}
    assert {r.label for r, _, _, k in found if not k} >= {"apache"}


def test_spans_count_code_points():
    low = "é 😀 Released under the MIT License".encode().lower()
    _, found = detect(low)
    span = char_spans(low, [(a, b) for r, a, b, k in found if k])[0]
    assert "é 😀 Released under the MIT License"[slice(*span)].lower() == "released under the mit license"


def test_edge_rows(spark):
    long = "word " * 200_000 + "released under the MIT license"
    rows = [(None, "MIT License", 1), (1, None, 2), (2, "", 3), (3, long, 4), (3, long, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted(scan_licenses(docs).select("doc_id", "n_words").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(None, 2), (1, 0), (2, 0), (3, 200_005), (3, 200_005)], key=lambda r: f"Row(doc_id={r[0]}, n_words={r[1]})")
    assert scan_licenses(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op1_license_scan(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n, starts, labels = base_places(texts[r.doc_id] or "")
        assert (r.n_words, r.n_base) == (n, len(starts))
        assert (r.first_word, r.last_word) == ((starts[0], starts[-1]) if starts else (None, None))
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def model(text):
    """Kept detections by trying every rule everywhere, without the gate, and every kept interval."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    joined, kept = " ".join(words).encode(), []
    begins = list(itertools.accumulate((len(w.encode()) + 1 for w in words), initial=0))
    for rule in L.RULES:
        for m in rule.pattern.finditer(joined):
            first, after = bisect.bisect(begins, m.start()) - 1, bisect.bisect(begins, m.end() - 1)
            if not any(a <= first and after <= b for _, a, b in kept):
                kept.append((rule, first, after))
    base = {r.label for r in L.RULES if r.base and r.pattern.search(joined)}
    surest = {}
    for r, *_ in [*kept, *((r, 0, 0) for r in L.RULES if r.base and r.label in base)]:
        surest[r.label] = max(surest.get(r.label, 0), r.weight)
    return ",".join(sorted(surest)), 1 - math.prod(1 - w for w in surest.values())


def test_labels_and_scores_equal_a_model_without_gate(spark, sf_dir, tmp_path):
    def spelt(rule):  # a text that the rule's pattern matches, as far as plain words and first choices go
        x = rule.pattern.pattern.decode("latin-1")[12:-9]
        x = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", x)
        return re.sub(r" \?|\[cs\]|\?", lambda m: {" ?": " ", "[cs]": "s"}.get(m[0], ""), x)

    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [f"see below: {spelt(r)}. Copyright (c) 2020 MIT License {spelt(L.RULES[-r.number])}" for r in L.RULES[::3]]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in L.op1_license_scan(spark, str(tmp_path)).collect()}
    hits = 0
    for i, t in rows:
        labels, score = model(t or "")
        assert got[i].labels == labels and math.isclose(got[i].score, score, abs_tol=1e-9), t[:300]
        hits += bool(labels)
    assert hits > 150


def test_very_many_detections_take_linear_time():
    began = time.perf_counter()
    n, found = L.detect(b"mit license " * 500_000)
    assert n == 1_000_000 and sum(k for r, _, _, k in found if r.base) == 500_000
    assert time.perf_counter() - began < 60


def test_rules_are_many_and_written():
    assert len(NOTICES) + len(LICENSES) + len(FORMS) + len(BASE) >= 200 and len(L.RULES) >= 500
    assert len({r.label for r in L.RULES}) >= 80
