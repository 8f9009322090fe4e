"""License scan by ordered signature rules.

A text's words are what `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` matches with A-Z lower-cased. A rule is tried only on
texts that hold its keywords (an Aho-Corasick pass over the whole text finds the words of all rules at once); its pattern runs over the words joined by single spaces. Overlaps are resolved in rule order: a detection
whose words lie inside those of one that was kept before it (of a rule of higher priority, or an earlier rule of
the same) is suppressed; the matches of one rule are searched among the kept ones together, so a text of very many
detections takes linear time. Base phrases are rules as well; their labels stand even where a longer detection
suppresses them, and all their places count, overlapping ones too.

score is 1 - prod(1 - weight) over the labels with a kept detection, each with its surest weight: 0 for none.

A null text is an empty one (no words, no detections). Each row stands alone: repeated rows get equal results,
null ids pass through, an empty table gives no rows. Whole texts are scanned, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches
from .license_rules import BASE, Rule, build_rules

RULES = build_rules()
_GAPS = re.compile(rb"[^0-9a-z\x80-\xff]+")
#: Word bytes in lower-cased UTF-8: digits, a-z and all of non-ASCII.
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words_of(low: bytes) -> np.ndarray:
    """Where each word of lower-cased UTF-8 starts."""
    is_word = _IS_WORD[np.frombuffer(low, np.uint8)]
    return np.flatnonzero(is_word & ~np.r_[False, is_word[:-1]])


class Gate:
    """The prefilter: one Aho-Corasick pass finds which keywords a text's words hold, and so which rules to try."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.free = [r for r in rules if not r.keywords]
        self.words = ahocorasick.Automaton()
        for word in {w for r in rules for group in r.keywords for w in group}:
            self.words.add_word(f" {word.decode('latin-1')} ", word)
        self.words.make_automaton()

    def open(self, joined: bytes) -> list[Rule]:
        held = {word for _, word in self.words.iter(f" {joined.decode('latin-1')} ")}
        return [r for r in self.rules if all(not held.isdisjoint(group) for group in r.keywords)] if held else self.free


GATE = Gate(RULES)


class Kept:
    """The intervals kept so far, by their starts, with the furthest end of all that start no later."""

    def __init__(self) -> None:
        self.starts = self.ends = np.zeros(0, np.int64)

    def hold(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Which intervals lie inside a kept one: a search each, however many are kept."""
        at = np.searchsorted(self.starts, first, "right") - 1
        return (at >= 0) & (np.r_[self.ends, 0][at] >= after)

    def add(self, first: np.ndarray, after: np.ndarray) -> None:
        starts, ends = np.r_[self.starts, first], np.r_[self.ends, after]
        order = np.argsort(starts, kind="stable")
        self.starts, self.ends = starts[order], np.maximum.accumulate(ends[order])


def detect(low: bytes) -> tuple[int, list[tuple[Rule, int, int, bool]]]:
    """The number of words, and (rule, first word, word after the last, kept) in rule order, then by place."""
    starts = words_of(low)
    joined = _GAPS.sub(b" ", low).strip()
    rules = GATE.open(joined)
    if not rules:
        return len(starts), []
    begins = np.r_[0, np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1]
    found: list[tuple[Rule, int, int, bool]] = []
    kept = Kept()
    for rule in rules:
        spans = np.array([m.span() for m in rule.pattern.finditer(joined)], np.int64)
        if len(spans):
            first = np.searchsorted(begins, spans[:, 0], "right") - 1
            after = np.searchsorted(begins, spans[:, 1] - 1, "right")
            free = ~kept.hold(first, after)
            found += [(rule, a, b, k) for a, b, k in zip(first.tolist(), after.tolist(), free.tolist(), strict=True)]
            kept.add(first[free], after[free])
    return len(starts), found


def char_spans(low: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as spans of code points of the text."""
    raw = np.frombuffer(low, np.uint8)
    is_word = np.r_[_IS_WORD[raw], False]
    starts, ends = words_of(low), np.flatnonzero(is_word[:-1] & ~is_word[1:]) + 1
    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in spans]


DETECTION = "struct<rule:int,label:string,kind:string,priority:int,first_word:long,after_word:long,start:long,end:long,kept:boolean,base:boolean,weight:double>"
SCHEMA = f"doc_id long, n_words long, detections array<{DETECTION}>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([
        ("rule", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()), ("after_word", pa.int64()),
        ("start", pa.int64()), ("end", pa.int64()), ("kept", pa.bool_()), ("base", pa.bool_()), ("weight", pa.float64()),
    ]))
    for batch in batches:
        counts, rows = [], []
        for text in batch.column("text").cast(pa.binary()):
            low = (text.as_py() or b"").lower()
            n, found = detect(low)
            spans = char_spans(low, [(a, b) for _, a, b, _ in found]) if found else []
            counts.append(n)
            rows.append([
                {"rule": r.number, "label": r.label, "kind": r.kind, "priority": r.priority, "first_word": a, "after_word": b,
                 "start": s, "end": e, "kept": k, "base": r.base, "weight": r.weight}
                for (r, a, b, k), (s, e) in zip(found, spans, strict=True)
            ])
        arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(rows, kind)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "detections"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, detections) of each row of docs (doc_id, text); other columns are not read."""
    small_batches(docs.sparkSession)
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return light.mapInArrow(_scan, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, places of the base phrases, labels and score of every document."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: d["kept"] | d["base"])
    starts = F.transform(base, lambda d: d["first_word"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda d: d["label"]))), ",")
    surest = F.transform(
        F.array_distinct(F.transform(kept, lambda d: d["label"])),
        lambda name: F.array_max(F.transform(F.filter(kept, lambda d: d["label"] == name), lambda d: d["weight"])),
    )
    score = 1 - F.aggregate(surest, F.lit(1.0), lambda acc, w: acc * (1 - w))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(kept).alias("labels"), score.alias("score"),
    )


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL: dict[str, str] = {}
assert len({p for p, _ in BASE}) == len(BASE)
