"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words (runs of other bytes than \\x20 and \\x09-\\x0D); all of its text is
used. A passage is encoded by the square roots of how often each pair of byte classes and each of WORDS groups of words (by
hash) stands in it, how often a word repeats the one before it, its share of distinct words and its word length; a learned layer maps that to a hidden vector h. Gated
attention weighs the passages, a ~ softmax(w . (tanh(V h) * sigmoid(U h))), and the score is a logistic function
of their weighted mean. All weights are learned together from document labels alone, by Adam on the driver.

Training takes the TRAIN_DOCS labelled documents that come first by a hash of doc_id among those whose
crc32(doc_id as text) mod 5 is not 0, with all their passages; that bounds what reaches the driver. Scores use
every passage, summed up block by block, so a very long text needs the memory of one block of passages and of its
bytes and word starts. Labels, lang, source and doc_id are no inputs.

Labels other than 0 and 1 are left out; of a doc_id with several labels the mean decides, of one with several
texts the largest is used. Without any label all scores are 0.5. A null or empty text is a bag of one empty
passage. Rows with a null doc_id are scored, not held out and never trained on. Repeated rows score alike; empty
tables give no rows; other columns pass through, and score() takes the name of the column it adds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, read_table, small_batches

PASSAGE = 64
TRAIN_DOCS = 4000
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12
EPOCHS, BAGS, RATE, DECAY = 12, 64, 0.01, 1e-4
#: Passages that are encoded at once: bounds the memory that a very long text takes.
PASSAGES_AT_ONCE = 4096

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:'\"-()", "!?", "#$%&*@^~+=", "|<>{}[]\\/_`"]
OTHER = len(_CLASSES)
KINDS = OTHER + 1
_CLASS = np.full(256, OTHER, np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Groups of words, a power of two.
WORDS = 128
FEATURES = KINDS * KINDS + WORDS + 4
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(63, 0x100000001B3, np.uint64)])


def blocks(text: bytes) -> Iterator[np.ndarray]:
    """One row of FEATURES for each passage of a text in UTF-8, PASSAGES_AT_ONCE rows at a time; a row of zeros if it has no words."""
    raw = np.frombuffer(text, np.uint8)
    space = _IS_SPACE[raw]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        yield np.zeros((1, FEATURES))
    step = PASSAGE * PASSAGES_AT_ONCE
    for at in range(0, len(starts), step):
        end = starts[at + step] if at + step < len(starts) else len(raw)
        own = starts[at : at + step]
        yield _encode(raw[own[0] : end], space[own[0] : end], own - own[0])


def passages(text: bytes) -> np.ndarray:
    """The rows of all blocks."""
    return np.concatenate(list(blocks(text)))


def _encode(raw: np.ndarray, space: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n_words, n_bytes = len(starts), len(raw)
    n = -(-n_words // PASSAGE)
    heads = starts[::PASSAGE]
    lengths = np.diff(np.r_[heads, n_bytes])
    of_byte = np.repeat(np.arange(n), lengths)
    kinds = _CLASS[raw].astype(np.int64)
    pairs = kinds[:-1] * KINDS + kinds[1:]
    table = np.bincount(of_byte[:-1] * (KINDS * KINDS) + pairs, minlength=n * KINDS * KINDS).reshape(n, -1)
    of_word = np.arange(n_words) // PASSAGE
    words = np.bincount(of_word, minlength=n)
    within = np.arange(n_bytes) - np.repeat(starts, np.diff(np.r_[starts, n_bytes]))
    value = np.where(space, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[within & 63])
    hashes = np.add.reduceat(value, starts)
    same = np.r_[False, hashes[1:] == hashes[:-1]] & np.r_[False, of_word[1:] == of_word[:-1]]
    repeats = np.bincount(of_word, same, n)
    order = np.lexsort((hashes, of_word))
    first = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])]
    distinct = np.bincount(of_word[order], first, n)
    letters = np.bincount(of_byte, ~space, n)
    group = (hashes * _SPREAD >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64)
    held = np.bincount(of_word * WORDS + group, minlength=n * WORDS).reshape(n, -1)
    tail = np.stack([repeats / words, distinct / words, letters / words / 10, np.log1p(words) / 5], axis=1)
    return np.concatenate([np.sqrt(table / lengths[:, None]), np.sqrt(held / words[:, None]), tail], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """mean and scale of the features, and the weights by name."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of standardised passages: hidden vectors, the two gates, and the exponents of the attention."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, s, (t * s) @ p["w"]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages, bag after bag; first: where each bag starts."""
        p, sizes = self.p, np.diff(np.r_[first, len(x)])
        bag = np.repeat(np.arange(len(first)), sizes)
        h, t, s, e = self.hidden(x)
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"][0])}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        bag, h, t, s, a, z = (f[k] for k in ("bag", "h", "t", "s", "a", "z"))
        do = (f["y"] - y) / len(y)
        dz = (do[:, None] * p["c"])[bag]
        da = (h * dz).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        out = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ do, "d": np.array([do.sum()])}
        return {k: g + DECAY * p[k] * (k not in ("b", "d")) for k, g in out.items()}

    def score(self, features: np.ndarray) -> float:
        """A document's score from the features of all its passages."""
        return self.score_blocks([features])

    def score_blocks(self, some: Iterable[np.ndarray]) -> float:
        """The same from blocks of passages, one held at a time: the sums are kept relative to the greatest exponent so far."""
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for features in some:
            h, _, _, e = self.hidden((features - self.mean) / self.scale)
            now = max(top, e.max())
            a, old = np.exp(e - now), np.exp(top - now)
            top, total, z = now, total * old + a.sum(), z * old + a @ h
        return float(_sigmoid(z / total @ self.p["c"] + self.p["d"][0]))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Attention | None:
    """A model from the passages of some documents and their labels; None without documents."""
    if not bags:
        return None
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags)
    sd, mean = rows.std(0, dtype=float), rows.mean(0, dtype=float)
    del rows
    shape = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: np.zeros(v) if k in ("b", "d") else rng.normal(0, 1 / np.sqrt(v[0]), v) for k, v in shape.items()}
    model = Attention(mean, sd + 0.02, p)
    bags = [((x - model.mean) / model.scale).astype(x.dtype) for x in bags]
    m1, m2, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), BAGS):
            some = order[at : at + BAGS]
            sizes = [len(bags[i]) for i in some]
            g = model.gradients(np.concatenate([bags[i] for i in some]), np.cumsum([0, *sizes[:-1]]), labels[some])
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").cast(pa.binary()):
            rows.append(passages(text.as_py() or b"").astype(np.float16).tobytes())
        arrays = [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "label", "features"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_DOCS) -> Attention | None:
    """A model from at most `limit` of the documents that `labels` (doc_id and the label) covers."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), col(label).cast("double").alias("label"))
    known = known.where(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.round(F.avg("label")).alias("label"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    if not known:
        return None
    chosen = docs.sparkSession.createDataFrame(known, "doc_id long, label double")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id")  # at most `limit` rows
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    small_batches(docs.sparkSession)
    rows = texts.mapInArrow(_sampled, "doc_id long, label double, features binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    bags = [np.frombuffer(r.features, np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows]
    return fit(bags, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Attention | None, name: str = "score") -> DataFrame:
    """docs with the double column `name`: the score of each whole text."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))

    def scores(text: pa.Array) -> pa.Array:
        return pa.array([model.score_blocks(blocks(x.as_py() or b"")) for x in text.cast(pa.binary())], pa.float64())

    small_batches(docs.sparkSession)
    return docs.withColumn(name, F.arrow_udf(scores, T.DoubleType())(F.col("text").cast("string")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels.quality."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}
