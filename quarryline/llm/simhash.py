"""SimHash near-duplicates by anchor-point covering.

A document's words are what `[^\\x20\\x09-\\x0D]+` matches in its text with A-Z lower-cased; its features are
all 3-word shingles (the whole sequence if it has fewer words), repeats included, hashed by XXH64 (UTF-8,
seed 42). A bit of the fingerprint is 1 if it is set in over half the hashes. Documents without words have
fingerprint zero and link like any other. Fingerprints link if they differ in at most MAX_DISTANCE bits.

Anchors are the codewords of the Hamming [63,57] code over the low 63 bits, a perfect code: each word lies
within R = 1 of exactly one codeword. Two fingerprints at distance t <= 2 have a word m between them, at most
one bit from either, and m lies within R of some codeword, so both lie within R + ceil(t / 2) = 2 of it.
Copying a fingerprint to every anchor within 2 (32 of them, or 1 for a codeword) therefore loses no pair; the
plain bound R + t = 3 would find the same pairs from 652 copies. Equal fingerprints are merged first, so the
number of fingerprints near an anchor is at most 2 * (1 + 63 + 1953) however many documents are alike, and
no task collects an unbounded group. A copy holds its anchor and which bits it has flipped, not the fingerprint, as that is
shorter to shuffle. Per anchor only a spanning forest of the links leaves the task.

keep_one_of_each_group(), the stage of a corpus pipeline, is for near-copies: texts whose sets of NEAR_SHINGLE-word shingles
have a Jaccard similarity of SIMILARITY or more. Few of these differ in 2 bits of a fingerprint of shingles, so it takes
PRINTS fingerprints of each text, of its words, once or twice each (an edit changes one word, but several shingles),
each with another hash; the anchors find those within MAX_DISTANCE bits in any of them, and only pairs whose similarity holds
on the whole texts are linked. Texts that are equal are one from the start. A candidate pair is verified only while its
ends are apart: first the one to its smallest neighbour of each text, then one between any two groups so found, at last
all that are still between groups. So a large group of near-copies costs about a pair a text. Near an anchor the candidates are a
forest and for equal prints a star, so a pair can stay apart if the pairs that join it there are not similar in any print.

Nulls: a null text is an empty one; a row with a null doc_id gets the fingerprint and component of its text,
but never names a component. Repeated rows all stay. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, read_table, row_ids, settle, small_batches
from .components import connected_components

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
CODE_BITS = 63
LOW = np.uint64((1 << CODE_BITS) - 1)
NEAR_SHINGLE, SIMILARITY, PRINTS = 5, 0.8, 10
#: A word counts so often at most in a print: else all long texts of a language would be alike.
MOST_COUNTED = 2
#: Bytes of a text whose words are held at once: bounds the memory that a very long text takes.
SLICE = 1 << 19
_SPACE = re.compile(rb"[\t-\r ]")


def slices(text: bytes) -> Iterator[bytes]:
    """text, cut at white space into parts of about SLICE bytes."""
    at = 0
    while len(text) - at > SLICE:
        space = _SPACE.search(text, at + SLICE)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit SimHash of one text in UTF-8."""
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for part in slices(text):
        words = words[-(SHINGLE - 1) :] + part.lower().split()  # bytes: A-Z only, and splits at \x20 and \x09-\x0D
        if len(words) >= SHINGLE:
            hashes = np.array([digest(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:], strict=False)], "<u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(hashes)
    if not total:
        return digest(b" ".join(words), SEED) if words else 0
    return sum(1 << i for i in np.flatnonzero(counts * 2 > total).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        values = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long: the fingerprint's bits) of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def word_prints(text: bytes) -> np.ndarray:
    """PRINTS fingerprints of a text's words, once or twice each; zero without words."""
    counts: Counter = Counter()
    for part in slices(text):
        counts.update(part.lower().split())
    if not counts:
        return np.zeros(PRINTS, np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in counts], np.uint64)
    n, out = np.minimum(list(counts.values()), MOST_COUNTED).astype(np.int64), np.zeros(PRINTS, np.uint64)
    for k in range(PRINTS):  # another hash of each word out of the first one
        h = (hashes ^ np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[k] = sum(1 << i for i in np.flatnonzero((n @ bits) * 2 > n.sum()).tolist())
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def _word_prints(text: pa.Array) -> pa.Array:
    return pa.array([word_prints(x.as_py() or b"").view(np.int64) for x in text.cast(pa.binary())], pa.list_(pa.int64()))


def near_shingles(text: bytes) -> np.ndarray:
    """The hashes of a text's NEAR_SHINGLE-word shingles in order, each once; of fewer words, of the whole sequence."""
    words = text.lower().split()
    parts = (words[i : i + NEAR_SHINGLE] for i in range(max(1, len(words) - NEAR_SHINGLE + 1))) if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x)) for x in parts), np.uint64))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [near_shingles(x.as_py() or b"").tobytes() for x in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose sets of shingles are similar enough."""
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
            if both >= SIMILARITY * (len(x) + len(y) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


#: The bit of each position from 1; position 0 is none.
BITS = np.array([0, *(1 << i for i in range(CODE_BITS))], np.uint64)
#: The bit flips of weight at most 2 that lead from each syndrome to a codeword, as 64 times one position and the other.
FLIPS = [np.array([s, *((i << 6) + (i ^ s) for i in range(1, 64) if i < (i ^ s))], np.int32) if s else np.zeros(1, np.int32) for s in range(64)]
#: Stands in a flip for the bit that the code leaves out.
TOP = 1 << 12


#: Bit k of a word's syndrome is the parity of its bits at positions that have bit k.
CHECKS = [np.uint64(sum(1 << (i - 1) for i in range(1, 64) if i >> k & 1)) for k in range(6)]


def flips_to_anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors within 2 of each fingerprint, with the fingerprint's index and the flip from the anchor back to it."""
    low = fps & LOW
    syndrome = sum((np.bitwise_count(low & c) & 1).astype(np.int64) << k for k, c in enumerate(CHECKS))
    anchors, index, flips = [], [], []
    for s, own in enumerate(FLIPS):
        at = np.flatnonzero(syndrome == s)
        anchors.append((low[at, None] ^ (BITS[own >> 6] ^ BITS[own & 63])[None, :]).ravel())
        index.append(np.repeat(at, len(own)))
        flips.append(np.tile(own, len(at)))
    index, flips = np.concatenate(index), np.concatenate(flips)
    return np.concatenate(anchors), index, flips + np.where(fps[index] > LOW, TOP, 0).astype(np.int32)


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within 2 of each fingerprint, with the fingerprint's index."""
    return flips_to_anchors(fps)[:2]


def unflipped(anchors: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """The fingerprints that lie so from their anchors."""
    return anchors ^ BITS[flips >> 6 & 63] ^ BITS[flips & 63] ^ np.where(flips & TOP, ~LOW, np.uint64(0))


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchors, _, flips = flips_to_anchors(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(flips)], ["anchor", "flip"])


def _forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among a few distinct fingerprints."""
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= MAX_DISTANCE
            found, rest = rest[near].tolist(), rest[~near]
            front += found
            left += [x] * len(found)
            right += found
    return left, right


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links per anchor from rows sorted by anchor; the last anchor of a batch waits for the next batch."""

    def within(anchors: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(anchors) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(anchors)])
        pair = starts[sizes == 2]
        pair = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= MAX_DISTANCE] if len(pair) else pair
        a, b = [fps[pair]], [fps[pair + 1] if len(pair) else fps[pair]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = fps[at : at + n]
            left, right = _forest(own)
            a.append(own[left])
            b.append(own[right])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    wait_a, wait_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        anchors = np.r_[wait_a, batch.column("anchor").to_numpy(zero_copy_only=False)]
        flips = batch.column("flip").to_numpy(zero_copy_only=False)
        fps = np.r_[wait_f, unflipped(anchors[len(wait_a) :].view(np.uint64), flips)]
        if not len(anchors):
            continue
        cut = int(np.searchsorted(anchors, anchors[-1]))
        wait_a, wait_f = anchors[cut:], fps[cut:]
        yield within(anchors[:cut], fps[:cut])
    yield within(wait_a, wait_f)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect what fingerprints (fp long, distinct) at most MAX_DISTANCE bits apart connect."""
    near = fps.select("fp").mapInArrow(_to_anchors, "anchor long, flip int")
    return near.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component, component_id) of each row of docs (doc_id, text).

    component is one fingerprint of the component, component_id the smallest doc_id that links reach, its own
    included (null if all of the component's doc_ids are).
    """
    own = settle(fingerprints(docs))
    firsts = settle(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = settle(connected_components(links(firsts)).withColumnRenamed("node", "fp"))
    named = settle(
        firsts.join(parts, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    )
    smallest = settle(named.groupBy("component").agg(F.min("first").alias("component_id")))
    ids = settle(named.join(smallest, "component").select("fp", "component", "component_id"))
    return own.join(ids, "fp").select("doc_id", "fp", "component", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = simhash_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def candidates(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes of prints (node, fp) with fingerprints that the anchors find near, the same ones by a star."""
    firsts = settle(prints.groupBy("fp").agg(F.min("node").alias("first")))
    ends = [firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in ("a", "b")]
    between = links(firsts).join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    alike = prints.join(firsts, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = between.unionByName(alike).where("a <> b")
    return settle(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) are similar enough."""
    for c in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")).hint("merge"), c)
    return settle(pairs.select("a", "b", "set_a", "set_b").mapInArrow(_similar, "a long, b long"))


def near_groups(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of the nodes that candidate pairs (a, b) join, where their sets are similar enough."""
    least = F.min(F.struct("part_a", "a", "b")).alias("p")
    linked, part = None, pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    for turn in range(3):
        live = pairs
        for c in ("a", "b"):
            live = live.join(part.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")), c, "left")
        live = live.select("a", "b", F.coalesce("part_a", "a").alias("part_a"), F.coalesce("part_b", "b").alias("part_b")).where("part_a <> part_b")
        if turn < 2:
            live = live.groupBy("part_b", *["part_a"] * turn).agg(least).select("p.a", "p.b")
        live = settle(live.select("a", "b"))
        if live.isEmpty():
            break
        more = verified(live, sets)
        linked = more if linked is None else settle(linked.unionByName(more))
        part = settle(connected_components(linked))
    return part


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that stay, one of each group of near-copies.

    It is that of the smallest doc_id (null last, then by hash); of rows that have it and its text, one.
    """
    small_batches(docs.sparkSession)
    whole, keys = F.coalesce(F.col("text").cast("string"), F.lit("")), ["one", "two"]  # a text's hash of 128 bits
    hashes = {"one": F.xxhash64(whole), "two": F.xxhash64(F.lit(1), whole)}
    own = settle(docs.select(F.col("doc_id").cast("long").alias("id"), *[h.alias(k) for k, h in hashes.items()], _word_prints(whole).alias("prints")))
    order = F.struct(F.col("id").isNull().alias("last"), "id")
    texts = own.groupBy(*keys).agg(F.min(order).alias("best"), F.min("prints").alias("prints"))
    texts = row_ids(texts.select(*keys, "best.*", "prints"), "node")
    pairs = candidates(texts.select("node", F.explode("prints").alias("fp")).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = settle(texts.select("node", *keys).join(ends, "node", "left_semi"))
    found = docs.select(whole.alias("text"), *[h.alias(k) for k, h in hashes.items()]).join(asked, keys)
    sets = settle(found.dropDuplicates(keys).select("node", "text").mapInArrow(_shingled, "node long, shingles binary"))
    groups = near_groups(pairs, sets)
    named = texts.select("node", "last", "id", *keys).join(groups, "node", "left")
    best = F.min_by(F.struct("id", *keys), F.struct("last", "id", *keys)).alias("b")
    kept = settle(named.groupBy(F.coalesce("component", "node").alias("part")).agg(best).select("b.*"))
    # what is kept grows with the input, so it is never broadcast
    one, two, rank = (fresh(docs, x) for x in ("hash_a", "hash_b", "nth"))
    keyed = docs.withColumns({one: hashes["one"], two: hashes["two"]})
    same = [keyed["doc_id"].cast("long").eqNullSafe(kept["id"]), keyed[f"`{one}`"] == kept["one"], keyed[f"`{two}`"] == kept["two"]]
    stays = keyed.join(kept.hint("merge"), same, "left_semi")
    repeated = own.join(kept, [own[k].eqNullSafe(kept[k]) for k in ("id", *keys)], "left_semi").groupBy("id", *keys).count().where("count > 1")
    if not settle(repeated).isEmpty():
        nth = F.row_number().over(W.partitionBy("doc_id", one, two).orderBy(one))
        stays = stays.withColumn(rank, nth).where(col(rank) == 1)  # pushed below its shuffle: a row a key and task
    return stays.select(*map(col, docs.columns))


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
