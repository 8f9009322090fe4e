"""Hierarchical packing of documents into sequences of several context sizes.

A document is its token ids and END. Full windows of the longest tier are cut off; what remains is routed to the
shortest tier that holds it. Within a window of documents the longest remaining piece opens a sequence of its
tier; its gap is filled from shorter pieces, the longest that fits first, and at last by cutting one, so every
sequence of a window but the last is exactly full at its tier's size (a power of two: no padding). The pieces of
the last one go on into the task's next window; at the end of a task they are cut at powers of two. The sequences of
a tier, counted through over all tasks (a count for each task and tier), are dealt in that order into step groups of
STEP_TOKENS tokens each, so that a training step has as many tokens in whatever tier it draws from; only the last
group of a tier may have fewer.

A task packs the documents of its own partition, so no document is shuffled; memory is bounded by WINDOW_TOKENS and
WINDOW_DOCS and one text. Partitions give their number to the sequence ids; a task that is run again makes the
same rows. A null text is an empty one (END alone); null doc_ids and repeated rows are packed like any other; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, settle, small_batches
from .tokens import words_of

TIERS = (512, 1024, 2048, 4096)
END = 2
STEP_TOKENS = 1 << 17
WINDOW_TOKENS = 1 << 21
WINDOW_DOCS = 20_000
#: Sequences of one task have numbers below 1 << TASK_BITS.
TASK_BITS = 36

#: step_group is, while packing, the sequence's number in its task and tier.
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

#: A piece: its length, the number of its document in the window, its start there.
Piece = tuple[int, int, int]


def pack_window(lengths: Sequence[int], carried: Sequence[Piece] = (), tiers: Sequence[int] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full sequences (tier, pieces) from documents of these lengths and the pieces carried over, and what is left."""
    longest, full, pool = tiers[-1], [], sorted(carried)
    for i, n in enumerate(lengths):
        cut = n - n % longest
        full += [(longest, [(longest, i, at)]) for at in range(0, cut, longest)]
        if n > cut:
            pool.append((n - cut, i, cut))
    pool.sort()
    while pool:
        first = pool.pop()
        tier = next(t for t in tiers if t >= first[0])
        pieces, gap = [first], tier - first[0]
        while gap and pool:
            j = bisect_right(pool, gap, key=lambda p: p[0]) - 1
            if j >= 0:
                piece = pool.pop(j)
            else:
                n, i, at = pool.pop(0)
                piece = (gap, i, at)
                insort(pool, (n - gap, i, at + gap))
            pieces.append(piece)
            gap -= piece[0]
        if gap:
            return full, pieces
        full.append((tier, pieces))
    return full, []


def pack_rest(pieces: Sequence[Piece]) -> list[tuple[int, list[Piece]]]:
    """Sequences of falling powers of two that hold just these pieces."""
    out, rest = [], list(pieces)[::-1]
    total = sum(p[0] for p in rest)
    for size in (1 << b for b in range(total.bit_length(), -1, -1) if total >> b & 1):
        own, gap = [], size
        while gap:
            n, i, at = rest.pop()
            if n > gap:
                rest.append((n - gap, i, at + gap))
            own.append((min(n, gap), i, at))
            gap -= own[-1][0]
        out.append((size, own))
    return out


def _packer(path: str, tiers: Sequence[int], with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << TASK_BITS
        words, serial, of_tier = words_of(path), 0, dict.fromkeys(tiers, 0)
        docs: list[tuple[int | None, np.ndarray]] = []
        carried: list[Piece] = []

        def rows(sequences: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            nonlocal serial
            out: list[tuple] = []
            ids: list[np.ndarray] = []
            for tier, pieces in sequences:
                offset = 0
                nth = of_tier.get(tier, 0)
                of_tier[tier] = nth + 1
                for n, i, at in pieces:
                    doc_id, own = docs[i]
                    part = own[at : at + n]
                    crc = zlib.crc32(part.astype("<u4").tobytes())
                    out.append((doc_id, at, n, crc, len(own), task + serial, offset, tier, nth))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    offset += n
                serial += 1
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        def window() -> pa.RecordBatch:
            """Packs what waits; the documents that the last sequence needs stay, numbered anew."""
            nonlocal docs, carried
            fresh = docs[held:]
            full, left = pack_window([len(x[1]) for x in fresh], [(n, i - held, at) for n, i, at in carried], tiers)
            shift = lambda ps: [(n, i + held, at) for n, i, at in ps]
            made = rows([(t, shift(ps)) for t, ps in full])
            left = shift(left)
            kept = sorted({i for _, i, _ in left})
            carried = [(n, kept.index(i), at) for n, i, at in left]
            docs = [docs[i] for i in kept]
            return made

        held = waiting = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                own = np.frombuffer(words.ids(text.as_py() or "") + END.to_bytes(2, "little"), "<u2")
                docs.append((doc_id.as_py(), own))
                waiting += len(own)
                if waiting >= WINDOW_TOKENS or len(docs) >= WINDOW_DOCS:
                    yield window()
                    held, waiting = len(docs), 0
        yield window()
        yield rows(pack_rest(carried))

    return pack


def pack(docs: DataFrame, tokenizer: str, tiers: Sequence[int] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row for each piece of docs (doc_id, text); with_ids adds the piece's token ids. tokenizer: a file's path."""
    small_batches(docs.sparkSession)
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = settle(light.mapInArrow(_packer(tokenizer, tuple(tiers), with_ids), SCHEMA + ", ids array<int>" * with_ids))
    task = F.shiftright("sequence_id", TASK_BITS)
    counts = packed.where("offset = 0").groupBy(task.alias("_task"), F.col("tier").alias("_tier")).agg(F.count("*").alias("_n"))
    before = W.partitionBy("_tier").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    counts = settle(counts.select("_task", "_tier", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    a_step = F.greatest(F.lit(1), F.floor(F.lit(STEP_TOKENS) / F.col("tier")))
    step = F.shiftleft(F.col("tier").cast("long"), 40) + F.floor((F.col("_before") + F.col("step_group")) / a_step)
    return packed.join(counts, (task == F.col("_task")) & (F.col("tier") == F.col("_tier"))).select(
        *[step.cast("long").alias(c) if c == "step_group" else packed[c] for c in packed.columns]
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 512 to 4096 tokens, a row for each piece."""
    return pack(read_table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op3_pack": op3_pack}
ORACLE_SQL: dict[str, str] = {}
