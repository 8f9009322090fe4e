"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import read_table, settle

__all__ = ["col", "fresh", "rank_within", "read_table", "row_ids", "settle", "small_batches"]

#: What one Arrow batch to a Python worker may hold: with it both sides' buffers stay small, whatever a text's length.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches; a session that has set lower bounds keeps them."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)b?", str(spark.conf.get(name)).lower()).groups()
        now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    return spark


def fresh(df: DataFrame, stem: str, others: Sequence[str] = ()) -> str:
    """A column name that neither df nor others has (names compare without case)."""
    taken = {c.lower() for c in [*df.columns, *others]}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows of one chunk of row_ids(): the most that a window of rank_within() orders together.
CHUNK_BITS = 16


def row_ids(df: DataFrame, name: str) -> DataFrame:
    """df as a written table with a long `name` that is unique and counts up by one within each written part."""
    return settle(df.withColumn(name, F.monotonically_increasing_id()))


def rank_within(rows: DataFrame, keys: Sequence[str], rid: str, name: str) -> DataFrame:
    """rows (a table of row_ids) with a long `name`: the rank from 0 by rid among the rows of the same keys.

    A key may hold any share of the rows: they are counted by chunks of 2 ** CHUNK_BITS row ids, the counts of a
    key are summed up in order (one row a chunk), and only the rows of one chunk are ordered together.
    """
    chunk, first = fresh(rows, "chunk"), fresh(rows, "first")
    rows = rows.withColumn(chunk, F.shiftright(col(rid), CHUNK_BITS))
    n = fresh(rows, "n")
    before = W.partitionBy(*map(col, keys)).orderBy(col(chunk)).rowsBetween(W.unboundedPreceding, -1)
    counts = settle(
        rows.groupBy(*map(col, [*keys, chunk]))
        .agg(F.count("*").alias(n))
        .withColumn(first, F.coalesce(F.sum(col(n)).over(before), F.lit(0)))
        .drop(n)
    )
    same = [rows[f"`{c}`"].eqNullSafe(counts[f"`{c}`"]) for c in [*keys, chunk]]
    kept = [rows[f"`{c}`"] for c in rows.columns]
    inside = W.partitionBy(*map(col, [*keys, chunk])).orderBy(col(rid))
    return (
        rows.join(counts, same)
        .select(*kept, counts[f"`{first}`"])
        .withColumn(name, col(first) + F.row_number().over(inside) - 1)
        .drop(chunk, first)
    )
