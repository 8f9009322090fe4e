"""Streams: bounded price history, change detection between snapshots, windowed sums with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.compare import KEY, compare
from ..schema import DEFAULTS, Settings

OUT = "event_type string, user_id long, n long, newest_id long, newest_value double, total double"
STATE = "ids array<long>, times array<long>, values array<double>"


def bounded_history(events: DataFrame, keep: int = DEFAULTS.history_kept) -> DataFrame:
    """For each (event_type, user_id) the newest `keep` events so far, summed up: one row an update.

    events: event_id, ts, user_id, event_type, value, as a stream. State is at most `keep` rows a key, so it does not
    grow with the stream; order is by (ts, event_id), whatever the order of arrival.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [r for part in [state.get] if state.exists for r in zip(*part, strict=True)] if state.exists else []
        rows = [(t, i, v) for i, t, v in rows]
        for b in batches:
            stamps = b["ts"].astype("datetime64[us]").astype("int64")
            rows += list(zip(stamps.tolist(), b["event_id"].tolist(), b["value"].tolist(), strict=True))
            rows = sorted(rows)[-keep:]
        state.update(([r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows]))
        yield pd.DataFrame([(key[0], key[1], len(rows), rows[-1][1], rows[-1][2], float(sum(r[2] for r in rows)))], columns=[x.split()[0] for x in OUT.split(", ")])

    light = events.select("event_type", "user_id", "event_id", "ts", "value")
    return light.groupBy("event_type", "user_id").applyInPandasWithState(update, OUT, STATE, "update", "NoTimeout")


def windowed_totals(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) per window of event time; rows later than `late` are left out (our extension)."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    out = out.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def detect_changes(snapshots: DataFrame, store: str, sink: Callable[[DataFrame, int], None], key: Sequence[str] = KEY, settings: Settings = DEFAULTS):
    """A stream writer that compares each batch of products with the last stored one and hands the result to sink.

    The stored snapshots are numbered by batch, so a batch that runs again compares with the same one.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        current = batch.persist()
        try:
            done = [int(f.getPath().getName().split("=")[1]) for f in _list(spark, store) if f.getPath().getName().startswith("batch=")]
            before = max((n for n in done if n < number), default=None)
            if before is not None:
                sink(compare(current, spark.read.schema(current.schema).parquet(f"{store}/batch={before}"), key, settings), number)
            current.write.mode("overwrite").parquet(f"{store}/batch={number}")
        finally:
            current.unpersist()

    return snapshots.writeStream.foreachBatch(each)


def _list(spark: SparkSession, folder: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    return list(fs.listStatus(path)) if fs.exists(path) else []


def deliver_alerts(alerts: DataFrame, send: Callable[[DataFrame], object]):
    """A stream writer that hands each batch of alerts to send()."""
    return alerts.writeStream.foreachBatch(lambda batch, _: send(batch) and None)
