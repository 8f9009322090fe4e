"""Connected components by randomised contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, component long) for each node of edges (a long, b long); component is the smallest node of its part.

    Each round maps every node to the neighbour (or itself) that comes first in a hash order of that round,
    then maps the edges; about half of the labels go in a round whatever the shape of the graph, so a chain
    takes logarithmically many rounds. A node's minimum is pre-aggregated before its shuffle; the maps are
    written tables, so each join shuffles both sides afresh and AQE can split a hot label. Self-loops and
    repeated edges do no harm; edges with a null end are left out; no edges give no rows.
    """
    edges = settle(
        edges.where("a <> b")
        .select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
        .distinct()
    )
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        salt = F.lit(len(maps))
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("n")))
        own = F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("n"))
        step = settle(
            both.groupBy("a").agg(first.alias("m")).select(F.col("a").alias("node"), F.least(own, "m")["n"].alias("to"))
        )
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = settle(
            edges.join(left, "a")
            .join(right, "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = maps[0]
    for step in maps[1:]:
        labels = labels.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select(
            "node", F.coalesce("next", "to").alias("to")
        )
    labels = settle(labels)
    smallest = settle(labels.groupBy("to").agg(F.min("node").alias("component")))
    return labels.join(smallest, "to").select("node", "component")
