"""Mixing sources to target weights by entropy balancing, all in DataFrame functions.

Sources in code-point order (null last) get weights by turns and share all words by weight; a target stops at
CAP times its source's size, and what it leaves is reshared by weight until no target is above.

Per source, the document rates r = min(CAP, exp(lambda * size / mean size)) are those of least relative entropy
to one copy each under the word constraint sum(size * r) = target and the cap; lambda solves the convex dual by
Newton steps on the logarithm of that sum, kept inside a bracket. A step is one aggregation of the (source, size)
histogram, so it costs no pass over documents and a hot source is pre-aggregated; its sums are decimals, so they do
not depend on the order of partial sums. Rates become copies by order sampling: floor(r) copies for all, one more for
those first by (hash uniform / fraction) while their words fit the target.

What is then missing is less than one document, and is filled by falling size: each size class in turn gives as many
further copies as fit (up to the cap), until what is left is smaller than every document that may still be taken; the
smallest of these is taken as well if it leaves less over than is missing without it. So a source ends within half of
its smallest document that has copies left, whatever its sizes. Within a class, copies go by hash of doc_id.

Sizes are counts of runs of other characters than \\x09-\\x0D and \\x20. Documents of size 0, null texts among
them, get one copy that takes no words. Sources without words have target 0. Repeated rows are shared out one
by one; ties fall by doc_id (nulls first), then size, and rows equal in both are alike, so that reruns agree.
An empty table gives no rows; other columns, whatever their names, pass through. A cap is a whole number of copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, rank_within, read_table, row_ids, settle

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3
MAX_STEPS = 80
TOLERANCE = 1e-7
BRACKET = 1e6
#: Priorities are cut into COARSE steps a unit, the one that matters into FINE.
COARSE, FINE = 256, 4096
#: Names of the columns that are added here; an input's own columns are set aside under other names.
P = "_mix_"
#: The type of sums that must not depend on the order of their parts.
EXACT = "decimal(38,10)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """per_source (source, words, filled) with a double `target`, by filling sources to a common level per weight."""
    ordered = row_ids(per_source.orderBy(F.col("source").asc_nulls_last()), "rid")
    chunk = F.shiftright("rid", 33)  # one written part; parts are in order
    counts = ordered.groupBy(chunk.alias("part")).agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    turn = (F.col("first") + F.col("rid") - F.shiftleft(chunk, 33)) % len(weights)
    weighted = settle(
        ordered.withColumn("part", chunk)
        .join(counts, "part")
        .select("source", "words", "filled", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).alias("weight"))
    )
    total = weighted.agg(F.sum("words")).first()[0] or 0
    level = 0.0
    while total:
        full = F.col("words") * cap <= F.col("weight") * level
        used, open_weight = weighted.agg(
            F.coalesce(F.sum(F.when(full, F.col("words"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight").cast(EXACT))), F.lit(0)),
        ).first()
        following = (total - cap * used) / float(open_weight) if open_weight > 0 else level
        if following <= level:
            break
        level = following
    return weighted.withColumn("target", F.least(F.col("words") * F.lit(float(cap)), F.col("weight") * F.lit(level)))


def _rate(size: Column, lam: Column, mean: Column, cap: int) -> Column:
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(lam * size / mean, F.lit(50.0)))))


def tilts(histogram: DataFrame, aims: DataFrame, cap: int = CAP) -> DataFrame:
    """aims (source, words, filled, target) with `lam` and `mean`; a null lam stands for the cap itself.

    histogram: (source, size, n).
    """
    mean = F.when(F.col("filled") > 0, F.col("words") / F.col("filled")).otherwise(1.0)
    at_cap = F.col("target") >= F.col("words") * cap * (1 - 1e-12)
    state = settle(
        aims.withColumn("mean", mean)
        .withColumn("lam", F.when(~at_cap, F.ln(F.greatest(F.col("target") / F.col("words"), F.lit(1e-9)))))
        .withColumn("lo", F.lit(-BRACKET))
        .withColumn("hi", F.lit(BRACKET))
        .withColumn("done", at_cap)
    )
    for _ in range(MAX_STEPS):
        pending = state.where(~F.col("done"))
        if pending.isEmpty():
            break
        h, s = histogram.alias("h"), pending.alias("s")
        words = F.col("h.size") * F.col("h.n")
        tilt = F.col("h.size") / F.col("s.mean")
        rate = _rate(F.col("h.size"), F.col("s.lam"), F.col("s.mean"), cap)
        sums = (
            h.join(s, F.col("h.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("h.source").alias("key"))
            .agg(
                F.sum((words * rate).cast(EXACT)).cast("double").alias("got"),
                F.sum(F.when(rate < cap, words * rate * tilt).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"),
            )
        )
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - (F.ln("got") - F.ln("target")) * F.col("got") / F.col("slope")
        good = (F.col("slope") > 0) & (F.col("got") > 0) & (newton > lo) & (newton < hi)
        near = F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target")
        moved = pending.join(sums, pending["source"].eqNullSafe(sums["key"])).select(
            "source", "words", "filled", "weight", "target", "mean",
            F.when(near, F.col("lam")).when(good, newton).otherwise((lo + hi) / 2).alias("lam"),
            lo.alias("lo"), hi.alias("hi"), near.alias("done"),
        )
        state = settle(state.where("done").unionByName(moved))
    return state.drop("lo", "hi", "done")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs (doc_id, text, source and any others) with long `size`, `source_size`, double `target` and `rate`, int
    `copies` and long `taken`. Columns of docs that have these names are replaced.
    """
    added = ("size", "source_size", "target", "rate", "copies", "taken")
    own = [c for c in docs.columns if c.lower() not in added]
    light = docs.select(
        *map(col, own),
        word_count(F.col("text").cast("string")).alias(f"{P}size"),
        F.col("source").cast("string").alias(f"{P}source"),
        F.col("doc_id").alias(f"{P}id"),
    )
    mixed = mix_sizes(row_ids(light, f"{P}rid"), weights, cap)
    return mixed.select(
        *map(col, own),
        F.col(f"{P}size").alias("size"), F.col(f"{P}words").alias("source_size"), F.col(f"{P}target").alias("target"),
        F.col(f"{P}rate").alias("rate"), F.col(f"{P}copies").alias("copies"),
        (F.col(f"{P}copies") * F.col(f"{P}size")).alias("taken"),
    )


#: Further copies by falling size: (size, items, t) of each class that gives t. acc.last is the smallest class with copies left.
_FILL = """aggregate(classes,
  named_struct('room', room, 'last', cast(null as struct<size:bigint,items:bigint>),
               'taken', cast(array() as array<struct<size:bigint,items:bigint,t:bigint>>)),
  (acc, x) -> named_struct(
    'room', acc.room - x.size * least(x.spare, acc.room div x.size),
    'last', if(x.spare > acc.room div x.size, named_struct('size', x.size, 'items', x.items), acc.last),
    'taken', if(acc.room >= x.size,
       concat(acc.taken, array(named_struct('size', x.size, 'items', x.items, 't', least(x.spare, acc.room div x.size)))), acc.taken)),
  acc -> if(acc.last.size < 2 * acc.room,
    concat(acc.taken, array(named_struct('size', acc.last.size, 'items', acc.last.items, 't', 1L))), acc.taken))"""


def fill(state: DataFrame, cap: int) -> DataFrame:
    """(key, id, size, n, copies, extra): the items of state (key, id, size, n, copies, target) that get further copies.

    A source is missing less than one document, so its classes of less than twice that are no more than that document
    has words, twice: they fit one row. Of a class that gives t copies the items that come first by hash are taken. To
    rank no more than some of a large class, only those below a hash of (4 t + 64) in `items` are ranked; that fewer
    than t of them are there has a probability below 1e-25.
    """
    room = state.groupBy("key").agg((F.floor(F.max("target")) - F.sum(F.col("copies") * F.col("size"))).alias("room"))
    room = room.where("room > 0").select(F.col("key").alias("rkey"), "room")
    spare = F.col("n") * cap - F.col("copies")
    open_items = state.where((F.col("size") > 0) & (spare > 0)).withColumn("spare", spare)
    classes = open_items.groupBy("key", "size").agg(F.sum("spare").alias("spare"), F.count("*").alias("items"))
    classes = classes.join(room, F.col("key").eqNullSafe(F.col("rkey"))).where("size < 2 * room")
    lists = classes.groupBy("key", "room").agg(F.sort_array(F.collect_list(F.struct("size", "spare", "items")), asc=False).alias("classes"))
    taken = lists.select(F.col("key").alias("tkey"), F.explode(F.expr(_FILL)).alias("x"))
    taken = settle(taken.groupBy("tkey", F.col("x.size").alias("tsize"), F.col("x.items").alias("items")).agg(F.sum("x.t").alias("t")))
    hashed = F.xxhash64("id", F.lit("fill"))
    chance = (F.shiftrightunsigned(hashed, 12) + 1).cast("double") / float(1 << 52)
    some = open_items.join(taken, F.col("key").eqNullSafe(F.col("tkey")) & (F.col("size") == F.col("tsize")))
    some = some.where(chance * F.col("items") <= 4 * F.col("t") + 64)
    through = F.sum("spare").over(W.partitionBy("key", "size").orderBy(hashed, "id"))
    extra = F.least(F.col("spare"), F.col("t") - through + F.col("spare"))
    return some.select("key", "id", "size", "n", "copies", extra.alias("extra")).where("extra > 0")


def mix_sizes(rows: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """rows (a table of row_ids) with P + words, target, rate and copies; rows has P + id, source, size and rid."""
    if cap != int(cap) or cap < 1:
        raise ValueError("a cap is a whole number of copies")
    histogram = settle(
        rows.groupBy(F.col(f"{P}source").alias("source"), F.col(f"{P}size").alias("size")).agg(F.count("*").alias("n"))
    )
    per_source = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled")
    )
    solved = tilts(histogram.where("size > 0"), targets(per_source, weights, cap), cap)
    solved = settle(
        solved.select(*[F.col(c).alias(P + ("key" if c == "source" else c)) for c in ("source", "words", "target", "lam", "mean")])
    )
    size, uniform = F.col(f"{P}size"), F.xxhash64(f"{P}id", f"{P}size")
    uniform = (F.shiftrightunsigned(uniform, 12) + 1).cast("double") / float(1 << 52)

    def rated(x: DataFrame) -> DataFrame:
        rate = F.when(size > 0, _rate(size, F.col(f"{P}lam"), F.col(f"{P}mean"), cap)).otherwise(1.0)
        x = x.join(solved, x[f"{P}source"].eqNullSafe(solved[f"{P}key"])).withColumn(f"{P}rate", rate)
        part = F.col(f"{P}rate") - F.floor(f"{P}rate")
        return x.withColumn(f"{P}base", F.floor(f"{P}rate").cast("int")).withColumn(
            f"{P}p", F.when((part > 0) & (size > 0), uniform / part)
        )

    # one row for all rows of the same source, doc_id and size
    items = settle(rated(rows.groupBy(f"{P}source", f"{P}id", f"{P}size").agg(F.count("*").alias("n"))))
    order = F.struct(F.col(f"{P}p").alias("p"), F.col(f"{P}id").alias("id"), F.col(f"{P}size").alias("size"))
    same = lambda a, b: a[f"{P}key"].eqNullSafe(b["key"])
    mass = F.sum(F.col("n") * size)
    left = settle(
        items.groupBy(f"{P}key", f"{P}target")
        .agg(F.sum(F.col("n") * size * F.col(f"{P}base")).alias("sure"))
        .select(F.col(f"{P}key").alias("key"), (F.floor(f"{P}target") - F.col("sure")).alias("room"))
    )
    open_items = items.where(F.col(f"{P}p").isNotNull())
    coarse = F.floor(F.least(F.col(f"{P}p"), F.lit(8.0)) * COARSE)
    fine = F.floor((F.least(F.col(f"{P}p"), F.lit(8.0)) * COARSE - coarse) * FINE)

    def where_it_ends(x: DataFrame, step: Column, room: DataFrame) -> DataFrame:
        """(key, step, room): the first step of each source whose words do not fit, and the room left at its start."""
        sums = x.groupBy(F.col(f"{P}key").alias("k"), step.alias("step")).agg(mass.alias("m"))
        total = F.sum("m").over(W.partitionBy("k").orderBy("step"))
        over = sums.withColumn("through", total).join(room, F.col("k").eqNullSafe(F.col("key")))
        return settle(
            over.where("through > room")
            .groupBy("key")
            .agg(F.min_by(F.struct("step", (F.col("room") - F.col("through") + F.col("m")).alias("room")), "step").alias("e"))
            .select("key", "e.step", "e.room")
        )

    end1 = where_it_ends(open_items, coarse, left)
    inside1 = open_items.join(end1, same(open_items, end1) & (coarse == F.col("step"))).select(open_items["*"])
    end2 = where_it_ends(inside1, fine, end1.drop("step"))
    inside2 = inside1.join(end2, F.col(f"{P}key").eqNullSafe(F.col("key")) & (fine == F.col("step")))
    through = F.sum(F.col("n") * size).over(W.partitionBy("key").orderBy(order))
    edge = settle(
        inside2.withColumn("through", through)
        .where("through > room")
        .groupBy("key")
        .agg(
            F.min_by(
                F.struct(
                    order.alias("order"),
                    F.floor((F.col("room") - F.col("through") + F.col("n") * size) / size).alias("fit"),
                ),
                order,
            ).alias("e")
        )
        .select(F.col("key").alias(f"{P}ekey"), F.col("e.order").alias(f"{P}edge"), F.col("e.fit").alias(f"{P}fit"))
    )

    def with_edge(x: DataFrame) -> DataFrame:
        return x.join(edge, x[f"{P}key"].eqNullSafe(edge[f"{P}ekey"]), "left")

    before = F.col(f"{P}p").isNotNull() & (F.col(f"{P}edge").isNull() | (order < F.col(f"{P}edge")))
    at_edge = F.coalesce(order == F.col(f"{P}edge"), F.lit(False)) & F.col(f"{P}p").isNotNull()
    state = settle(
        with_edge(items).select(
            F.col(f"{P}key").alias("key"), F.col(f"{P}id").alias("id"), F.col(f"{P}size").alias("size"), "n",
            (F.col("n") * F.col(f"{P}base") + F.when(before, F.col("n")).when(at_edge, F.col(f"{P}fit")).otherwise(0)).alias("copies"),
            F.col(f"{P}target").alias("target"), at_edge.alias("edge"),
        )
    )
    # the items whose copies are not what their rate and place alone give: one at each edge, and those that fill
    own = state.where("edge").select("key", "id", "size", "n", "copies", F.lit(0).cast("long").alias("extra"))
    odd = settle(
        own.unionByName(fill(state, cap))
        .groupBy("key", "id", "size", "n", "copies")
        .agg(F.sum("extra").alias("extra"))
        .select(*[F.col(c).alias(f"{P}o{c}") for c in ("key", "id", "size", "n")], (F.col("copies") + F.col("extra")).alias(f"{P}all"))
    )
    pairs = [(f"{P}key", f"{P}okey"), (f"{P}id", f"{P}oid"), (f"{P}size", f"{P}osize")]
    final = with_edge(rated(rows)).join(odd, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs], "left")
    usual = F.col(f"{P}base") + F.when(before, F.lit(1)).otherwise(0)
    total, n = F.col(f"{P}all"), F.col(f"{P}on")
    done = final.where(n.isNull() | (n == 1)).withColumn(f"{P}copies", F.coalesce(total, usual).cast("int"))
    if odd.where(n > 1).isEmpty():
        return done
    # rows that are alike share their copies out evenly
    alike = rank_within(final.where(n > 1), [f"{P}key", f"{P}id", f"{P}size"], f"{P}rid", f"{P}rank")
    more = F.when(F.col(f"{P}rank") < total % n, F.lit(1)).otherwise(0)
    return done.unionByName(alike.withColumn(f"{P}copies", (F.floor(total / n) + more).cast("int")).drop(f"{P}rank"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of sources weighted 1, 2, 3 by turns takes of each document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    light = docs.select(
        F.col("doc_id"), word_count(F.col("text").cast("string")).alias(f"{P}size"),
        F.col("source").cast("string").alias(f"{P}source"), F.col("doc_id").alias(f"{P}id"),
    )
    out = mix_sizes(row_ids(light, f"{P}rid"), WEIGHTS, CAP)
    return out.select(
        "doc_id", F.col(f"{P}size").alias("size"), F.col(f"{P}words").alias("source_size"),
        F.col(f"{P}target").alias("target"), (F.col(f"{P}copies") * F.col(f"{P}size")).cast("long").alias("taken"),
        F.col(f"{P}copies").alias("copies"),
    )


QUERIES = {"op10_mix": op10_mix}
ORACLE_SQL: dict[str, str] = {}
