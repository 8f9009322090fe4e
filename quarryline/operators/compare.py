"""Two snapshots of a catalogue: what changed, what is new, what is gone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DEFAULTS, Settings

KEY = ("name", "sku", "url")


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of rows with the same key the last by order. max_by sums up before the shuffle, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in key]
    out = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in rows.columns])


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    out = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in rows.columns])


def price_change(new: Column, old: Column, settings: Settings = DEFAULTS) -> dict[str, Column]:
    """Amount, percent of the old price's size, direction and whether the change counts and is significant."""
    amount = F.coalesce(new - old, F.lit(0.0))
    percent = (
        F.when(new.isNull() | old.isNull(), 0.0).when(old != 0, (new - old) / F.abs(old) * 100)
        .when(new != 0, 100.0).otherwise(0.0)
    )
    return {
        "change_amount": amount,
        "change_percent": percent,
        "price_changed": F.abs(percent) >= settings.price_change,
        "significant": F.abs(percent) >= settings.significant_change,
        "direction": F.when(amount > 0, "increase").when(amount < 0, "decrease").otherwise("unchanged"),
    }


def map_changes(new: Column, old: Column) -> Column:
    """array of struct(key, old, new) of the keys whose values differ, in key order."""
    none = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(F.coalesce(new, none), F.coalesce(old, none), lambda k, a, b: F.struct(b.alias("old"), a.alias("new")))
    differ = F.filter(F.map_entries(both), lambda e: ~e["value"]["old"].eqNullSafe(e["value"]["new"]))
    return F.array_sort(F.transform(differ, lambda e: F.struct(e["key"].alias("key"), e["value"]["old"].alias("old"), e["value"]["new"].alias("new"))))


def one_a_key(rows: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """rows with null keys as empty text, of each key the last row by order (then price and status, so that it is always the same)."""
    filled = rows.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in key})
    return last_wins(filled, key, [*order, *[c for c in ("price", "status") if c in rows.columns and c not in order]])


def compare(current: DataFrame, previous: DataFrame, key: Sequence[str] = KEY, settings: Settings = DEFAULTS, order: Sequence[str] = ()) -> DataFrame:
    """One row a product of either snapshot, with a status: changed, unchanged, new or discontinued.

    Snapshots hold key, price, status, images and characteristics. Of rows that repeat a key the last by `order` counts
    (one_a_key); null parts of a key are empty text. One full outer join serves matches and both anti joins; it finds
    both sides dealt by the key already, so it shuffles nothing anew.
    """
    c, p = one_a_key(current, key, order), one_a_key(previous, key, order)
    same = [F.col(f"c.{k}") == F.col(f"p.{k}") for k in key]
    j = c.withColumn("_in", F.lit(True)).alias("c").join(p.withColumn("_in", F.lit(True)).alias("p"), same, "full_outer")
    new, old = F.col("c.price"), F.col("p.price")
    price = price_change(new, old, settings)
    here, was = F.coalesce("c.status", F.lit("unknown")), F.coalesce("p.status", F.lit("unknown"))
    n_new, n_old = F.coalesce(F.size("c.images"), F.lit(0)), F.coalesce(F.size("p.images"), F.lit(0))
    j = j.select(
        *[F.coalesce(f"c.{k}", f"p.{k}").alias(k) for k in key], F.col("c._in").alias("_c"), F.col("p._in").alias("_p"),
        old.alias("old_price"), new.alias("new_price"), *[x.alias(n) for n, x in price.items()],
        was.alias("old_status"), here.alias("new_status"), (n_new != n_old).alias("images_changed"),
        map_changes(F.col("c.characteristics"), F.col("p.characteristics")).alias("characteristic_changes"),
    )
    changed = F.col("price_changed") | (F.col("old_status") != F.col("new_status")) | F.col("images_changed") | (F.size("characteristic_changes") > 0)
    status = F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "discontinued").when(changed, "changed").otherwise("unchanged")
    return j.withColumn("status", status).drop("_c", "_p")


def only_in(left: DataFrame, right: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The rows of left whose key right lacks."""
    return left.join(right.select(*key), list(key), "left_anti")


def change_counters(compared: DataFrame) -> DataFrame:
    s, d = F.col("status"), F.col("direction")
    moved = (s == "changed") & F.col("price_changed")
    return compared.agg(
        F.count_if(moved & (d == "increase")).alias("increased"), F.count_if(moved & (d == "decrease")).alias("decreased"),
        F.count_if(s.isin("changed", "unchanged") & ~moved).alias("unchanged"), F.count_if(s == "changed").alias("changed"),
        F.count_if(s == "new").alias("new"), F.count_if(s == "discontinued").alias("discontinued"),
        F.count_if(moved & F.col("significant")).alias("significant"),
    )


def initial_counters(current: DataFrame) -> DataFrame:
    """The counters without a previous snapshot: all products are new, and none of their prices changed."""
    n = F.count("*")
    return current.agg(F.lit(0).cast("long").alias("increased"), F.lit(0).cast("long").alias("decreased"), n.alias("unchanged"), n.alias("new"))


def change_list(compared: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, field, old_value, new_value): a row for each change of a changed product, image counts left out."""
    text = lambda c: F.col(c).cast("string")
    entry = lambda f, old, new: F.struct(F.lit(f).alias("field"), old.alias("old_value"), new.alias("new_value"))
    fixed = F.array_compact(
        F.array(
            F.when(F.col("price_changed"), entry("price", text("old_price"), text("new_price"))),
            F.when(F.col("old_status") != F.col("new_status"), entry("availability", text("old_status"), text("new_status"))),
        )
    )
    more = F.transform("characteristic_changes", lambda x: F.struct(F.concat(F.lit("characteristic_"), x["key"]).alias("field"), x["old"].alias("old_value"), x["new"].alias("new_value")))
    rows = compared.where("status = 'changed'").select(*key, F.explode(F.concat(fixed, more)).alias("x"))
    return rows.select(*key, "x.*")


def keep_last_n(history: DataFrame, key: Sequence[str], order: Sequence[str | Column], n: int = DEFAULTS.history_kept) -> DataFrame:
    """The newest n rows of each key; the limit is pushed below the shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order]))
    return history.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")
