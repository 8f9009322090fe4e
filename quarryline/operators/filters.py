"""Filters on products as Column predicates, so that scans can push them down."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import settle


def price_between(price: Column, low: float | None = None, high: float | None = None) -> Column:
    """Both ends included; a null price passes."""
    out = F.lit(True)
    if low is not None:
        out = out & (price >= low)
    if high is not None:
        out = out & (price <= high)
    return price.isNull() | out


def category_any(category: Column, wanted: Sequence[str]) -> Column:
    """True if category holds any of the texts, case ignored; all pass if none is wanted."""
    if not wanted:
        return F.lit(True)
    low = F.lower(F.coalesce(category, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in wanted])


def parse_spec(spec: str) -> dict[str, str]:
    """`key:lo-hi,key:value` as a dict."""
    pairs = (p.split(":", 1) for p in spec.split(",") if ":" in p)
    return {k.strip(): v.strip() for k, v in pairs}


def characteristics_match(characteristics: Column, spec: str | dict[str, str]) -> Column:
    """All of a spec: lo-hi holds for the value's first number, any other text must equal the value, case ignored."""
    import re

    out = F.lit(True)
    for key, want in (parse_spec(spec) if isinstance(spec, str) else spec).items():
        value = characteristics[key]
        span = re.fullmatch(r"(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)", want)
        if span:
            number = F.nullif(F.regexp_extract(value, "(\\d+\\.?\\d*)", 1), F.lit("")).try_cast("double")
            one = number.between(float(span[1]), float(span[2]))
        else:
            one = F.lower(value) == want.lower()
        out = out & F.coalesce(one, F.lit(False))
    return out


def first_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


#: Signs of a page that was refused (fixed values).
BLOCKED = ("captcha", "access denied", "blocked", "cloudflare", "robot check", "доступ запрещен")


def is_blocked_page(html: Column) -> Column:
    return F.lower(html).rlike("|".join(BLOCKED))


def sequential_article(rows: DataFrame, order: str, keys: Sequence[str] = ("name", "category")) -> DataFrame:
    """(keys, article): ART-000001 and on, by first appearance of each (name, category).

    The distinct keys are numbered by partition offsets after a range sort, so no task sees them all.
    """
    firsts = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    numbered = settle(firsts.orderBy("_first", *keys).withColumn("_id", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = counts.select("_part", before.alias("_before"))
    number = F.col("_before") + F.col("_id") - F.shiftleft(F.col("_part"), 33) + 1
    return numbered.join(offsets, "_part").select(*keys, F.concat(F.lit("ART-"), F.lpad(number.cast("string"), 6, "0")).alias("article"))
