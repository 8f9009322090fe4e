"""Article numbers and product keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes by part of a category name and known brands, in order (fixed values).
PREFIXES = (("ноутбук", "NB"), ("телефон", "PH"), ("телевизор", "TV"), ("холодильник", "FR"), ("стиральная", "WM"), ("мебель", "FRN"))
BRANDS = ("samsung", "apple", "xiaomi", "lenovo", "lg", "sony", "huawei")


def category_prefix(category: Column, prefixes: Sequence[tuple[str, str]] = PREFIXES) -> Column:
    out, low = None, F.lower(category)
    for part, prefix in prefixes:
        hit = F.contains(low, F.lit(part))
        out = F.when(hit, prefix) if out is None else out.when(hit, prefix)
    return F.lit("GEN") if out is None else out.otherwise("GEN")


def brand(text: Column, brands: Sequence[str] = BRANDS) -> Column:
    """The first known brand that text holds, else UNK."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(b)), b) for b in brands], F.lit("UNK"))


def code3(text: Column) -> Column:
    return F.upper(F.substring(text, 1, 3))


def canonical_map(characteristics: Column) -> Column:
    """A map as k=v; in key order, so that equal maps give equal text."""
    pairs = F.array_sort(F.map_entries(characteristics))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit(";"))), "")


def hash_article(name: Column, category: Column, characteristics: Column) -> Column:
    text = F.concat(F.coalesce(name, F.lit("")), F.coalesce(category, F.lit("")), F.coalesce(canonical_map(characteristics), F.lit("")))
    return F.concat(category_prefix(F.coalesce(category, F.lit("GEN"))), F.lit("-"), F.upper(F.substring(F.md5(text), 1, 8)))


def composite_article(name: Column, category: Column, description: Column, price: Column) -> Column:
    """price: as text, so that its form is the caller's."""
    tail = F.upper(F.substring(F.md5(F.concat(F.coalesce(name, F.lit("")), F.coalesce(price, F.lit("0")))), 1, 4))
    seen = F.concat(F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")))
    return F.concat_ws("-", code3(F.coalesce(category, F.lit("GEN"))), code3(brand(seen)), tail)


def article(strategy: str, name: Column, category: Column, description: Column, characteristics: Column, price: Column) -> Column:
    """An article number by a strategy's name: hash, composite or, by any other name, the hash.

    Sequential numbers need all rows: operators/filters.sequential_article.
    """
    if strategy == "sequential":
        raise ValueError("sequential articles are made by filters.sequential_article")
    return composite_article(name, category, description, price) if strategy == "composite" else hash_article(name, category, characteristics)


def product_key(name: Column, sku: Column, url: Column) -> Column:
    """A printable key; joins use name, sku and url themselves."""
    digits = F.lpad((F.crc32(F.encode(F.coalesce(url, F.lit("")), "UTF-8")) % 10000).cast("string"), 4, "0")
    return F.concat_ws("_", F.coalesce(name, F.lit("")), F.coalesce(sku, F.lit("")), digits)
