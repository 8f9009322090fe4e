"""Column functions that read numbers, units and states out of strings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Factors by unit (fixed values).
WEIGHT_G = {"g": 1.0, "г": 1.0, "гр": 1.0, "gram": 1.0, "gramm": 1.0, "kg": 1000.0, "кг": 1000.0, "kilogram": 1000.0, "килограмм": 1000.0,
            "lb": 453.592, "фунт": 453.592, "pound": 453.592, "oz": 28.3495, "унция": 28.3495, "ounce": 28.3495}
LENGTH_MM = {"mm": 1.0, "мм": 1.0, "millimeter": 1.0, "миллиметр": 1.0, "cm": 10.0, "см": 10.0, "centimeter": 10.0, "сантиметр": 10.0,
             "m": 1000.0, "м": 1000.0, "meter": 1000.0, "метр": 1000.0, "in": 25.4, "дюйм": 25.4, "inch": 25.4, "ft": 304.8, "фут": 304.8, "foot": 304.8}
VOLUME_L = {"l": 1.0, "л": 1.0, "литр": 1.0, "liter": 1.0, "litre": 1.0, "ml": 0.001, "мл": 0.001, "миллилитр": 0.001, "milliliter": 0.001,
            "gal": 3.78541, "галлон": 3.78541, "gallon": 3.78541, "m3": 1000.0, "м3": 1000.0, "m³": 1000.0, "м³": 1000.0, "кубометр": 1000.0}
COLORS = {"черный": "black", "белый": "white", "красный": "red", "синий": "blue", "зеленый": "green", "желтый": "yellow", "оранжевый": "orange",
          "фиолетовый": "purple", "розовый": "pink", "серый": "gray", "коричневый": "brown", "голубой": "lightblue", "серебристый": "silver", "золотой": "gold"}
OUT_OF_STOCK = ("нет в наличии", "распродано", "out of stock", "sold out", "unavailable")
IN_STOCK = ("в наличии", "есть", "available", "in stock", "на складе")
KEYS = {"вес": "weight", "масса": "weight", "weight": "weight", "mass": "weight", "размер": "dimensions", "габариты": "dimensions",
        "dimensions": "dimensions", "размеры": "dimensions", "длина": "length", "length": "length", "ширина": "width", "width": "width",
        "высота": "height", "height": "height", "объем": "volume", "ёмкость": "volume", "volume": "volume", "capacity": "volume",
        "цвет": "color", "colour": "color", "color": "color", "материал": "material", "material": "material", "производитель": "manufacturer",
        "бренд": "manufacturer", "manufacturer": "manufacturer", "brand": "manufacturer", "страна": "country", "country": "country",
        "страна происхождения": "country", "артикул": "sku", "код товара": "sku", "sku": "sku", "article": "sku", "модель": "model", "model": "model"}

NUMBER = "(\\d+[.,]?\\d*)"
UNIT = "([a-zA-Zа-яА-Я]*)"


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """table[key], null where it has none."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def price(text: Column) -> Column:
    """The first number of what is left of text without all but digits, commas (as points) and points."""
    clean = F.replace(F.regexp_replace(text, "[^\\d,.]", ""), F.lit(","), F.lit("."))
    return F.nullif(F.regexp_extract(clean, "(\\d+\\.?\\d*)", 1), F.lit("")).try_cast("double")


def price_locale(text: Column) -> Column:
    """A price with thousands separators of either kind: the last mark with one or two digits after it is decimal."""
    clean = F.regexp_replace(text, "[^\\d,.]", "")
    whole = F.regexp_replace(F.regexp_replace(clean, "[.,](\\d{1,2})$", ""), "[.,]", "")
    cents = F.regexp_extract(clean, "[.,](\\d{1,2})$", 1)
    return F.concat(whole, F.when(cents != "", F.concat(F.lit("."), cents)).otherwise("")).try_cast("double")


def _measure(text: Column, table: Mapping[str, float], digits: int, unit: str = UNIT) -> Column:
    pattern = NUMBER + "\\s*" + unit
    factor = F.coalesce(lookup(F.lower(F.regexp_extract(text, pattern, 2)), table), F.lit(1.0))
    return F.round(_number(F.regexp_extract(text, pattern, 1)) * factor, digits)


def weight_g(text: Column) -> Column:
    return _measure(text, WEIGHT_G, 2)


def volume_l(text: Column) -> Column:
    return _measure(text, VOLUME_L, 3, "([a-zA-Zа-яА-Я]*[3³]?)")


def length_mm(text: Column) -> Column:
    return _measure(text, LENGTH_MM, 2)


def dimensions_mm(text: Column) -> Column:
    """struct(length_mm, width_mm, height_mm): one to three numbers with one unit after the last."""
    by = "\\s*[x×*]\\s*"
    three, two = by.join([NUMBER] * 3) + "\\s*" + UNIT, by.join([NUMBER] * 2) + "\\s*" + UNIT
    part = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    has3, has2 = part(three, 1).isNotNull(), part(two, 1).isNotNull()
    unit = F.when(has3, part(three, 4)).when(has2, part(two, 3)).otherwise(part(NUMBER + "\\s*" + UNIT, 2))
    factor = F.coalesce(lookup(F.lower(unit), LENGTH_MM), F.lit(1.0))
    side = lambda i: F.when(has3, part(three, i)).when(has2, part(two, i) if i < 3 else F.lit(None)).otherwise(part(NUMBER, 1) if i == 1 else F.lit(None))
    names = ("length_mm", "width_mm", "height_mm")
    return F.struct(*[F.round(_number(side(i)) * factor, 2).alias(n) for i, n in enumerate(names, 1)])


def color(text: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(text)), COLORS), F.trim(text))


def _has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(phrases))


def availability_status(text: Column) -> Column:
    """in_stock, out_of_stock or unknown; out of stock is tested first, as it may hold the words of the other."""
    return F.when(_has_any(text, OUT_OF_STOCK), "out_of_stock").when(_has_any(text, IN_STOCK), "in_stock").otherwise("unknown")


def availability(text: Column) -> Column:
    """struct(status, text, quantity)."""
    quantity = F.nullif(F.regexp_extract(F.lower(text), "(\\d+)\\s*(?:шт|штук|pieces?)", 1), F.lit("")).try_cast("int")
    status = F.coalesce(availability_status(text), F.lit("unknown"))
    return F.struct(status.alias("status"), F.lower(text).alias("text"), quantity.alias("quantity"))


def rating(text: Column) -> Column:
    """The first number, a comma being a point, else the number of stars; null without either."""
    number = _number(F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit("")))
    stars = F.nullif(F.regexp_count(text, F.lit("★")), F.lit(0)).cast("double")
    return F.coalesce(number, stars)


def sku(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[^\\p{L}\\p{N}_-]", ""), F.lit(""))


def key(name: Column) -> Column:
    """A characteristic's canonical name."""
    low = F.lower(F.trim(name))
    return F.coalesce(lookup(low, KEYS), low)


def value(canonical: Column, text: Column) -> Column:
    """A characteristic's value as text in canonical units; null where a measure cannot be read."""
    from .text import collapse, title_if_shouting

    dims = dimensions_mm(text)
    size = F.nullif(F.concat_ws("x", *[dims[n].cast("string") for n in ("length_mm", "width_mm", "height_mm")]), F.lit(""))
    return (
        F.when(canonical == "weight", weight_g(text).cast("string"))
        .when(canonical.isin("length", "width", "height", "dimensions"), size)
        .when(canonical == "volume", volume_l(text).cast("string"))
        .when(canonical == "color", color(text))
        .when(canonical.isin("price", "cost"), price(text).cast("string"))
        .when(canonical == "availability", availability_status(text))
        .otherwise(title_if_shouting(collapse(text)))
    )


def normalize_map(characteristics: Column) -> Column:
    """A map with canonical keys and values; of keys that fall together the last wins (mapKeyDedupPolicy LAST_WIN)."""
    entries = F.transform(F.map_entries(characteristics), lambda e: F.struct(key(e["key"]).alias("k"), value(key(e["key"]), e["value"]).alias("v")))
    kept = F.filter(entries, lambda e: e["v"].isNotNull())
    # the last of equal keys, without relying on the session's policy
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def unit_table(spark: SparkSession) -> DataFrame:
    """(kind, unit, factor): the conversions as a small reference table."""
    rows = [(kind, u, f) for kind, t in (("weight", WEIGHT_G), ("length", LENGTH_MM), ("volume", VOLUME_L)) for u, f in t.items()]
    return spark.createDataFrame(rows, "kind string, unit string, factor double")
