"""What reports print."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .measures import lookup
from .text import printf, truncate

#: Texts of the reports (fixed values).
AVAILABILITY = {"in_stock": "В наличии", "out_of_stock": "Нет в наличии", "preorder": "Предзаказ", "available": "В наличии", "unavailable": "Нет в наличии"}
TRENDS = {"upward": "📈 Восходящий", "downward": "📉 Нисходящий", "stable": "➡️ Стабильный", "uncertain": "❓ Неопределенный"}
NO_NAME, NO_PRICE, BAD_PRICE, UNKNOWN, NO_KEY = "Без названия", "Нет данных", "Неверный формат", "Неизвестно", "Характеристика"


def name(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(text.isNull() | (text == ""), NO_NAME).otherwise(truncate(clean, 200))


def description(text: Column) -> Column:
    return truncate(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")), 500)


def price(text: Column) -> Column:
    """struct(value double, problem string) of a price as text: a number in it, or what is wrong."""
    number = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), "[^\\d.]", "").try_cast("double")
    return F.struct(number.alias("value"), F.when(text.isNull(), NO_PRICE).when(number.isNull(), BAD_PRICE).alias("problem"))


def availability(status: Column) -> Column:
    return F.when(status.isNull(), UNKNOWN).otherwise(F.coalesce(lookup(F.lower(status), AVAILABILITY), status))


def characteristic(key: Column) -> Column:
    clean = F.trim(key)
    shown = F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 20))
    return F.when(key.isNull() | (key == ""), NO_KEY).otherwise(F.replace(shown, F.lit("_"), F.lit(" ")))


def trend(direction: Column) -> Column:
    return F.coalesce(lookup(direction, TRENDS), direction)


def direction(change: Column) -> Column:
    """Up, down or no change, each by its own label."""
    return F.when(change > 0, "Увеличение").when(change < 0, "Снижение").otherwise("Без изменений")


def percent(change: Column) -> Column:
    return printf("%.2f%%", change)


def file_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, '[<>:"/\\\\|?*]', "_"), "_+", "_"), 1, 100)


def image_files(main: Column, gallery: Column) -> Column:
    return F.array_join(F.concat(F.when(main.isNull(), F.array().cast("array<string>")).otherwise(F.array(main)), gallery), "; ")
