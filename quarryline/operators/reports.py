"""Report tables: wide product sheets, comparison, trend, validation and alert sheets, a summary, column widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels


def characteristic_keys(products: DataFrame) -> DataFrame:
    return products.select(F.explode(F.map_keys("characteristics")).alias("key")).distinct().orderBy("key")


def wide_products(products: DataFrame, keys: list[str] | None = None, most: int = 2000) -> DataFrame:
    """Fixed columns and one for each characteristic, by name. The keys are the columns of the result, so they are read
    first; more than `most` of them is an error, not a cut. A map lookup needs no pivot and no shuffle."""
    if keys is None:
        keys = [r[0] for r in characteristic_keys(products).limit(most + 1).collect()]
        if len(keys) > most:
            raise ValueError(f"more than {most} characteristics: give the keys that are wanted")
    fixed = [c for c in ("category", "article", "image_files", "description", "price") if c in products.columns]
    return products.select(*fixed, *[F.coalesce(F.col("characteristics")[k], F.lit("")).alias(k) for k in keys])


def formatted_products(products: DataFrame) -> DataFrame:
    """The products sheet with texts in their printed form."""
    c = F.col
    price = labels.price(c("price").cast("string"))
    return products.select(
        labels.name(c("name")).alias("name"), price["value"].alias("price"), price["problem"].alias("price_problem"),
        labels.description(c("description")).alias("description"), F.coalesce("category", F.lit("")).alias("category"), c("url"),
        F.coalesce("sku", F.lit("")).alias("sku"), labels.availability(c("status")).alias("availability"),
    )


def comparison_sheet(compared: DataFrame) -> DataFrame:
    c = F.col
    changed = compared.where("status = 'changed' and price_changed").select(
        "name", "sku", "old_price", "new_price", labels.percent(c("change_percent")).alias("change"), "change_amount",
        labels.direction(c("change_amount")).alias("kind"), F.when(c("significant"), "Да").otherwise("Нет").alias("significant"),
    )
    new = compared.where("status = 'new'").select(
        "name", "sku", F.lit(None).cast("double").alias("old_price"), "new_price", F.lit("Новый товар").alias("change"),
        F.lit(None).cast("double").alias("change_amount"), F.lit("Новый товар").alias("kind"), F.lit("Н/Д").alias("significant"),
    )
    return changed.unionByName(new)


def trend_sheet(trends: DataFrame, key: str = "product_key") -> DataFrame:
    return trends.select(key, labels.trend(F.col("trend_direction")).alias("trend"), "change_percent", "current_price", "min_price", "max_price", "volatility", "n", "period_days")


def validation_sheet(validated: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["message"]), "; ")
    status = F.when(F.col("is_valid"), "✅ Валиден").otherwise("❌ Невалиден")
    errors = F.when(F.col("is_valid"), "Нет").otherwise(joined("errors"))
    return validated.select("name", "sku", status.alias("status"), errors.alias("errors"), joined("warnings").alias("warnings"), "price", "url")


#: Labels of the alert sheet (fixed values).
GROUPS = {"price": "💰 Цены", "availability": "📦 Наличие", "trend": "📈 Тренды", "quality": "🔍 Качество данных"}


def alert_sheet(alerts: DataFrame) -> DataFrame:
    from ..functions.measures import lookup

    group = F.coalesce(lookup(F.col("alert_group"), GROUPS), F.col("alert_group"))
    return alerts.select(group.alias("kind"), "level", F.coalesce("product", F.lit("Общий")).alias("product"), "message", F.to_json("details").alias("details"))


def unpivot_row(row: DataFrame, columns: list[str]) -> DataFrame:
    """A one-row table as (metric, value)."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def price_stats(products: DataFrame) -> DataFrame:
    p = F.when(F.col("price") != 0, F.col("price"))
    return products.agg(F.count("*").alias("n"), F.avg(p).alias("average_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"))


def column_widths(sheet: DataFrame, most: int = 50) -> DataFrame:
    """(column, width): the longest text of each column and two more, at most 50."""
    longest = sheet.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(c) for c in sheet.columns])
    wide: list[Column] = [F.struct(F.lit(c).alias("column"), F.least(F.greatest(F.coalesce(F.col(f"`{c}`"), F.lit(0)), F.lit(len(c))) + 2, F.lit(most)).alias("width")) for c in sheet.columns]
    return longest.select(F.explode(F.array(*wide)).alias("x")).select("x.*")


def work_stats(products: DataFrame) -> DataFrame:
    """What there is to number and to fetch: products, those with and without an article, with images, and the images."""
    a, n = F.nullif(F.col("article"), F.lit("")), F.coalesce(F.size("images"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return products.agg(
        F.count("*").alias("total"), F.count(a).alias("with_article"), (F.count("*") - F.count(a)).alias("without_article"),
        F.count_if(n > 0).alias("with_images"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("images"),
    )


def error_stats(errors: DataFrame) -> DataFrame:
    """(error_type, n, recovered, recovery_rate) of an error log (error_type, can_recover)."""
    ok = F.count_if("can_recover")
    return errors.groupBy("error_type").agg(F.count("*").alias("n"), ok.alias("recovered"), (ok / F.count("*")).alias("recovery_rate"))


def rewrite_stats(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("successful"), F.sum("changes").alias("changes"))
