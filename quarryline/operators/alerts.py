"""Alerts out of comparison, trends and validation, their summary and delivery."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import printf
from ..schema import DEFAULTS, Settings

#: Messages and advice (fixed values).
PRICE, NEW, GONE = "Значительное изменение цены: %.1f%%", "Появился новый товар", "Товар больше не доступен"
VOLATILE, QUALITY, INVALID = "Высокая волатильность цен у %d товаров", "Низкое качество данных: %.2f", "Много невалидных данных: %d из %d"
ADVICE = ("Немедленно проверьте критические уведомления", "Проведите анализ ценовой политики", "Улучшите качество собираемых данных")


def _alert(df: DataFrame, group: str, kind: str, level: str, message, details: dict, product="name") -> DataFrame:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(group).alias("alert_group"), F.lit(kind).alias("type"), F.lit(level).alias("level"),
        (F.col(product) if product else F.lit(None).cast("string")).alias("product"), message.alias("message"), F.create_map(*pairs).alias("details"),
    )


def product_alerts(compared: DataFrame) -> DataFrame:
    """Price and availability alerts in one pass: a product has one status, so one alert at most."""
    s, text = F.col("status"), lambda c: F.col(c).cast("string")

    def one(group: str, kind: str, level: str, message, details: dict):
        pairs = [x for k, v in details.items() for x in (F.lit(k), v)]
        return F.struct(F.lit(group).alias("alert_group"), F.lit(kind).alias("type"), F.lit(level).alias("level"), F.col("name").alias("product"), message.alias("message"), F.create_map(*pairs).alias("details"))

    price = {c: text(c) for c in ("old_price", "new_price", "change_percent", "direction")}
    found = (
        F.when((s == "changed") & F.col("significant"), one("price", "PRICE_CHANGE", "CRITICAL", printf(PRICE, F.col("change_percent")), price))
        .when(s == "new", one("availability", "NEW_PRODUCT", "WARNING", F.lit(NEW), {"price": text("new_price")}))
        .when(s == "discontinued", one("availability", "DISCONTINUED_PRODUCT", "WARNING", F.lit(GONE), {"last_price": text("old_price")}))
    )
    return compared.select(found.alias("a")).where("a is not null").select("a.*")


def price_alerts(compared: DataFrame) -> DataFrame:
    return product_alerts(compared.where("status = 'changed'"))


def availability_alerts(compared: DataFrame) -> DataFrame:
    return product_alerts(compared.where("status in ('new', 'discontinued')"))


def trend_alerts(summary: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    rows = summary.where(F.col("high_volatility_count") > settings.volatile_products)
    details = {"affected_products": F.col("high_volatility_count"), "average_volatility": F.round("average_volatility", 6)}
    return _alert(rows, "trend", "HIGH_VOLATILITY", "WARNING", F.format_string(VOLATILE, "high_volatility_count"), details, "")


def quality_alerts(metrics: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    low = metrics.where((F.col("quality_score") < settings.low_quality) & (F.col("total_products") > 0))
    share = F.try_divide(F.col("invalid_products").cast("double"), F.col("total_products").cast("double"))
    many = metrics.where(share > settings.high_invalid)
    a = _alert(low, "quality", "DATA_QUALITY", "CRITICAL", printf(QUALITY, F.col("quality_score")), {"quality_score": F.col("quality_score")}, "")
    b = _alert(many, "quality", "HIGH_INVALID_DATA", "WARNING", F.format_string(INVALID, "invalid_products", "total_products"), {"invalid_count": F.col("invalid_products")}, "")
    return a.unionByName(b)


def all_alerts(compared: DataFrame, summary: DataFrame, metrics: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    parts = [product_alerts(compared), trend_alerts(summary, settings), quality_alerts(metrics, settings)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alert_summary(alerts: DataFrame) -> DataFrame:
    critical = F.count_if(F.col("level") == "CRITICAL")
    return alerts.agg(F.count("*").alias("total_alerts"), critical.alias("critical_alerts"), (F.count("*") - critical).alias("warning_alerts"))


def recommendations(alerts: DataFrame) -> DataFrame:
    g = F.col("alert_group")
    counts = alerts.agg(F.count_if(F.col("level") == "CRITICAL").alias("c"), F.count_if(g == "price").alias("p"), F.count_if(g == "quality").alias("q"))
    found = F.array_compact(F.array(F.when(F.col("c") > 0, ADVICE[0]), F.when(F.col("p") > 10, ADVICE[1]), F.when(F.col("q") > 0, ADVICE[2])))
    return counts.select(F.posexplode(found).alias("position", "advice"))


def send(alerts: DataFrame, method: str = "log") -> bool:
    """Deliver all alerts, critical ones first, to the log or the console; e-mail is not offered.

    They come to the driver one partition at a time, so it never holds them all.
    """
    if method not in ("log", "console"):
        return False
    say = logging.getLogger("quarryline.alerts").warning if method == "log" else print
    for r in alerts.orderBy("level", "type", "product").toLocalIterator():
        say(f"{r.level}: {r.message}")
    return True
