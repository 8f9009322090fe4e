"""Price history: per-product trends, their summary, insights and a linear forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DEFAULTS, Settings


def product_trends(history: DataFrame, key: str = "product_key", tie: Sequence[str] = (), settings: Settings = DEFAULTS) -> DataFrame:
    """One row a product of history (key, date, price) with at least settings.min_points rows.

    Prices leave out null ones, the period does not. One shuffle by key: the window's partitioning serves the
    aggregation as well.
    """
    spec = W.partitionBy(key).orderBy("date", *tie)
    known = F.col("price").isNotNull()
    seen = history.withColumn("x", F.when(known, F.sum(known.cast("int")).over(spec) - 1))
    before = F.last(F.when(known, F.col("price")), ignorenulls=True).over(spec.rowsBetween(W.unboundedPreceding, -1))
    seen = seen.withColumn("ret", F.when(known & (before != 0), (F.col("price") - before) / before))
    place = F.when(known, F.col("x"))
    out = seen.groupBy(key).agg(
        F.count("*").alias("n_rows"), F.count("price").alias("n"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.min_by("price", place).alias("first_price"), F.max_by("price", place).alias("current_price"),
        F.avg("price").alias("mean_price"), F.median("price").alias("median_price"), F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("std_price"),
        F.regr_slope("price", "x").alias("slope"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("volatility"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    ).where(F.col("n_rows") >= settings.min_points)
    change = F.when(F.col("first_price") > 0, (F.col("current_price") - F.col("first_price")) / F.col("first_price") * 100).otherwise(0.0)
    return out.select(
        key, "n", trend_direction(F.col("slope"), F.col("n"), settings).alias("trend_direction"), "slope",
        F.when(F.col("n") >= 2, change).alias("change_percent"), (F.col("current_price") - F.col("first_price")).alias("change_amount"),
        "volatility", "min_price", "max_price", "current_price", "mean_price", "median_price", "std_price", "first_date", "last_date",
        F.datediff("last_date", "first_date").alias("period_days"),
    )


def trend_direction(slope: Column, n: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(n < 2, "insufficient_data").when((n < 3) | slope.isNull(), "uncertain")
        .when(slope > settings.flat_slope, "upward").when(slope < -settings.flat_slope, "downward").otherwise("stable")
    )


def relative_direction(slope: Column, mean: Column, share: float = 0.001) -> Column:
    """The direction by the slope's share of the mean price a step, which holds on any price scale (our extension)."""
    rel = F.try_divide(slope, mean)
    return F.when(rel.isNull(), "uncertain").when(rel > share, "upward").when(rel < -share, "downward").otherwise("stable")


def simple_trends(history: DataFrame, key: str = "product_key", tie: Sequence[str] = ()) -> DataFrame:
    """First against last price with a 2 % band, and the population deviation; products with at least two prices."""
    at = F.struct("date", *tie)
    known = history.where("price is not null")
    out = known.groupBy(key).agg(
        F.count("*").alias("n"), F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"),
        F.stddev_pop("price").alias("volatility"), F.datediff(F.max("date"), F.min("date")).alias("period_days"),
    ).where("n >= 2")
    change = F.when(F.col("first_price") != 0, (F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100).otherwise(0.0)
    out = out.withColumn("change_percent", change)
    trend = F.when(F.abs("change_percent") < 2, "stable").when(F.col("change_percent") > 0, "increasing").otherwise("decreasing")
    return out.withColumn("trend", trend)


def trend_histogram(trends: DataFrame, column: str = "trend", classes: Sequence[str] = ("increasing", "decreasing", "stable", "insufficient_data")) -> DataFrame:
    """How many products each class has, zeros included."""
    counts = [F.count_if(F.col(column) == c).alias(c) for c in classes]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("trend"), F.col(c).alias("n")) for c in classes]))
    return trends.agg(*counts).select(pairs.alias("p")).select("p.trend", "p.n")


def trends_summary(trends: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row over all products that have a direction."""
    d, c, v = F.col("trend_direction"), F.col("change_percent"), F.col("volatility")
    return trends.where(d != "insufficient_data").agg(
        F.count("*").alias("n_products"), *[F.count_if(d == x).alias(x) for x in ("upward", "downward", "stable", "uncertain")],
        F.avg(c).alias("average_change"), F.max(c).alias("max_increase"), F.min(c).alias("max_decrease"),
        F.count_if(c > 0).alias("positive_changes"), F.count_if(c < 0).alias("negative_changes"),
        F.avg(v).alias("average_volatility"), F.max(v).alias("max_volatility"), F.count_if(v > settings.high_volatility).alias("high_volatility_count"),
    )


#: Sentences of the insights (fixed values).
INSIGHTS = {
    "none": "Недостаточно данных для анализа", "up": "📈 Преобладает восходящий тренд цен", "down": "📉 Преобладает нисходящий тренд цен",
    "volatile": "⚡ Высокая волатильность цен на рынке", "rise": "💹 Большинство товаров демонстрируют рост цен",
    "fall": "🔻 Большинство товаров демонстрируют снижение цен",
}


def market_insights(summary: DataFrame) -> DataFrame:
    """A row for each insight that the summary gives, in order."""
    n = F.col("n_products")
    found = F.array_compact(
        F.array(
            F.when(n == 0, INSIGHTS["none"]),
            F.when(F.col("upward") > n * 0.6, INSIGHTS["up"]).when(F.col("downward") > n * 0.6, INSIGHTS["down"]),
            F.when(F.col("high_volatility_count") > n * 0.3, INSIGHTS["volatile"]),
            F.when(F.col("positive_changes") > F.col("negative_changes") * 1.5, INSIGHTS["rise"])
            .when(F.col("negative_changes") > F.col("positive_changes") * 1.5, INSIGHTS["fall"]),
        )
    )
    return summary.select(F.posexplode(found).alias("position", "insight"))


def forecast(trends: DataFrame, days: int = 7, key: str = "product_key") -> DataFrame:
    """The price in so many days if the change per day goes on; null where all prices are of one day."""
    moving = F.col("trend_direction").isin("upward", "downward")
    step = F.try_divide(F.col("change_percent"), F.col("period_days").cast("double")) * days
    out = trends.where(F.col("trend_direction") != "insufficient_data").withColumn("predicted_change_percent", F.when(moving, step).otherwise(0.0))
    return out.select(
        key, "trend_direction", "current_price", "predicted_change_percent",
        (F.col("current_price") * (1 + F.col("predicted_change_percent") / 100)).alias("predicted_price"),
        F.greatest(F.lit(0.1), 1 - F.col("volatility") * 10).alias("confidence"),
        F.date_add("last_date", days).alias("prediction_date"),
    )


def seasonality(trends: DataFrame, key: str = "product_key") -> DataFrame:
    """The place of a seasonality test, which finds none as yet."""
    return trends.select(key, F.lit(False).alias("detected"), F.lit(0.0).alias("confidence"), F.when(F.col("n") >= 7, "none").alias("pattern"))
