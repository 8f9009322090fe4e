"""The canonical product record and the settings of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

AVAILABILITY = T.StructType([T.StructField("status", T.StringType()), T.StructField("text", T.StringType()), T.StructField("quantity", T.IntegerType())])

PRODUCT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "name")]
    + [T.StructField("price", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("currency_text", "description", "category", "sku", "article")]
    + [
        T.StructField("rating", T.DoubleType()),
        T.StructField("availability", AVAILABILITY),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("characteristics", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("site", T.StringType()),
        T.StructField("snapshot_ts", T.TimestampType()),
    ]
)


@dataclass(frozen=True)
class Settings:
    """Thresholds of comparison, trends, validation, alerts, images and history."""

    price_change: float = 5.0
    significant_change: float = 15.0
    min_points: int = 5
    flat_slope: float = 0.01
    high_volatility: float = 0.1
    name_min: int = 3
    name_max: int = 500
    price_max: float = 10_000_000.0
    url_max: int = 2000
    images_max: int = 20
    key_max: int = 100
    value_max: int = 500
    image_formats: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp", ".gif")
    required: tuple[str, ...] = ("name", "price", "url")
    volatile_products: int = 5
    low_quality: float = 0.7
    high_invalid: float = 0.3
    history_kept: int = 100
    image_approved: float = 0.7
    image_min_bytes: int = 50_000
    image_min_side: int = 400
    image_large_side: int = 1200
    categories_per_site: int = 10
    pages_per_category: int = 10
    products_per_category: int = 50
    sitemap_locations: int = 50
    images_kept: int = 5
    overlap: float = 0.3
    synonym_rate: float = 0.7
    reorder_rate: float = 0.5
    messages: dict[str, str] = field(default_factory=dict)


DEFAULTS = Settings()
