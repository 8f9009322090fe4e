"""The driver's tables read as a product catalogue: snapshots, price history, pictures; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

#: Snapshots by name: the first and the last moment (not included) of their shipments.
SPANS = {"current": ("2001-01-01", "2100-01-01"), "previous": ("2000-01-01", "2001-01-01")}


def unit_cents() -> Column:
    """A line's price of one piece in whole cents, so that sums are exact whatever their order."""
    return F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("bigint")


def snapshot(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Products as shipped in a span: key columns, price, status, images, characteristics."""
    low, high = SPANS[which]
    when = F.col("l_shipdate")
    lines = read_table(spark, sf_dir, "lineitem").where((when >= F.lit(low).cast("timestamp")) & (when < F.lit(high).cast("timestamp")))
    per = lines.groupBy("l_partkey").agg((F.round(F.avg(unit_cents())) / 100).alias("price"), F.sum("l_quantity").alias("quantity"))
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    now = which == "current"
    size = F.col("p_size") + F.when(k % 7 == 0, 1).otherwise(0) if now else F.col("p_size")
    traits = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.concat(size.cast("string"), F.lit(" cm")))
    if now:
        traits = F.when(k % 11 == 0, F.map_concat(traits, F.create_map(F.lit("color"), F.lit("red")))).otherwise(traits)
    n_images = (k % (6 if now else 5)).cast("int")
    images = F.transform(F.slice(F.sequence(F.lit(1), F.lit(6)), F.lit(1), n_images), lambda i: F.concat(F.lit("https://img.example/"), k.cast("string"), F.lit("_"), i.cast("string"), F.lit(".jpg")))
    return per.join(parts, F.col("l_partkey") == k).select(
        k, F.col("p_name").alias("name"), F.concat(F.lit("P"), k.cast("string")).alias("sku"),
        F.concat(F.lit("https://shop.example/item/"), k.cast("string")).alias("url"), F.col("p_type").alias("category"), "price",
        F.when(F.col("quantity") >= 100, "in_stock").otherwise("out_of_stock").alias("status"), images.alias("images"), traits.alias("characteristics"),
    )


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_key, date, price): the mean price of a piece a day."""
    lines = read_table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("product_key"), F.to_date("l_shipdate").alias("date")).agg((F.avg(unit_cents()) / 100).alias("price"))


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article, idx, size, width, height, cleaned): four pictures of each part, by arithmetic on its key."""
    k, i = F.col("p_partkey"), F.col("idx")
    parts = read_table(spark, sf_dir, "part").select(k, F.explode(F.sequence(F.lit(1), F.lit(4))).alias("idx"))
    return parts.select(
        F.concat(F.lit("A"), k.cast("string")).alias("article"), "idx", (20000 + (k * 7919 + i * 15013) % 120000).alias("size"),
        (200 + (k * 31 + i * 433) % 1400).alias("width"), (200 + (k * 17 + i * 577) % 1400).alias("height"), ((k + i) % 5 != 0).alias("cleaned"),
    )


CENTS = "CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT)"


def snapshot_sql(which: str, name: str) -> str:
    low, high = SPANS[which]
    now = which == "current"
    size = "p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END" if now else "p_size"
    color = "CASE WHEN p_partkey % 11 = 0 THEN 'red' END" if now else "CAST(NULL AS VARCHAR)"
    return f"""{name} AS (SELECT p_partkey, p_name AS name, 'P' || CAST(p_partkey AS VARCHAR) AS sku,
  'https://shop.example/item/' || CAST(p_partkey AS VARCHAR) AS url, p_type AS category, price,
  CASE WHEN quantity >= 100 THEN 'in_stock' ELSE 'out_of_stock' END AS status, p_partkey % {6 if now else 5} AS n_images,
  p_brand AS c_brand, p_type AS c_type, CAST({size} AS VARCHAR) || ' cm' AS c_size, {color} AS c_color
  FROM (SELECT l_partkey, round(avg({CENTS})) / 100 AS price, sum(l_quantity) AS quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '{low}' AND l_shipdate < TIMESTAMP '{high}' GROUP BY l_partkey) q JOIN part ON l_partkey = p_partkey)"""


HISTORY_SQL = f"""h AS (SELECT l_partkey AS product_key, CAST(l_shipdate AS DATE) AS date, avg({CENTS}) / 100 AS price FROM lineitem GROUP BY 1, 2)"""

TRENDS_SQL = f"""{HISTORY_SQL},
w AS (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY date) - 1 AS x, lag(price) OVER (PARTITION BY product_key ORDER BY date) AS prev FROM h),
t0 AS (SELECT product_key, count(*) AS n, min(price) AS min_price, max(price) AS max_price, arg_min(price, date) AS first_price, arg_max(price, date) AS current_price,
  avg(price) AS mean_price, median(price) AS median_price, coalesce(stddev_samp(price), 0) AS std_price, regr_slope(price, x) AS slope,
  coalesce(stddev_samp(CASE WHEN prev <> 0 THEN (price - prev) / prev END), 0) AS volatility, min(date) AS first_date, max(date) AS last_date
  FROM w GROUP BY product_key HAVING count(*) >= 5),
t AS (SELECT *, CASE WHEN slope > 0.01 THEN 'upward' WHEN slope < -0.01 THEN 'downward' ELSE 'stable' END AS trend_direction,
  CASE WHEN first_price > 0 THEN (current_price - first_price) / first_price * 100 ELSE 0 END AS change_percent, current_price - first_price AS change_amount,
  date_diff('day', first_date, last_date) AS period_days FROM t0)"""

COMPARE_SQL = f"""{snapshot_sql("current", "c")}, {snapshot_sql("previous", "p")},
j AS (SELECT coalesce(c.name, p.name) AS name, coalesce(c.sku, p.sku) AS sku, coalesce(c.url, p.url) AS url, p.price AS old_price, c.price AS new_price,
  coalesce(c.price - p.price, 0) AS change_amount,
  CASE WHEN c.price IS NULL OR p.price IS NULL THEN 0 WHEN p.price <> 0 THEN (c.price - p.price) / abs(p.price) * 100 WHEN c.price <> 0 THEN 100 ELSE 0 END AS change_percent,
  coalesce(p.status, 'unknown') AS old_status, coalesce(c.status, 'unknown') AS new_status, coalesce(c.n_images, 0) <> coalesce(p.n_images, 0) AS images_changed,
  c.sku IS NULL AS gone, p.sku IS NULL AS fresh, c.c_brand, c.c_type, c.c_size, c.c_color, p.c_brand AS o_brand, p.c_type AS o_type, p.c_size AS o_size
  FROM c FULL OUTER JOIN p ON c.sku = p.sku),
k AS (SELECT *, abs(change_percent) >= 5 AS price_changed, abs(change_percent) >= 15 AS significant,
  CASE WHEN change_amount > 0 THEN 'increase' WHEN change_amount < 0 THEN 'decrease' ELSE 'unchanged' END AS direction,
  CASE WHEN fresh THEN 'new' WHEN gone THEN 'discontinued' WHEN abs(change_percent) >= 5 OR old_status <> new_status OR images_changed
    OR c_size <> o_size OR c_color IS NOT NULL THEN 'changed' ELSE 'unchanged' END AS status FROM j)"""

IMAGES_SQL = """i0 AS (SELECT 'A' || CAST(p_partkey AS VARCHAR) AS article, i AS idx, 20000 + (p_partkey * 7919 + i * 15013) % 120000 AS size,
  200 + (p_partkey * 31 + i * 433) % 1400 AS width, 200 + (p_partkey * 17 + i * 577) % 1400 AS height, (p_partkey + i) % 5 <> 0 AS cleaned
  FROM part, range(1, 5) AS r(i)),
i AS (SELECT *, round(CAST(least(1.0, greatest(0.0, 1.0 - CASE WHEN size < 50000 THEN 0.3 ELSE 0 END - CASE WHEN width < 400 OR height < 400 THEN 0.2 ELSE 0 END
  + CASE WHEN width >= 1200 AND height >= 1200 THEN 0.1 ELSE 0 END - CASE WHEN NOT cleaned THEN 0.1 ELSE 0 END)) AS DOUBLE), 6) AS score FROM i0)"""
