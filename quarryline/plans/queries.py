"""Queries on the catalogue and their SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, labels, measures, urls
from ..functions import text as X
from ..operators import alerts, compare, extract, filters, images, pixels, reports, rewrite, trends, validate
from .catalogue import COMPARE_SQL, HISTORY_SQL, IMAGES_SQL, TRENDS_SQL, image_rows, price_history, snapshot, snapshot_sql
from .tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return take


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + 0.0 for c in columns})


def r6(columns: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in columns.split())


def big(columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns.split())


# trends


def _trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.product_trends(price_history(spark, sf_dir))


@query(f"""WITH {TRENDS_SQL} SELECT product_key, {big("n period_days")}, trend_direction,
 {r6("change_percent change_amount volatility min_price max_price current_price mean_price median_price std_price")}, round(slope, 4) + 0.0 AS slope FROM t""")
def trend_per_part(spark, sf_dir):
    out = longs(_trends(spark, sf_dir), "n", "period_days").drop("first_date", "last_date")
    out = rounded(out, 6, "change_percent", "change_amount", "volatility", "min_price", "max_price", "current_price", "mean_price", "median_price", "std_price")
    return rounded(out, 4, "slope")


@query(f"""WITH {TRENDS_SQL} SELECT product_key, CASE WHEN slope / mean_price > 0.001 THEN 'upward' WHEN slope / mean_price < -0.001 THEN 'downward' ELSE 'stable' END AS trend_direction FROM t""")
def trend_relative(spark, sf_dir):
    t = _trends(spark, sf_dir)
    return t.select("product_key", trends.relative_direction(F.col("slope"), F.col("mean_price")).alias("trend_direction"))


SUMMARY_SQL = f"""{TRENDS_SQL}, s AS (SELECT count(*) AS n_products, count(*) FILTER (trend_direction = 'upward') AS upward, count(*) FILTER (trend_direction = 'downward') AS downward,
 count(*) FILTER (trend_direction = 'stable') AS stable, count(*) FILTER (trend_direction = 'uncertain') AS uncertain, avg(change_percent) AS average_change,
 max(change_percent) AS max_increase, min(change_percent) AS max_decrease, count(*) FILTER (change_percent > 0) AS positive_changes,
 count(*) FILTER (change_percent < 0) AS negative_changes, avg(volatility) AS average_volatility, max(volatility) AS max_volatility,
 count(*) FILTER (volatility > 0.1) AS high_volatility_count FROM t)"""
SUMMARY_LONGS = "n_products upward downward stable uncertain positive_changes negative_changes high_volatility_count"
SUMMARY_DOUBLES = "average_change max_increase max_decrease average_volatility max_volatility"


@query(f"WITH {SUMMARY_SQL} SELECT {big(SUMMARY_LONGS)}, {r6(SUMMARY_DOUBLES)} FROM s")
def trend_summary(spark, sf_dir):
    return rounded(trends.trends_summary(_trends(spark, sf_dir)), 6, *SUMMARY_DOUBLES.split())


@query(f"""WITH {SUMMARY_SQL}, i AS (SELECT 0 AS o, CASE WHEN n_products = 0 THEN '{trends.INSIGHTS["none"]}' END AS insight FROM s
 UNION ALL SELECT 1, CASE WHEN upward > n_products * 0.6 THEN '{trends.INSIGHTS["up"]}' WHEN downward > n_products * 0.6 THEN '{trends.INSIGHTS["down"]}' END FROM s
 UNION ALL SELECT 2, CASE WHEN high_volatility_count > n_products * 0.3 THEN '{trends.INSIGHTS["volatile"]}' END FROM s
 UNION ALL SELECT 3, CASE WHEN positive_changes > negative_changes * 1.5 THEN '{trends.INSIGHTS["rise"]}' WHEN negative_changes > positive_changes * 1.5 THEN '{trends.INSIGHTS["fall"]}' END FROM s)
 SELECT row_number() OVER (ORDER BY o) - 1 AS position, insight FROM i WHERE insight IS NOT NULL""")
def market_insights(spark, sf_dir):
    return longs(trends.market_insights(trends.trends_summary(_trends(spark, sf_dir))), "position")


@query(f"""WITH {TRENDS_SQL}, f AS (SELECT *, CASE WHEN trend_direction = 'stable' THEN 0.0 WHEN period_days <> 0 THEN change_percent / period_days * 7 END AS predicted_change_percent FROM t)
 SELECT product_key, trend_direction, {r6("current_price predicted_change_percent")}, round(current_price * (1 + predicted_change_percent / 100), 6) + 0.0 AS predicted_price,
 round(greatest(0.1, 1 - volatility * 10), 6) + 0.0 AS confidence, CAST(last_date + 7 AS DATE) AS prediction_date FROM f""")
def forecast_7d(spark, sf_dir):
    return rounded(trends.forecast(_trends(spark, sf_dir)), 6, "current_price", "predicted_change_percent", "predicted_price", "confidence")


@query(f"""WITH {TRENDS_SQL} SELECT product_key, false AS detected, CAST(0 AS DOUBLE) AS confidence, CASE WHEN n >= 7 THEN 'none' END AS pattern FROM t""")
def seasonality(spark, sf_dir):
    return trends.seasonality(_trends(spark, sf_dir))


SIMPLE_SQL = f"""{HISTORY_SQL}, g AS (SELECT product_key, count(*) AS n, arg_min(price, date) AS first_price, arg_max(price, date) AS last_price, stddev_pop(price) AS volatility,
 date_diff('day', min(date), max(date)) AS period_days FROM h GROUP BY product_key HAVING count(*) >= 2),
m AS (SELECT *, CASE WHEN first_price <> 0 THEN (last_price - first_price) / first_price * 100 ELSE 0 END AS change_percent FROM g),
v AS (SELECT *, CASE WHEN abs(change_percent) < 2 THEN 'stable' WHEN change_percent > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM m)"""


@query(f"WITH {SIMPLE_SQL} SELECT product_key, trend, {big('n period_days')}, {r6('first_price last_price volatility change_percent')} FROM v")
def trend_simple_pop(spark, sf_dir):
    return rounded(longs(trends.simple_trends(price_history(spark, sf_dir)), "n", "period_days"), 6, "first_price", "last_price", "volatility", "change_percent")


@query(f"WITH {SIMPLE_SQL} SELECT c.trend, CAST(count(v.trend) AS BIGINT) AS n FROM (VALUES ('increasing'), ('decreasing'), ('stable'), ('insufficient_data')) c(trend) LEFT JOIN v ON v.trend = c.trend GROUP BY c.trend")
def trend_histogram(spark, sf_dir):
    return trends.trend_histogram(trends.simple_trends(price_history(spark, sf_dir)))


@query(f"""WITH {HISTORY_SQL}, w AS (SELECT *, lag(price) OVER (PARTITION BY product_key ORDER BY date) AS prev FROM h)
 SELECT product_key, round(coalesce(stddev_samp(CASE WHEN prev <> 0 THEN (price - prev) / prev END), 0), 6) + 0.0 AS volatility FROM w GROUP BY product_key HAVING count(*) >= 5""")
def volatility_returns(spark, sf_dir):
    return rounded(_trends(spark, sf_dir).select("product_key", "volatility"), 6, "volatility")


@query("""WITH o AS (SELECT o_custkey AS key, o_orderkey, o_orderdate AS ts, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
 SELECT key, o_orderkey, ts, price FROM o WHERE rn <= 3""")
def history_last_n(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    return compare.keep_last_n(o, ["key"], ["ts", "o_orderkey"], 3)


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey""")
def dedup_last_wins(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return compare.last_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey""")
def dedup_keep_first(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return compare.first_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


# snapshots


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return snapshot(spark, sf_dir, "current"), snapshot(spark, sf_dir, "previous")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare(*_pair(spark, sf_dir))


COMPARED = "name, sku, url, old_price, new_price, old_status, new_status, images_changed, price_changed, significant, direction, status"


@query(f"WITH {COMPARE_SQL} SELECT {COMPARED}, {r6('change_amount change_percent')} FROM k")
def snapshot_full_outer(spark, sf_dir):
    return rounded(_compared(spark, sf_dir).drop("characteristic_changes"), 6, "change_amount", "change_percent")


def _repeated(spark: SparkSession, sf_dir: str, which: str, every: int) -> DataFrame:
    """A snapshot with some products once more, later and at another price."""
    s = snapshot(spark, sf_dir, which).withColumn("seq", F.lit(1))
    again = s.where(F.col("p_partkey") % every == 0)
    return s.unionByName(again.withColumns({"price": F.col("price") + 100, "seq": F.lit(3)})).unionByName(again.withColumns({"price": F.col("price") - 50, "seq": F.lit(2)}))


def repeated_sql(name: str, every: int) -> str:
    return f"""{name}r AS (SELECT *, 1 AS seq FROM {name} UNION ALL SELECT * REPLACE (price + 100 AS price), 3 FROM {name} WHERE p_partkey % {every} = 0
 UNION ALL SELECT * REPLACE (price - 50 AS price), 2 FROM {name} WHERE p_partkey % {every} = 0),
 {name}1 AS (SELECT * FROM {name}r QUALIFY row_number() OVER (PARTITION BY name, sku, url ORDER BY seq DESC) = 1)"""


@query(f"""WITH {snapshot_sql("current", "c")}, {snapshot_sql("previous", "p")}, {repeated_sql("c", 5)}, {repeated_sql("p", 7)}
 SELECT coalesce(c1.sku, p1.sku) AS sku, p1.price AS old_price, c1.price AS new_price, coalesce(p1.status, 'unknown') AS old_status, coalesce(c1.status, 'unknown') AS new_status
 FROM c1 FULL OUTER JOIN p1 ON c1.name = p1.name AND c1.sku = p1.sku AND c1.url = p1.url""")
def snapshot_duplicates(spark, sf_dir):
    out = compare.compare(_repeated(spark, sf_dir, "current", 5), _repeated(spark, sf_dir, "previous", 7), order=["seq"])
    return out.select("sku", "old_price", "new_price", "old_status", "new_status")


@query(f"WITH {COMPARE_SQL} SELECT name, sku, price, category FROM c WHERE sku NOT IN (SELECT sku FROM p)")
def snapshot_new(spark, sf_dir):
    cur, prev = _pair(spark, sf_dir)
    return compare.only_in(cur, prev).select("name", "sku", "price", "category")


@query(f"WITH {COMPARE_SQL} SELECT name, sku, price, category FROM p WHERE sku NOT IN (SELECT sku FROM c)")
def snapshot_discontinued(spark, sf_dir):
    cur, prev = _pair(spark, sf_dir)
    return compare.only_in(prev, cur).select("name", "sku", "price", "category")


@query(f"WITH {COMPARE_SQL} SELECT name, sku, direction, significant, {r6('change_amount change_percent')} FROM k WHERE status = 'changed' AND price_changed")
def snapshot_changed(spark, sf_dir):
    out = _compared(spark, sf_dir).where("status = 'changed' and price_changed")
    return rounded(out.select("name", "sku", "direction", "significant", "change_amount", "change_percent"), 6, "change_amount", "change_percent")


@query(f"""WITH {COMPARE_SQL} SELECT count(*) FILTER (status = 'changed' AND price_changed AND direction = 'increase') AS increased,
 count(*) FILTER (status = 'changed' AND price_changed AND direction = 'decrease') AS decreased,
 count(*) FILTER (status IN ('changed', 'unchanged') AND NOT (status = 'changed' AND price_changed)) AS unchanged, count(*) FILTER (status = 'changed') AS changed,
 count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'discontinued') AS discontinued,
 count(*) FILTER (status = 'changed' AND price_changed AND significant) AS significant FROM k""")
def snapshot_counters(spark, sf_dir):
    return compare.change_counters(_compared(spark, sf_dir))


@query(f"WITH {snapshot_sql('current', 'c')} SELECT CAST(0 AS BIGINT) AS increased, CAST(0 AS BIGINT) AS decreased, count(*) AS unchanged, count(*) AS new FROM c")
def snapshot_initial(spark, sf_dir):
    return compare.initial_counters(snapshot(spark, sf_dir, "current"))


@query(f"""WITH {COMPARE_SQL} SELECT sku, 'price' AS field FROM k WHERE status = 'changed' AND price_changed
 UNION ALL SELECT sku, 'availability' FROM k WHERE status = 'changed' AND old_status <> new_status
 UNION ALL SELECT sku, 'characteristic_size' FROM k WHERE status = 'changed' AND c_size <> o_size
 UNION ALL SELECT sku, 'characteristic_color' FROM k WHERE status = 'changed' AND c_color IS NOT NULL""")
def change_list_exploded(spark, sf_dir):
    return compare.change_list(_compared(spark, sf_dir)).select("sku", "field")


@query(f"""WITH {COMPARE_SQL} SELECT sku, 'color' AS key, NULL AS old, c_color AS new FROM k WHERE NOT fresh AND NOT gone AND c_color IS NOT NULL
 UNION ALL SELECT sku, 'size', o_size, c_size FROM k WHERE NOT fresh AND NOT gone AND c_size <> o_size""")
def characteristic_changes(spark, sf_dir):
    out = _compared(spark, sf_dir).where("status in ('changed', 'unchanged')")
    return out.select("sku", F.explode("characteristic_changes").alias("x")).select("sku", "x.*")


# validation and alerts


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current snapshot with every rule broken somewhere, by arithmetic on the key."""
    k = F.col("p_partkey")
    s = snapshot(spark, sf_dir, "current")
    return s.select(
        k, "sku", F.when(k % 13 == 0, "").when(k % 17 == 0, "ab").when(k % 19 == 0, "***").when(k % 23 == 0, F.concat("name", F.lit(" <b>"))).otherwise(F.col("name")).alias("name"),
        F.when(k % 29 == 0, F.lit(None)).when(k % 31 == 0, -F.col("price")).when(k % 37 == 0, 0.0).when(k % 41 == 0, F.col("price") + 0.001).otherwise(F.col("price")).alias("price"),
        F.when(k % 43 == 0, "ftp://x.example/a").when(k % 47 == 0, "nothing").otherwise(F.col("url")).alias("url"), "images", "characteristics",
    )


MESSY_SQL = f"""{snapshot_sql("current", "c")},
m AS (SELECT p_partkey, sku, n_images, CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN 'ab' WHEN p_partkey % 19 = 0 THEN '***' WHEN p_partkey % 23 = 0 THEN name || ' <b>' ELSE name END AS name,
 CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN -price WHEN p_partkey % 37 = 0 THEN 0.0 WHEN p_partkey % 41 = 0 THEN price + 0.001 ELSE price END AS price,
 CASE WHEN p_partkey % 43 = 0 THEN 'ftp://x.example/a' WHEN p_partkey % 47 = 0 THEN 'nothing' ELSE url END AS url FROM c),
e AS (SELECT sku, 'missing:name' AS code FROM m WHERE name = '' UNION ALL SELECT sku, 'missing:price' FROM m WHERE price IS NULL OR price = 0
 UNION ALL SELECT sku, 'name_short' FROM m WHERE length(trim(name)) < 3 UNION ALL SELECT sku, 'name_blank' FROM m WHERE NOT regexp_matches(name, '[\\p{{L}}\\p{{N}}]')
 UNION ALL SELECT sku, 'price_null' FROM m WHERE price IS NULL UNION ALL SELECT sku, 'price_negative' FROM m WHERE price < 0
 UNION ALL SELECT sku, 'url_format' FROM m WHERE NOT regexp_matches(url, '^https?://[^\\s/$.?#].[^\\s]*$') UNION ALL SELECT sku, 'url_scheme' FROM m WHERE NOT regexp_matches(url, '^https?://')),
mw AS (SELECT sku, 'name_special' AS code FROM m WHERE regexp_matches(trim(name), '[^\\p{{L}}\\p{{N}}_\\s\\-.,!?()]') UNION ALL SELECT sku, 'price_digits' FROM m WHERE price <> round(price, 2)
 UNION ALL SELECT sku, 'images_none' FROM m WHERE n_images = 0)"""


@query(f"""WITH {MESSY_SQL} SELECT m.sku, coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM e WHERE e.sku = m.sku), '') AS errors,
 coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM mw WHERE mw.sku = m.sku), '') AS warnings, NOT EXISTS (SELECT 1 FROM e WHERE e.sku = m.sku) AS is_valid FROM m""")
def validate_rows(spark, sf_dir):
    v = validate.validate(_messy(spark, sf_dir))
    codes = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x["code"])), ",")
    return v.select("sku", codes("errors").alias("errors"), codes("warnings").alias("warnings"), "is_valid")


@query(f"WITH {MESSY_SQL} SELECT code, count(*) AS n FROM e GROUP BY code")
def validate_error_histogram(spark, sf_dir):
    return validate.error_histogram(validate.validate(_messy(spark, sf_dir)))


METRICS_SQL = f"""{MESSY_SQL}, q AS (SELECT count(*) AS total_products, count(*) FILTER (sku NOT IN (SELECT sku FROM e)) AS valid_products FROM m)"""


@query(f"""WITH {METRICS_SQL} SELECT total_products, valid_products, total_products - valid_products AS invalid_products, round(valid_products / total_products, 6) AS completeness_score,
 round(valid_products / total_products, 6) AS validity_score, round(valid_products / total_products, 6) AS quality_score FROM q""")
def quality_metrics(spark, sf_dir):
    return rounded(validate.quality_metrics(validate.validate(_messy(spark, sf_dir))), 6, "completeness_score", "validity_score", "quality_score")


@query(f"WITH {METRICS_SQL} SELECT total_products, valid_products, total_products - valid_products AS invalid_products, round(valid_products / total_products, 6) AS data_quality_score FROM q")
def validation_report(spark, sf_dir):
    return rounded(validate.report(validate.quality_metrics(validate.validate(_messy(spark, sf_dir)))), 6, "data_quality_score")


@query(f"""WITH {METRICS_SQL}, top AS (SELECT string_agg(code, ', ' ORDER BY n DESC, code) AS top FROM (SELECT code, count(*) AS n FROM e GROUP BY code ORDER BY n DESC, code LIMIT 3)),
 a AS (SELECT 0 AS o, CASE WHEN valid_products / total_products < 0.8 THEN '{validate.ADVICE[0]}' END AS advice FROM q UNION ALL SELECT 1, '{validate.ADVICE[1]}' || top FROM top WHERE top <> ''
 UNION ALL SELECT 2, CASE WHEN valid_products / total_products < 0.9 THEN '{validate.ADVICE[2]}' END FROM q)
 SELECT row_number() OVER (ORDER BY o) - 1 AS position, advice FROM a WHERE advice IS NOT NULL""")
def validation_recommendations(spark, sf_dir):
    v = validate.validate(_messy(spark, sf_dir))
    return longs(validate.recommendations(validate.quality_metrics(v), validate.error_histogram(v)), "position")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = trends.trends_summary(_trends(spark, sf_dir))
    return alerts.all_alerts(_compared(spark, sf_dir), summary, validate.quality_metrics(validate.validate(_messy(spark, sf_dir))))


ALERTS_SQL = f"""{COMPARE_SQL}, {TRENDS_SQL}, s AS (SELECT count(*) FILTER (volatility > 0.1) AS hv FROM t),
 {MESSY_SQL[MESSY_SQL.index("m AS (SELECT"):]}, q AS (SELECT count(*) AS total, count(*) FILTER (sku NOT IN (SELECT sku FROM e)) AS valid FROM m),
 a AS (SELECT 'price' AS alert_group, 'PRICE_CHANGE' AS type, 'CRITICAL' AS level, name AS product, printf('{alerts.PRICE}', change_percent) AS message FROM k WHERE status = 'changed' AND significant
 UNION ALL SELECT 'availability', 'NEW_PRODUCT', 'WARNING', name, '{alerts.NEW}' FROM k WHERE status = 'new'
 UNION ALL SELECT 'availability', 'DISCONTINUED_PRODUCT', 'WARNING', name, '{alerts.GONE}' FROM k WHERE status = 'discontinued'
 UNION ALL SELECT 'trend', 'HIGH_VOLATILITY', 'WARNING', NULL, printf('{alerts.VOLATILE}', hv) FROM s WHERE hv > 5
 UNION ALL SELECT 'quality', 'DATA_QUALITY', 'CRITICAL', NULL, printf('{alerts.QUALITY}', valid / total) FROM q WHERE valid / total < 0.7
 UNION ALL SELECT 'quality', 'HIGH_INVALID_DATA', 'WARNING', NULL, printf('{alerts.INVALID}', total - valid, total) FROM q WHERE (total - valid) / total > 0.3)"""


@query(f"WITH {ALERTS_SQL} SELECT * FROM a")
def alerts_union(spark, sf_dir):
    return _alerts(spark, sf_dir).select("alert_group", "type", "level", "product", "message")


@query(f"WITH {ALERTS_SQL} SELECT count(*) AS total_alerts, count(*) FILTER (level = 'CRITICAL') AS critical_alerts, count(*) FILTER (level <> 'CRITICAL') AS warning_alerts FROM a")
def alerts_summary(spark, sf_dir):
    return alerts.alert_summary(_alerts(spark, sf_dir))


@query(f"""WITH {ALERTS_SQL}, n AS (SELECT count(*) FILTER (level = 'CRITICAL') AS c, count(*) FILTER (alert_group = 'price') AS p, count(*) FILTER (alert_group = 'quality') AS q FROM a),
 r AS (SELECT 0 AS o, '{alerts.ADVICE[0]}' AS advice FROM n WHERE c > 0 UNION ALL SELECT 1, '{alerts.ADVICE[1]}' FROM n WHERE p > 10 UNION ALL SELECT 2, '{alerts.ADVICE[2]}' FROM n WHERE q > 0)
 SELECT row_number() OVER (ORDER BY o) - 1 AS position, advice FROM r""")
def alert_recommendations(spark, sf_dir):
    return longs(alerts.recommendations(_alerts(spark, sf_dir)), "position")


@query(f"WITH {COMPARE_SQL} SELECT name AS product, printf('{alerts.PRICE}', change_percent) AS message FROM k WHERE status = 'changed' AND significant")
def price_alert_messages(spark, sf_dir):
    return alerts.price_alerts(_compared(spark, sf_dir)).select("product", "message")


# filters


@query("SELECT p_partkey FROM part WHERE p_partkey % 9 = 0 OR p_retailprice BETWEEN 920 AND 960.5")
def filter_price_range(spark, sf_dir):
    price = F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice"))  # some without a price, which pass
    return read_table(spark, sf_dir, "part").where(filters.price_between(price, 920, 960.5)).select("p_partkey")


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE '%promo%' OR lower(p_type) LIKE '%eco%'")
def filter_category_any(spark, sf_dir):
    return read_table(spark, sf_dir, "part").where(filters.category_any(F.col("p_type"), ["PROMO", "eco"])).select("p_partkey", "p_type")


@query(f"WITH {snapshot_sql('current', 'c')} SELECT sku FROM c WHERE CAST(regexp_extract(c_size, '(\\d+\\.?\\d*)', 1) AS DOUBLE) BETWEEN 10 AND 20 AND lower(c_type) = 'promo'")
def filter_characteristics(spark, sf_dir):
    return snapshot(spark, sf_dir, "current").where(filters.characteristics_match(F.col("characteristics"), "size:10-20,type:promo")).select("sku")


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) SELECT p_brand, p_partkey FROM r WHERE rn <= 10""")
def first_per_group(spark, sf_dir):
    return filters.first_per_group(read_table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 10)


@query("SELECT page_id, regexp_matches(lower(html), 'captcha|access denied|blocked|cloudflare|robot check|доступ запрещен') AS blocked FROM pages")
def blocked_pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", filters.is_blocked_page(F.col("html")).alias("blocked"))


# identifiers


@query("""WITH f AS (SELECT p_brand AS name, p_type AS category, min(p_partkey) AS first FROM part GROUP BY 1, 2)
 SELECT name, category, 'ART-' || lpad(CAST(row_number() OVER (ORDER BY first, name, category) AS VARCHAR), 6, '0') AS article FROM f""")
def sequential_article(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("category"), "p_partkey")
    return filters.sequential_article(p, "p_partkey")


CATEGORY_SQL = "CASE p_partkey % 4 WHEN 0 THEN 'Ноутбуки и ноутбук' WHEN 1 THEN 'Телефон' WHEN 2 THEN 'Мебель' ELSE p_type END"


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    name = F.when(m == 0, "Ноутбуки и ноутбук").when(m == 1, "Телефон").when(m == 2, "Мебель").otherwise(F.col("p_type"))
    return read_table(spark, sf_dir, "part").withColumn("category", name)


@query(f"""WITH c AS (SELECT *, {CATEGORY_SQL} AS category FROM part) SELECT p_partkey, CASE WHEN lower(category) LIKE '%ноутбук%' THEN 'NB' WHEN lower(category) LIKE '%телефон%' THEN 'PH'
 WHEN lower(category) LIKE '%мебель%' THEN 'FRN' ELSE 'GEN' END || '-' || upper(substr(md5(p_name || category || 'brand=' || p_brand || ';size=' || CAST(p_size AS VARCHAR) || ';'), 1, 8)) AS article FROM c""")
def hash_article(spark, sf_dir):
    traits = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return _categories(spark, sf_dir).select("p_partkey", ids.hash_article(F.col("p_name"), F.col("category"), traits).alias("article"))


@query("""SELECT p_partkey, upper(substr(p_type, 1, 3)) || '-' || CASE WHEN p_partkey % 3 = 0 THEN 'SAM' WHEN p_partkey % 3 = 1 THEN 'LG' ELSE 'UNK' END || '-'
 || upper(substr(md5(p_name || CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR)), 1, 4)) AS article FROM part""")
def composite_article(spark, sf_dir):
    k = F.col("p_partkey") % 3
    seen = F.when(k == 0, "made by Samsung").when(k == 1, "LG inside").otherwise("none")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string")
    return read_table(spark, sf_dir, "part").select("p_partkey", ids.composite_article(F.col("p_name"), F.col("p_type"), seen, cents).alias("article"))


@query(f"""WITH c AS (SELECT *, {CATEGORY_SQL} AS category FROM part) SELECT p_partkey, CASE WHEN lower(category) LIKE '%ноутбук%' THEN 'NB' WHEN lower(category) LIKE '%телефон%' THEN 'PH'
 WHEN lower(category) LIKE '%мебель%' THEN 'FRN' ELSE 'GEN' END AS prefix FROM c""")
def category_prefix(spark, sf_dir):
    return _categories(spark, sf_dir).select("p_partkey", ids.category_prefix(F.col("category")).alias("prefix"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'apple' WHEN 1 THEN 'sony' ELSE 'UNK' END AS brand FROM part")
def brand_extract(spark, sf_dir):
    k = F.col("p_partkey") % 3
    seen = F.concat("p_name", F.when(k == 0, " Apple Sony").when(k == 1, " SONY").otherwise(" x"))
    return read_table(spark, sf_dir, "part").select("p_partkey", ids.brand(seen).alias("brand"))


# measures


def _units(spark: SparkSession, sf_dir: str, units: Sequence[str]) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    unit = F.get(F.array(*map(F.lit, units)), (F.col("p_partkey") % len(units)).cast("int"))
    return p.select("p_partkey", "p_size", F.concat(F.col("p_size").cast("string"), F.lit(",5 "), unit).alias("text"))


def units_sql(units: dict[str, float], digits: int, name: str) -> str:
    cases = " ".join(f"WHEN {i} THEN CAST({f!r} AS DOUBLE)" for i, f in enumerate(units.values()))
    return f"SELECT p_partkey, round((p_size + CAST(0.5 AS DOUBLE)) * CASE p_partkey % {len(units)} {cases} END, {digits}) AS {name} FROM part"


LENGTHS = {"mm": 1.0, "см": 10.0, "m": 1000.0, "inch": 25.4, "фут": 304.8, "": 1.0}
WEIGHTS = {"г": 1.0, "KG": 1000.0, "lb": 453.592, "oz": 28.3495, "stone": 1.0}
VOLUMES = {"л": 1.0, "ml": 0.001, "gallon": 3.78541, "м3": 1000.0, "cup": 1.0}


@query("SELECT 'weight' AS kind, CAST(%d AS BIGINT) AS n UNION ALL SELECT 'length', %d UNION ALL SELECT 'volume', %d" % (len(measures.WEIGHT_G), len(measures.LENGTH_MM), len(measures.VOLUME_L)))
def unit_table(spark, sf_dir):
    return measures.unit_table(spark).groupBy("kind").agg(F.count("*").alias("n"))


@query(units_sql(LENGTHS, 2, "length_mm"))
def unit_length_mm(spark, sf_dir):
    return _units(spark, sf_dir, list(LENGTHS)).select("p_partkey", measures.length_mm(F.col("text")).alias("length_mm"))


@query(units_sql(WEIGHTS, 2, "weight_g"))
def unit_weight_g(spark, sf_dir):
    return _units(spark, sf_dir, list(WEIGHTS)).select("p_partkey", measures.weight_g(F.col("text")).alias("weight_g"))


@query(units_sql(VOLUMES, 3, "volume_l"))
def unit_volume_l(spark, sf_dir):
    return _units(spark, sf_dir, list(VOLUMES)).select("p_partkey", measures.volume_l(F.col("text")).alias("volume_l"))


@query("""SELECT p_partkey, p_size * 10.0::DOUBLE AS length_mm, CASE WHEN p_partkey % 3 > 0 THEN (p_size + 1) * 10.0::DOUBLE END AS width_mm,
 CASE WHEN p_partkey % 3 > 1 THEN (p_size + 2) * 10.0::DOUBLE END AS height_mm FROM part""")
def unit_dimensions(spark, sf_dir):
    s = lambda n: (F.col("p_size") + n).cast("string")
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(s(0), F.lit(" cm"))).when(k == 1, F.concat(s(0), F.lit("x"), s(1), F.lit("cm"))).otherwise(F.concat(s(0), F.lit(" × "), s(1), F.lit(" * "), s(2), F.lit(" см")))
    d = measures.dimensions_mm(text)
    return read_table(spark, sf_dir, "part").select("p_partkey", d["length_mm"].alias("length_mm"), d["width_mm"].alias("width_mm"), d["height_mm"].alias("height_mm"))


@query("""WITH s AS (SELECT p_partkey, 'Цена: ' || CAST(p_size AS VARCHAR) || ',' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || ' руб' AS text FROM part)
 SELECT p_partkey, TRY_CAST(nullif(regexp_extract(replace(regexp_replace(text, '[^\\d,.]', '', 'g'), ',', '.'), '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS price FROM s""")
def price_parse(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("Цена: "), F.col("p_size").cast("string"), F.lit(","), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" руб"))
    return read_table(spark, sf_dir, "part").select("p_partkey", measures.price(text).alias("price"))


@query("SELECT p_partkey, CAST(p_partkey * 1000 + p_size AS DOUBLE) + 0.25 AS price FROM part")
def price_parse_locale(spark, sf_dir):
    k, tail = F.col("p_partkey"), F.lpad(F.col("p_size").cast("string"), 3, "0")
    mark = F.when(k % 2 == 0, ",").otherwise(".")
    text = F.concat(k.cast("string"), mark, tail, F.when(k % 2 == 0, ".25 $").otherwise(",25 €"))
    return read_table(spark, sf_dir, "part").select("p_partkey", measures.price_locale(text).alias("price"))


STATES = ("Нет в наличии", "В наличии", "Sold out", "Available", "unavailable", "soon")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'out_of_stock' WHEN 1 THEN 'in_stock' WHEN 2 THEN 'out_of_stock' WHEN 3 THEN 'in_stock' WHEN 4 THEN 'out_of_stock' ELSE 'unknown' END AS status, CASE WHEN p_partkey % 6 = 1 THEN p_size END AS quantity FROM part")
def availability_status(spark, sf_dir):
    k = (F.col("p_partkey") % 6).cast("int")
    text = F.concat(F.get(F.array(*map(F.lit, STATES)), k), F.when(k == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" шт"))).otherwise(""))
    a = measures.availability(text)
    return read_table(spark, sf_dir, "part").select("p_partkey", a["status"].alias("status"), a["quantity"].alias("quantity"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size % 5 + 0.5::DOUBLE WHEN 1 THEN CAST(nullif(p_size % 6, 0) AS DOUBLE) END AS rating FROM part")
def rating_parse(spark, sf_dir):
    k, n = F.col("p_partkey") % 3, F.col("p_size")
    text = F.when(k == 0, F.concat(F.lit("Оценка "), (n % 5).cast("string"), F.lit(",5"))).when(k == 1, F.repeat(F.lit("★"), n % 6)).otherwise("none")
    return read_table(spark, sf_dir, "part").select("p_partkey", measures.rating(text).alias("rating"))


@query("SELECT p_partkey, 'Арт_' || CAST(p_partkey AS VARCHAR) || '-x' AS sku FROM part")
def sku_clean(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", measures.sku(F.concat(F.lit(" Арт_"), F.col("p_partkey").cast("string"), F.lit("-x №!"))).alias("sku"))


@query("""SELECT p_partkey, k AS key, CASE k WHEN 'manufacturer' THEN p_brand WHEN 'weight' THEN CAST(round(p_size * 1000.0::DOUBLE, 2) AS VARCHAR) ELSE 'red' END AS value FROM part, (VALUES ('manufacturer'), ('weight'), ('color')) v(k)""")
def characteristics_normalized(spark, sf_dir):
    traits = F.create_map(F.lit(" Бренд "), F.col("p_brand"), F.lit("Вес"), F.concat(F.col("p_size").cast("string"), F.lit(" кг")), F.lit("ЦВЕТ"), F.lit("Красный"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.explode(measures.normalize_map(traits)).alias("key", "value"))


# text


@query("SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS text FROM documents")
def text_collapse(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.collapse(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS text FROM documents")
def truncate_ellipsis(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 200).alias("text"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\.{2,}', '...', 'g'), '!{2,}', '!', 'g'), '\\?{2,}', '?', 'g'),
 '[^\\p{L}\\p{N}_\\s.,!?\\-:()]', '', 'g') AS text FROM documents""")
def text_preprocess(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.preprocess(F.col("text")).alias("text"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY 1, 2),
 p AS (SELECT doc_id, max(n) AS m, count(*) FILTER (n > 3) AS k FROM c GROUP BY 1) SELECT d.doc_id, coalesce(m, 0) AS max_repetition, coalesce(k, 0) AS problem_words FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id""")
def text_repetition(spark, sf_dir):
    return rewrite.repetition(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


READABLE_SQL = """b AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '') AS ss FROM documents),
 r AS (SELECT doc_id, text, CASE WHEN len(ss) = 0 THEN 0.0 ELSE greatest(0.0, 1 - (CAST(list_sum(list_transform(ss, lambda s: len(string_split(s, ' ')))) AS DOUBLE) / len(ss) - 10) / 20) END AS readability FROM b)"""


@query(f"WITH {READABLE_SQL} SELECT doc_id, round(CAST(readability AS DOUBLE), 6) + 0.0 AS readability FROM r")
def text_readability(spark, sf_dir):
    return rounded(read_table(spark, sf_dir, "documents").select("doc_id", X.readability(F.col("text")).alias("readability")), 6, "readability")


CLEAN_SQL = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 1.0 ELSE round(CAST(length({CLEAN_SQL}) AS DOUBLE) / length(text), 6) END AS ratio FROM documents")
def text_length_ratio(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return rounded(d.select("doc_id", X.length_ratio(F.col("text"), F.trim(F.regexp_replace("text", "\\s+", " "))).alias("ratio")), 6, "ratio")


ISSUES_SQL = """(len(list_filter(list_slice(regexp_split_to_array(text, '[.!?]+'), 1, len(regexp_split_to_array(text, '[.!?]+')) - 1), lambda s: s <> '')) + CASE WHEN contains(text, '  ') THEN 1 ELSE 0 END
 + CASE WHEN len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '^\\p{Ll}'))) > 0 THEN 1 ELSE 0 END)"""


@query(f"SELECT doc_id, CAST({ISSUES_SQL} AS BIGINT) AS issues FROM documents")
def text_grammar_issues(spark, sf_dir):
    return longs(read_table(spark, sf_dir, "documents").select("doc_id", X.grammar_issues(F.col("text")).alias("issues")), "issues")


@query(f"""WITH {READABLE_SQL}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents),
 c AS (SELECT doc_id, max(n) AS m FROM (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY 1, 2) GROUP BY 1),
 x AS (SELECT r.doc_id, CASE WHEN length(text) = 0 THEN 1.0 ELSE CAST(length({CLEAN_SQL}) AS DOUBLE) / length(text) END AS ratio, coalesce(m, 0) AS m, readability, {ISSUES_SQL} AS issues FROM r LEFT JOIN c ON c.doc_id = r.doc_id)
 SELECT doc_id, round(least(1.0, greatest(0.0, 0.2 * CASE WHEN ratio < 1 THEN ratio ELSE 1 / ratio END + 0.2 * greatest(0.0, 1 - (m - 1) / 5.0::DOUBLE) + 0.2 * readability + 0.1 * greatest(0.0, 1 - issues / 5.0::DOUBLE))), 6) + 0.0 AS score FROM x""")
def overall_score_no_similarity(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", rewrite.repeats(F.col("text"))["most"].alias("max_repetition"))
    clean = F.trim(F.regexp_replace("text", "\\s+", " "))
    score = X.overall_score(X.length_ratio(F.col("text"), clean), None, F.col("max_repetition"), X.readability(F.col("text")), X.grammar_issues(F.col("text")))
    return rounded(d.select("doc_id", score.alias("score")), 6, "score")


SPEC_SQL = "'Диаметр ' || CAST(p_size AS VARCHAR) || ' мм, вес ' || CAST(p_size + 1 AS VARCHAR) || ',5 кг; материал: сталь'"


@query("SELECT p_partkey, array_to_string(list_sort([CAST(p_size AS VARCHAR) || ' мм', CAST(p_size + 1 AS VARCHAR) || ',5 кг', 'Диаметр', 'вес', 'материал']), '|') AS terms FROM part")
def technical_terms_extract(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.technical_terms(_spec()), "|").alias("terms"))


def _spec():
    n = F.col("p_size")
    return F.concat(F.lit("Диаметр "), n.cast("string"), F.lit(" мм, вес "), (n + 1).cast("string"), F.lit(",5 кг; материал: сталь"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 3 END AS BIGINT) AS kept_terms, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 2 END AS BIGINT) AS lost_terms, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.6 END::DOUBLE AS preservation_rate, p_partkey % 2 = 0 AS preserved FROM part")
def technical_preservation(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").withColumn("spec", _spec())
    shorter = F.when(F.col("p_partkey") % 2 == 0, F.col("spec")).otherwise(F.concat(F.lit("ДИАМЕТР, материал и "), F.regexp_extract("spec", "(\\d+ мм)", 1)))
    got = rewrite.preservation(X.technical_terms(F.col("spec")), shorter)
    return longs(p.select("p_partkey", *[c.alias(n) for n, c in got.items()]), "kept_terms", "lost_terms")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Новый дом. Старый Сад! Вот?' ELSE 'Один.' END AS text FROM part")
def grammar_corrected(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 2 == 0, "новый  дом.старый Сад! вот?").otherwise(" один")
    return read_table(spark, sf_dir, "part").select("p_partkey", X.correct_grammar(F.trim(text)).alias("text"))


@query("""WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]+) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS s FROM documents),
 c AS (SELECT doc_id, count(*) AS n_sentences, CAST(sum(len(regexp_extract_all(s, '[\\p{L}\\p{N}_]+'))) AS BIGINT) AS n_words, CAST(sum(len(regexp_extract_all(s, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))) AS BIGINT) AS n_tokens FROM s GROUP BY doc_id)
 SELECT documents.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_words, 0) AS n_words, coalesce(n_tokens, 0) AS n_tokens FROM documents LEFT JOIN c ON c.doc_id = documents.doc_id""")
def text_analysis(spark, sf_dir):
    a = X.analyze(F.col("text"))
    total = lambda f: F.aggregate(F.transform("a", f), F.lit(0).cast("bigint"), lambda x, n: x + n)
    out = read_table(spark, sf_dir, "documents").select("doc_id", a.alias("a"))
    out = out.select("doc_id", F.size("a").alias("n_sentences"), total(lambda s: s["n_words"]).alias("n_words"), total(lambda s: F.size(s["tokens"])).alias("n_tokens"))
    return longs(out, "n_sentences")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS brands, 'X' || CAST(p_partkey AS VARCHAR) || '-a' AS models FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS p_name FROM part)")
def brands_and_models(spark, sf_dir):
    k = F.col("p_partkey")
    first = F.element_at(F.split("p_name", " "), 1)
    text = F.concat(F.when(k % 2 == 0, F.concat(F.lit("Бренд: "), first, F.lit(", "))).otherwise("no "), F.lit("модель X"), k.cast("string"), F.lit("-a, модель plain"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.brands(text), ",").alias("brands"), F.array_join(X.models(text), ",").alias("models"))


DICTIONARY_SQL = "(VALUES " + ", ".join(f"('{w}', {len(s)})" for w, s in rewrite.SYNONYMS.items()) + ") s(word, n)"


#: A dictionary of one synonym a word, so that SQL can tell which it is.
SINGLE = {"small": ["tiny"], "red": ["scarlet"], "blue": ["azure"], "ring": ["band"], "bolt": []}
SINGLE_SQL = "(VALUES " + ", ".join(f"('{w}', {repr(s[0]) if s else 'NULL'})" for w, s in SINGLE.items()) + ") s(key, synonym)"
WORDS_SQL = "w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(len(string_split(p_name, ' ')))) AS pos FROM part)"


def _name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


@query(f"WITH {WORDS_SQL} SELECT p_partkey, pos, word, synonym FROM w LEFT JOIN {SINGLE_SQL} ON lower(word) = key")
def synonym_lookup(spark, sf_dir):
    words = _name_words(spark, sf_dir).withColumn("word", F.initcap("word"))  # case is ignored
    out = rewrite.lookup_synonyms(words, rewrite.synonym_table(spark, SINGLE))
    return longs(out.select(F.col("id").alias("p_partkey"), "pos", F.lower("word").alias("word"), "synonym"), "pos")


@query(f"WITH {WORDS_SQL} SELECT p_partkey, pos, word, word IN ('ring', 'widget') AS technical FROM w")
def technical_words(spark, sf_dir):
    terms = spark.createDataFrame([("Ring",), ("widget",), ("RING",)], "term string")
    return longs(rewrite.is_technical(_name_words(spark, sf_dir), terms).withColumnRenamed("id", "p_partkey"), "pos")


@query(f"WITH {WORDS_SQL} SELECT p_partkey, pos, word FROM w WHERE word NOT IN ('ring', 'widget')")
def words_without_terms(spark, sf_dir):
    terms = spark.createDataFrame([("Ring",), ("widget",)], "term string")
    return longs(rewrite.without_terms(_name_words(spark, sf_dir), terms).withColumnRenamed("id", "p_partkey"), "pos")


@query("""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM benchmark)
 SELECT item_id, pos, word, coalesce(lag(word, 2) OVER p || ' ', '') || coalesce(lag(word) OVER p, '') AS before, coalesce(lead(word) OVER p, '') || coalesce(' ' || lead(word, 2) OVER p, '') AS after
 FROM w WINDOW p AS (PARTITION BY item_id ORDER BY pos)""")
def words_in_context(spark, sf_dir):
    words = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(F.split("text", " ")).alias("pos", "word"))
    out = rewrite.in_context(words)
    return longs(out.select(F.col("id").alias("item_id"), "pos", "word", F.array_join("before", " ").alias("before"), F.array_join("after", " ").alias("after")), "pos")


@query(f"SELECT count(*) AS entries, CAST(sum(n) AS BIGINT) AS total_synonyms, CAST(avg(n) AS DOUBLE) AS average_synonyms FROM {DICTIONARY_SQL}")
def dictionary_stats(spark, sf_dir):
    return rewrite.dictionary_stats(rewrite.synonym_table(spark))


# addresses and pages


@query("SELECT page_id, regexp_extract(url, '^(?:https?://)?([^/]*)', 1) AS site FROM pages")
def url_site_key(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", urls.site_key(F.col("url")).alias("site"))


@query("""WITH h AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) AS host FROM pages), l AS (SELECT *, string_split(host, '.') AS a FROM h)
 SELECT page_id, host, CASE WHEN len(a) > 2 THEN array_to_string(list_slice(a, 1, len(a) - 2), '.') ELSE '' END AS subdomain, CASE WHEN len(a) >= 2 THEN array_to_string(list_slice(a, -2, -1), '.') ELSE '' END AS domain,
 lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM l""")
def url_domain_info(spark, sf_dir):
    u = F.col("url")
    return read_table(spark, sf_dir, "pages").select(
        "page_id", urls.host(u).alias("host"), urls.subdomain(u).alias("subdomain"), urls.registered_domain(u).alias("domain"), urls.scheme(u).alias("scheme"), urls.path(u).alias("path")
    )


@query("SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url, '(?i)page[=/]?(\\d+)', 1), '') AS INTEGER), 1) AS page FROM pages")
def page_number(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", urls.page_number(F.col("url")).alias("page"))


@query("""WITH u AS (SELECT p_partkey, p_partkey % 2 = 0 AS listed, regexp_replace(p_name || '_' || CAST(p_partkey AS VARCHAR), '[-_ ]', ' ', 'g') AS name FROM part)
 SELECT p_partkey, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name, listed AS is_category FROM u""")
def category_from_url(spark, sf_dir):
    k = F.col("p_partkey")
    folder = F.when(k % 2 == 0, "https://shop.example/Catalog/").otherwise("https://shop.example/item/")
    u = F.concat(folder, F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), k.cast("string"), F.lit("//"))
    return read_table(spark, sf_dir, "part").select("p_partkey", urls.category_name(u).alias("name"), urls.is_category(u).alias("is_category"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN regexp_replace(url, '^[a-z]+', 'ftp') WHEN 2 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 3 THEN url || ' x' ELSE url END AS url FROM pages)
 SELECT page_id, CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN 'no_host' WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_scheme' END AS problem,
 regexp_matches(url, '^https?://[^\\s/$.?#].[^\\s]*$') AS valid FROM u""")
def url_validity(spark, sf_dir):
    k, u = F.col("page_id") % 4, F.col("url")
    odd = F.when(k == 1, F.regexp_replace(u, "^[a-z]+", "ftp")).when(k == 2, F.regexp_replace(u, "^[a-z]+://", "")).when(k == 3, F.concat(u, F.lit(" x"))).otherwise(u)
    pages = read_table(spark, sf_dir, "pages").select("page_id", odd.alias("url"))
    return pages.select("page_id", urls.problem(F.col("url")).alias("problem"), F.col("url").rlike(urls.VALID).alias("valid"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1 FROM pages")
def page_title_h1(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("h1"))


NAV_SQL = """n AS (SELECT page_id, url AS page_url, array_to_string(regexp_extract_all(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '') AS nav FROM pages),
 a AS (SELECT page_id, page_url, unnest(regexp_extract_all(nav, '(?s)(<a [^>]*href="[^"]*"[^>]*>.*?</a>)', 1)) AS tag, unnest(range(len(regexp_extract_all(nav, '(?s)(<a [^>]*href="[^"]*"[^>]*>.*?</a>)', 1)))) AS position FROM n),
 l AS (SELECT page_id, position, trim(regexp_replace(regexp_replace(tag, '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS name, regexp_extract(tag, 'href="([^"]*)"', 1) AS href,
 regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || regexp_extract(tag, 'href="([^"]*)"', 1) AS url FROM a)"""


@query(f"WITH {NAV_SQL} SELECT page_id, CAST(position AS BIGINT) AS position, name, href, url FROM l")
def nav_links_exploded(spark, sf_dir):
    return longs(extract.nav_links(read_table(spark, sf_dir, "pages")), "position")


VALID_SQL = "length(name) BETWEEN 2 AND 100 AND NOT regexp_matches(lower(name), 'home|main|index|contact|about|login|register') AND regexp_matches(url, '^https?://')"


@query(f"WITH {NAV_SQL} SELECT page_id, name, url FROM l WHERE {VALID_SQL}")
def nav_links_valid(spark, sf_dir):
    return extract.nav_links(read_table(spark, sf_dir, "pages")).where(urls.is_valid_category(F.col("name"), F.col("url"))).select("page_id", "name", "url")


@query(f"WITH {NAV_SQL} SELECT url, arg_min(name, (page_id, position, name)) AS name, 'navigation' AS type FROM l WHERE {VALID_SQL} GROUP BY url")
def nav_links_dedup(spark, sf_dir):
    return extract.categories(read_table(spark, sf_dir, "pages")).select("url", "name", "type")


@query(f"""WITH {NAV_SQL}, d AS (SELECT DISTINCT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) AS host FROM l WHERE {VALID_SQL}),
 r AS (SELECT url, row_number() OVER (PARTITION BY host ORDER BY url) AS rn FROM d) SELECT url FROM r WHERE rn <= 10""")
def first_categories(spark, sf_dir):
    return extract.first_categories(extract.categories(read_table(spark, sf_dir, "pages"))).select("url")


@query("""WITH m AS (SELECT page_id, unnest(['description', 'og:title', 'og:url']) AS key, unnest(['page ' || CAST(page_id AS VARCHAR), CASE WHEN page_id % 2 = 0 THEN 'second' ELSE 'first' END, url]) AS value FROM pages) SELECT * FROM m""")
def meta_map(spark, sf_dir):
    k = F.col("page_id")
    head = F.concat(
        F.lit("<meta name=\"description\" content=\"page "), k.cast("string"), F.lit("\"><META content=\"first\" property=\"og:title\"><meta name=\"empty\" content=\"\"><meta charset=\"utf-8\">"),
        F.when(k % 2 == 0, "<meta property=\"og:title\" content=\"second\">").otherwise(""), F.lit("<meta property=\"og:url\" content=\""), F.col("url"), F.lit("\">"), F.col("html"),
    )
    return read_table(spark, sf_dir, "pages").select("page_id", F.explode(extract.meta_map(head)).alias("key", "value"))


@query("""SELECT 'https://shop.example/catalog/' || regexp_replace(p_name, ' ', '-', 'g') || '_' || CAST(p_partkey AS VARCHAR) AS url, upper(p_name[1]) || regexp_replace(p_name[2:], ' .*$', '') || ' ' ||
 upper(regexp_extract(p_name, ' (.)', 1)) || regexp_extract(p_name, ' .(.*)$', 1) || ' ' || CAST(p_partkey AS VARCHAR) AS name, 'sitemap' AS type FROM part WHERE p_partkey % 3 <> 0""")
def sitemap_categories(spark, sf_dir):
    k = F.col("p_partkey")
    here = F.concat(F.lit("https://shop.example/catalog/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), k.cast("string"))
    xml = F.concat(F.when(k % 3 != 0, "<?xml version='1.0'?>").otherwise("<html>"), F.lit("<urlset><loc> "), here, F.lit(" </loc><loc>https://shop.example/news/1</loc></urlset>"))
    return extract.sitemap_links(read_table(spark, sf_dir, "part").select(xml.alias("xml")))


# images and reports


@query(f"WITH {IMAGES_SQL} SELECT article, CAST(idx AS BIGINT) AS idx, score AS moderation_score, score >= 0.7 AS is_approved FROM i")
def image_quality_score(spark, sf_dir):
    return longs(images.moderate(image_rows(spark, sf_dir)).select("article", "idx", "moderation_score", "is_approved"), "idx")


@query(f"WITH {IMAGES_SQL} SELECT article, CAST(arg_max(idx, (score, -idx)) AS BIGINT) AS idx, max(score) AS moderation_score FROM i WHERE score >= 0.7 GROUP BY article")
def image_main_per_product(spark, sf_dir):
    return longs(images.main_images(images.moderate(image_rows(spark, sf_dir))), "idx")


@query(f"""WITH {IMAGES_SQL}, r AS (SELECT article, idx, row_number() OVER (PARTITION BY article ORDER BY score DESC, idx) AS place FROM i WHERE score >= 0.7)
 SELECT article, CAST(idx AS BIGINT) AS idx, place FROM r""")
def image_gallery_rank(spark, sf_dir):
    out = images.moderate(image_rows(spark, sf_dir)).where("is_approved").select("article", "idx", "place")
    return longs(out, "idx", "place")


@query(f"""WITH {IMAGES_SQL} SELECT article, count(*) AS total_processed, count(*) FILTER (score >= 0.7) AS approved_count, count(*) FILTER (score < 0.7) AS rejected_count,
 round(avg(CASE WHEN score >= 0.7 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS approval_rate, round(avg(score)::DOUBLE, 6) AS average_score, max(score) FILTER (score >= 0.7) AS best_score,
 min(score) FILTER (score >= 0.7) AS worst_approved_score, max(score) FILTER (score < 0.7) AS best_rejected_score FROM i GROUP BY article""")
def moderation_summary(spark, sf_dir):
    return rounded(images.moderation_summary(images.moderate(image_rows(spark, sf_dir))), 6, "approval_rate", "average_score")


@query(f"WITH {snapshot_sql('current', 'c')} SELECT category, name, price, c_brand AS brand, c_type AS type, c_size AS size, coalesce(c_color, '') AS color FROM c")
def characteristics_pivot(spark, sf_dir):
    s = snapshot(spark, sf_dir, "current")
    return reports.wide_products(s.select("category", F.col("name").alias("description"), "price", "characteristics")).withColumnRenamed("description", "name")


@query("SELECT unnest(['brand', 'color', 'size', 'type']) AS key")
def characteristic_keys(spark, sf_dir):
    return reports.characteristic_keys(snapshot(spark, sf_dir, "current"))


@query(f"WITH {snapshot_sql('current', 'c')} SELECT name, price, NULL::VARCHAR AS price_problem, '' AS description, category, url, sku, CASE status WHEN 'in_stock' THEN 'В наличии' ELSE 'Нет в наличии' END AS availability FROM c")
def products_sheet(spark, sf_dir):
    return reports.formatted_products(snapshot(spark, sf_dir, "current").withColumn("description", F.lit(None).cast("string")))


@query(f"""WITH {COMPARE_SQL} SELECT name, sku, old_price, new_price, printf('%.2f%%', change_percent) AS change, round(change_amount, 6) + 0.0 AS change_amount,
 CASE WHEN change_amount > 0 THEN 'Увеличение' WHEN change_amount < 0 THEN 'Снижение' ELSE 'Без изменений' END AS kind, CASE WHEN significant THEN 'Да' ELSE 'Нет' END AS significant FROM k WHERE status = 'changed' AND price_changed
 UNION ALL SELECT name, sku, NULL, new_price, 'Новый товар', NULL, 'Новый товар', 'Н/Д' FROM k WHERE status = 'new'""")
def comparison_sheet(spark, sf_dir):
    return rounded(reports.comparison_sheet(_compared(spark, sf_dir)), 6, "change_amount")


@query(f"""WITH {TRENDS_SQL} SELECT product_key, CASE trend_direction WHEN 'upward' THEN '{labels.TRENDS["upward"]}' WHEN 'downward' THEN '{labels.TRENDS["downward"]}' ELSE '{labels.TRENDS["stable"]}' END AS trend,
 {r6("change_percent current_price min_price max_price volatility")}, {big("n period_days")} FROM t""")
def trend_sheet(spark, sf_dir):
    out = reports.trend_sheet(_trends(spark, sf_dir))
    return longs(rounded(out, 6, "change_percent", "current_price", "min_price", "max_price", "volatility"), "n", "period_days")


@query(f"WITH {MESSY_SQL} SELECT sku, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.sku = m.sku) THEN '❌ Невалиден' ELSE '✅ Валиден' END AS status FROM m")
def validation_sheet(spark, sf_dir):
    return reports.validation_sheet(validate.validate(_messy(spark, sf_dir))).select("sku", "status")


@query(f"""WITH {ALERTS_SQL} SELECT CASE alert_group WHEN 'price' THEN '{reports.GROUPS["price"]}' WHEN 'availability' THEN '{reports.GROUPS["availability"]}' WHEN 'trend' THEN '{reports.GROUPS["trend"]}' ELSE '{reports.GROUPS["quality"]}' END AS kind,
 level, coalesce(product, 'Общий') AS product, message FROM a""")
def alert_sheet(spark, sf_dir):
    return reports.alert_sheet(_alerts(spark, sf_dir)).select("kind", "level", "product", "message")


@query(f"WITH {snapshot_sql('current', 'c')} SELECT count(*) AS n, round(avg(price), 4) AS average_price, min(price) AS min_price, max(price) AS max_price FROM c")
def product_price_stats(spark, sf_dir):
    return rounded(reports.price_stats(snapshot(spark, sf_dir, "current")), 4, "average_price")


@query(f"WITH {SUMMARY_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(CAST({c} AS DOUBLE), 6) + 0.0 AS value FROM s" for c in f"{SUMMARY_LONGS} {SUMMARY_DOUBLES}".split()))
def summary_unpivot(spark, sf_dir):
    s = trends.trends_summary(_trends(spark, sf_dir))
    return rounded(reports.unpivot_row(s, f"{SUMMARY_LONGS} {SUMMARY_DOUBLES}".split()), 6, "value")


@query("SELECT c AS column, least(greatest(w, length(c)) + 2, 50)::BIGINT AS width FROM (SELECT 'p_name' AS c, max(length(p_name)) AS w FROM part UNION ALL SELECT 'p_brand', max(length(p_brand)) FROM part UNION ALL SELECT 'p_type', max(length(p_type)) FROM part)")
def column_widths(spark, sf_dir):
    return longs(reports.column_widths(read_table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")), "width")


@query("SELECT event_type AS error_type, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS recovered, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS recovery_rate FROM events GROUP BY event_type")
def error_stats_by_type(spark, sf_dir):
    log = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("error_type"), (F.col("event_id") % 3 == 0).alias("can_recover"))
    return rounded(reports.error_stats(log), 6, "recovery_rate")


@query("""WITH c AS (SELECT event_type AS key, ts AS created_at, ts + INTERVAL 24 HOUR AS expires_at, event_id FROM events)
 SELECT key, arg_max(event_id, (created_at, event_id)) AS event_id FROM c WHERE expires_at > TIMESTAMP '2024-01-20' AND created_at < TIMESTAMP '2024-01-20' GROUP BY key""")
def ttl_filter(spark, sf_dir):
    from ..sources.files import not_expired

    e = read_table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    stamp = F.struct(F.col("ts"), F.col("event_id"))
    cached = e.select(F.col("event_type").alias("key"), stamp.alias("created_at"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"), "event_id")
    return not_expired(cached, F.lit("2024-01-20").cast("timestamp")).select("key", "event_id")


@query("""SELECT p_partkey, substr(regexp_replace(regexp_replace(p_name || '<>:' || p_type || '/|?' || repeat(p_brand, p_size), '[<>:"/\\\\|?*]', '_', 'g'), '_+', '_', 'g'), 1, 100) AS name FROM part""")
def safe_file_name(spark, sf_dir):
    long = F.concat("p_name", F.lit("<>:"), "p_type", F.lit("/|?"), F.repeat(F.col("p_brand"), F.col("p_size")))
    return read_table(spark, sf_dir, "part").select("p_partkey", labels.file_name(long).alias("name"))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    from ..streaming.history import windowed_totals

    out = windowed_totals(read_table(spark, sf_dir, "events"))
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 4, "total")


# product pages, made out of parts so that SQL knows what they say


def _product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part, by three wrappers; the site is one host for each wrapper."""
    k, name = F.col("p_partkey"), F.col("p_name")
    price = F.concat(F.col("p_size").cast("string"), F.lit(","), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" ₽"))
    stock = F.when(k % 4 == 0, "Нет в наличии").otherwise("В наличии")
    crumbs = F.concat(F.lit("<div class='breadcrumb'><a>Home</a> / <a>"), F.col("p_type"), F.lit("</a></div>"))
    table = F.concat(F.lit("<table class='specs'><tr><td>Бренд</td><td>"), F.col("p_brand"), F.lit("</td></tr><tr><th>Вес</th><td>"), F.col("p_size").cast("string"), F.lit(" кг</td></tr></table>"))
    dl = F.concat(F.lit("<dl class='features'><dt>Бренд</dt><dd>"), F.col("p_brand"), F.lit("</dd><dt>Вес</dt><dd>"), F.col("p_size").cast("string"), F.lit(" кг</dd></dl>"))
    first = F.concat(F.lit("<h1 class='product-title'> "), name, F.lit(" </h1><span class='price'>"), price, F.lit("</span><span class='stock'>"), stock, F.lit("</span><span class='sku'>P"), k.cast("string"), F.lit("</span>"), table)
    second = F.concat(F.lit("<h1 itemprop='name'>"), name, F.lit("</h1><div class='price-box'>"), price, F.lit("</div><p class='stock-status'>"), stock, F.lit("</p><p class='product-sku'>P"), k.cast("string"), F.lit("</p>"), dl)
    third = F.concat(F.lit("<div class='product-name'><h1>"), name, F.lit("</h1></div><b data-price='1'>"), price, F.lit("</b><i data-in-stock='1'>"), stock, F.lit("</i><u data-product-id='1'>P"), k.cast("string"), F.lit("</u>"), table)
    body = F.when(k % 3 == 0, first).when(k % 3 == 1, second).otherwise(third)
    url = F.concat(F.lit("https://site"), (k % 3).cast("string"), F.lit(".example/item/"), k.cast("string"))
    return read_table(spark, sf_dir, "part").select(k.alias("page_id"), url.alias("url"), F.concat(F.lit("<html><body>"), crumbs, body, F.lit("</body></html>")).alias("html"))


@query("""SELECT p_partkey AS page_id, p_name AS name, CAST(p_size || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS price, 'P' || CAST(p_partkey AS VARCHAR) AS sku,
 CASE WHEN p_partkey % 4 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS status, 'Home > ' || p_type AS category, p_brand AS brand, CAST(round(p_size * 1000.0::DOUBLE, 2) AS VARCHAR) AS weight FROM part""")
def html_extract_product(spark, sf_dir):
    pages = _product_pages(spark, sf_dir)
    out = extract.extract_products(pages, extract.site_selectors(pages))
    traits = F.col("characteristics")
    return out.select("page_id", "name", "price", "sku", F.col("availability.status").alias("status"), "category", traits["manufacturer"].alias("brand"), traits["weight"].alias("weight"))


@query("""WITH s AS (SELECT 0 AS m, 'h1[class*=title]' AS n, 'span[class*=price]' AS p, 'span[class*=stock]' AS a, 'span[class*=sku]' AS u, 'table[class*=specs]' AS c
 UNION ALL SELECT 1, 'h1[itemprop=name]', 'div[class*=price]', '.stock-status', '.product-sku', 'dl[class*=features]'
 UNION ALL SELECT 2, 'div[class*=product-name] h1', '[data-price]', '[data-in-stock]', '[data-product-id]', 'table[class*=specs]')
 SELECT p_partkey AS page_id, unnest(['product_name', 'price', 'availability', 'sku', 'characteristics']) AS field, unnest([n, p, a, u, c]) AS selector FROM part JOIN s ON m = p_partkey % 3""")
def selector_detect(spark, sf_dir):
    return extract.detect_selectors(_product_pages(spark, sf_dir)).select("page_id", F.explode("selectors").alias("field", "selector"))


def _listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of six parts each, by brand: .../brand?page=n, from 1; some lack a link or a name."""
    k = F.col("p_partkey")
    item = F.concat(
        F.lit("<div class='product'>"), F.when(k % 10 != 0, F.concat(F.lit("<h3>"), F.col("p_name"), F.lit("</h3>"))).otherwise("<p>none</p>"),
        F.when(k % 7 != 0, F.concat(F.lit("<a href='/item/"), k.cast("string"), F.lit("'>x</a>"))).otherwise("<a>x</a>"),
        F.lit("<span class='price'>"), F.col("p_size").cast("string"), F.lit(" $</span></div>"),
    )
    parts = read_table(spark, sf_dir, "part").withColumn("n", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    page = F.floor(F.col("n") / 6)
    per = parts.groupBy("p_brand", page.alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"]), "").alias("items"), F.min("p_partkey").alias("page_id"))
    url = F.concat(F.lit("https://shop.example/catalog/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("?page="), (F.col("page") + 1).cast("string"))
    return per.select("page_id", url.alias("url"), F.concat(F.lit("<html>"), "items", F.lit("</html>")).alias("html"))


LISTING_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part),
 g AS (SELECT *, n // 6 AS page, min(p_partkey) OVER (PARTITION BY p_brand, n // 6) AS page_id FROM n),
 i AS (SELECT page_id, p_brand, page + 1 AS page_number, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) AS position, p_name AS name,
 'https://shop.example/item/' || CAST(p_partkey AS VARCHAR) AS url, CAST(p_size AS DOUBLE) AS price FROM g WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0)"""


@query(f"WITH {LISTING_SQL} SELECT page_id, position, name, url, price, true AS category_page_data FROM i")
def listing_products(spark, sf_dir):
    return longs(extract.listing_products(_listing_pages(spark, sf_dir)).drop("image_url"), "position")


@query(f"WITH {LISTING_SQL} SELECT 'https://shop.example/catalog/' || replace(p_brand, '#', '-') AS category_url, page_number, position, name, url FROM i WHERE page_number <= 10")
def category_scan(spark, sf_dir):
    return longs(extract.category_scan(_listing_pages(spark, sf_dir)).select("category_url", "page_number", "position", "name", "url"), "position", "page_number")


@query(f"""WITH {snapshot_sql('current', 'c')} SELECT count(*) AS total, count(*) FILTER (p_partkey % 3 > 0) AS with_article, count(*) FILTER (p_partkey % 3 = 0) AS without_article,
 count(*) FILTER (n_images > 0) AS with_images, CAST(sum(n_images) AS BIGINT) AS images FROM c""")
def work_stats(spark, sf_dir):
    k = F.col("p_partkey")
    article = F.when(k % 3 == 1, "A1").when(k % 3 == 2, "B").otherwise(F.when(k % 2 == 0, ""))
    return reports.work_stats(snapshot(spark, sf_dir, "current").withColumn("article", article))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(substr(p_type, 1, 3)) || '-UNK-' || upper(substr(md5(p_name || CAST(p_size AS VARCHAR)), 1, 4))
 ELSE 'GEN-' || upper(substr(md5(p_name || p_type || 'size=' || CAST(p_size AS VARCHAR) || ';'), 1, 8)) END AS article FROM part""")
def article_by_strategy(spark, sf_dir):
    traits = F.create_map(F.lit("size"), F.col("p_size").cast("string"))
    made = {s: ids.article(s, F.col("p_name"), F.col("p_type"), F.lit(""), traits, F.col("p_size").cast("string")) for s in ("composite", "hash")}
    chosen = F.when(F.col("p_partkey") % 2 == 0, made["composite"]).otherwise(made["hash"])
    return read_table(spark, sf_dir, "part").select("p_partkey", chosen.alias("article"))


# pictures of two by two pixels, red by red number, so that SQL can tell each


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    bytes_ = [F.lpad(F.hex((k + 17 * i) % 256), 2, "0") for i in range(12)]
    return read_table(spark, sf_dir, "part").select(k.alias("id"), F.lit(2).alias("width"), F.lit(2).alias("height"), F.unhex(F.concat(*bytes_)).alias("pixels"))


def pixels_sql(positions: Sequence[int], value: str = "v") -> str:
    return f"array_to_string(list_transform([{', '.join(map(str, positions))}], lambda i: lpad(upper(hex({value.replace('v', '((p_partkey + 17 * i) % 256)')})), 2, '0')), '')"


@query(f"SELECT p_partkey AS id, CAST(1 AS BIGINT) AS width, CAST(2 AS BIGINT) AS height, {pixels_sql([3, 4, 5, 9, 10, 11])} AS pixels FROM part")
def image_crop(spark, sf_dir):
    return longs(pixels.crop(_pictures(spark, sf_dir), 1, 0, 1, 2).withColumn("pixels", F.hex("pixels")), "width", "height")


@query(f"SELECT p_partkey AS id, CAST(4 AS BIGINT) AS width, CAST(2 AS BIGINT) AS height, {pixels_sql([0, 1, 2, 0, 1, 2, 3, 4, 5, 3, 4, 5, 6, 7, 8, 6, 7, 8, 9, 10, 11, 9, 10, 11])} AS pixels FROM part")
def image_resize(spark, sf_dir):
    return longs(pixels.resize(_pictures(spark, sf_dir), 4, 2, keep_shape=False).withColumn("pixels", F.hex("pixels")), "width", "height")


@query(f"SELECT p_partkey AS id, {pixels_sql(range(12), 'least(255, v + 40)')} AS pixels FROM part")
def image_brightness(spark, sf_dir):
    return pixels.adjust(_pictures(spark, sf_dir), brightness=40).select("id", F.hex("pixels").alias("pixels"))


# what SQL cannot express; tests/test_models.py holds these against plain models


@query()
def similarity_ratio(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    return b.select("item_id", rewrite.similarity("text", X.preprocess(F.col("text"))).alias("similarity"))


@query()
def rewrite_description(spark, sf_dir):
    return rewrite.rewrite(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def box_nms(spark, sf_dir):
    k = F.col("p_partkey")
    boxes = read_table(spark, sf_dir, "part").select(
        (k % 100).alias("image"), k.alias("box_id"), (k * 7 % 50).alias("x"), (k * 13 % 50).alias("y"), (k % 17 + 10).alias("w"), (k % 19 + 10).alias("h"), (k * 31 % 101 / 100).alias("confidence")
    )
    return images.non_overlapping(boxes)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
 SELECT event_type, user_id, count(*) AS n, max(event_id) FILTER (rn = 1) AS newest_id FROM e WHERE rn <= 3 GROUP BY 1, 2""")
def stream_history_retention(spark, sf_dir):
    """The stream's state after all events: run to the end into a table, whose newest row of each key counts."""
    import uuid

    from ..streaming.history import bounded_history
    from .tables import shared_folder

    table = read_table(spark, sf_dir, "events")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    out = f"{shared_folder(spark)}/quarryline/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/updates/batch_{number}")

    running = bounded_history(stream, 3).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    updates = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/updates")
    newest = updates.groupBy("event_type", "user_id").agg(F.max_by(F.struct("n", "newest_id"), "batch").alias("r"))
    return newest.select("event_type", "user_id", "r.n", "r.newest_id")
