"""The scalar functions as SQL functions, thin wrappers over the Column forms."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: SQL bodies by signature; each is the Column function's expression.
BODIES = {
    "price_parse(s STRING) RETURNS DOUBLE": r"try_cast(nullif(regexp_extract(replace(regexp_replace(s, '[^\\d,.]', ''), ',', '.'), '(\\d+\\.?\\d*)', 1), '') AS DOUBLE)",
    "text_collapse(s STRING) RETURNS STRING": r"nullif(trim(regexp_replace(s, '\\s+', ' ')), '')",
    "sku_clean(s STRING) RETURNS STRING": r"nullif(regexp_replace(s, '[^\\p{L}\\p{N}_-]', ''), '')",
    "url_host(s STRING) RETURNS STRING": r"nullif(regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '')",
    "page_number(s STRING) RETURNS INT": r"coalesce(try_cast(nullif(regexp_extract(s, '(?i)page[=/]?(\\d+)', 1), '') AS INT), 1)",
    "availability_status(s STRING) RETURNS STRING": r"CASE WHEN lower(s) RLIKE 'нет в наличии|распродано|out of stock|sold out|unavailable' THEN 'out_of_stock' WHEN lower(s) RLIKE 'в наличии|есть|available|in stock|на складе' THEN 'in_stock' ELSE 'unknown' END",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to spark.sql for this session; returns their names."""
    for signature, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in BODIES]
