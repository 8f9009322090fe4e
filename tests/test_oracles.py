"""Every query with SQL, against DuckDB."""

from datetime import datetime

import pytest
from oracle import connect, differences

from quarryline.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, con):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) == ""


def test_alert_sheet_equals_sql_at_halves_and_long_percents(spark, tmp_path):
    prices = {1: (400.0, 493.0), 2: (400.0, 215.0), 3: (400.0, 401.0), 4: (None, 5.0), 5: (0.01, 200000000.07), 6: (5.0, None), 13: (400.0, 469.0), 17: (400.0, 471.0), 19: (400.0, 400.0)}
    lines = [(k, 2.0, 2 * p, datetime(1999, 1, d)) for k in prices for d, p in enumerate((10.0, 20.0, 10.0, 20.0), 1)]
    lines += [(k, 2.0, 2 * p, datetime(y, 6, 1)) for k, both in prices.items() for y, p in zip((2000, 2001), both, strict=True) if p is not None]
    spark.createDataFrame([(k, f"part {k}", "b", "t", 1) for k in prices], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    sheet = QUERIES["alert_sheet"](spark, str(tmp_path))
    assert differences(sheet, connect(tmp_path), ORACLE_SQL["alert_sheet"]) == ""
    found = {(r["product"], r["message"].split(": ")[-1]) for r in sheet.collect()}
    assert {("part 1", "23.2%"), ("part 2", "-46.2%"), ("part 13", "17.2%"), ("part 17", "17.8%"), ("Общий", "0.62"), ("Общий", "3 из 8")} <= found
