from datetime import date

import pytest
from pyspark.sql import functions as F

from quarryline.functions import dom
from quarryline.operators import alerts, compare, extract, filters, images, pixels, reports, rewrite, trends, validate

PAGE = """<html><head><meta name="description" content="Good lamp"><meta property="og:title" content="Lamp"></head><body>
<div class="breadcrumb"><a>Home</a> <a>Lamps</a></div><h1 class="product-title">  Desk
 lamp </h1><span class="price-now">1 299,50 ₽</span><span class="stock">Нет в наличии, 0 шт</span><span class="sku-no">A-17 №</span>
<div class="rating">★★★★</div><table class="specs"><tr><td>Вес</td><td>2 кг</td></tr><tr><th>Цвет</th><td>Белый</td></tr></table>
<img src="/img/product/1.jpg"><img src="/img/logo.png"><img src="item2.jpg"></body></html>"""
LIST = """<div class="pagination"><a href="?page=1">1</a><a href="?page=2">2</a></div>
<div class="card-item"><h3>One</h3><span class="price">10,5</span><a href="/p/1">go</a><img src="/i/1.png"></div>
<div class="card-item"><h3>Two</h3><a href="/p/2">go</a></div><div class="card-item"><h3>No link</h3></div>"""


def test_selectors():
    root = dom.parse("<div id=a class='x y'><p data-k='abc'>t<b>u</b></p></div><p>v")
    pick = lambda s: [e.text() for e in root.select(s)]
    assert pick("div.x.y p") == pick("#a [data-k*=b]") == pick("p[data-k=abc]") == ["tu"] and pick("p") == ["tu", "v"] and pick("i") == []


def test_product_page(spark):
    pages = spark.createDataFrame([(1, "https://s.x/lamps/a.html", PAGE), (2, "https://s.x/b", None)], "page_id long, url string, html string")
    for wrappers in (None, extract.site_selectors(pages)):
        r = {x.page_id: x for x in extract.extract_products(pages, wrappers).collect()}
        a = r[1]
        assert (a.name, a.price, a.category, a.sku, a.rating, a.description) == ("Desk lamp", 1299.5, "Home > Lamps", "A-17", 4.0, "Good lamp")
        assert (a.availability.status, a.availability.quantity) == ("out_of_stock", 0)
        assert a.images == ["https://s.x/img/product/1.jpg", "https://s.x/lamps/item2.jpg"]
        assert a.characteristics == {"weight": "2000.0", "color": "white"} and a.metadata["og:title"] == "Lamp"
        assert r[2].name is None and r[2].availability.status == "unknown"
    assert extract.detect(PAGE)["product_name"] == "h1[class*=title]"
    assert extract.detect("<b>5 руб</b>")["price"] == "b[class*=price]"


def test_listing_and_paging(spark):
    pages = spark.createDataFrame([(1, "https://s.x/c?page=1", LIST)], "page_id long, url string, html string")
    got = [tuple(r) for r in extract.listing_products(pages).orderBy("position").collect()]
    assert got == [(1, 1, "One", "https://s.x/p/1", 10.5, "https://s.x/i/1.png", True), (1, 2, "Two", "https://s.x/p/2", None, None, True)]
    assert extract.next_pages(pages).first().next_url == "https://s.x/c?page=2"
    assert extract.next_page("<a href='/n'>Далее</a>", "https://s.x/c") == "https://s.x/n" and extract.next_page("", "https://s.x") is None


def test_images_and_pairs_by_regex(spark):
    df = spark.createDataFrame([(PAGE,)], "html string")
    r = df.select(extract.image_links(F.col("html"), F.lit("https://s.x/lamps/a.html")).alias("i"), extract.meta_map(F.col("html")).alias("m"), extract.text_pairs(F.lit("Вес: 5 кг\nЦвет - белый")).alias("p")).first()
    assert r.i == ["https://s.x/img/product/1.jpg", "https://s.x/lamps/item2.jpg"] and r.m["description"] == "Good lamp" and r.p == {"Вес": "5 кг", "Цвет": "белый"}


def test_trends_of_short_flat_and_broken_series(spark):
    rows = [("up", date(2024, 1, d), float(d)) for d in range(1, 8)] + [("flat", date(2024, 1, d), 5.0) for d in range(1, 6)]
    rows += [("one", date(2024, 1, d), 5.0 if d == 3 else None) for d in range(1, 6)] + [("two", date(2024, 1, d), 5.0 + d if d > 3 else None) for d in range(1, 6)]
    rows += [("zero", date(2024, 1, d), 0.0) for d in range(1, 6)] + [("few", date(2024, 1, 1), 1.0)] + [("day", date(2024, 1, 1), float(k)) for k in range(5)]
    t = {r.product_key: r for r in trends.product_trends(spark.createDataFrame(rows, "product_key string, date date, price double"), tie=["price"]).collect()}
    assert {k: r.trend_direction for k, r in t.items()} == {"up": "upward", "flat": "stable", "one": "insufficient_data", "two": "uncertain", "zero": "stable", "day": "upward"}
    assert t["up"].change_percent == pytest.approx(600) and t["up"].period_days == 6 and t["one"].change_percent is None and t["zero"].change_percent == 0
    f = {r.product_key: r for r in trends.forecast(trends.product_trends(spark.createDataFrame(rows, "product_key string, date date, price double"), tie=["price"])).collect()}
    assert f["day"].predicted_price is None and f["flat"].predicted_price == 5.0 and "one" not in f and f["up"].predicted_price == pytest.approx(7 * 8)


def test_comparison_of_nulls_zeros_and_maps(spark):
    kind = "name string, sku string, url string, price double, status string, images array<string>, characteristics map<string,string>"
    cur = spark.createDataFrame([("a", None, "u", 0.0, None, None, {"k": "1"}), ("b", "s", "u", None, "in_stock", [], {}), ("c", "s", "u", 5.0, "in_stock", ["i"], None), ("n", "s", "u", 1.0, None, [], {})], kind)
    prev = spark.createDataFrame([("a", None, "u", 0.0, "unknown", [], {"k": "2"}), ("b", "s", "u", 3.0, "in_stock", [], {}), ("c", "s", "u", -5.0, "in_stock", [], {}), ("g", "s", "u", 1.0, None, [], {})], kind)
    got = {r.name: r for r in compare.compare(cur, prev).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "changed", "b": "unchanged", "c": "changed", "n": "new", "g": "discontinued"}
    assert got["c"].change_percent == 200 and got["a"].change_percent == 0 and got["a"].direction == "unchanged" and got["b"].change_percent == 0
    changes = sorted((r.name, r.field, r.old_value, r.new_value) for r in compare.change_list(compare.compare(cur, prev)).collect())
    assert changes == [("a", "characteristic_k", "2", "1"), ("c", "price", "-5.0", "5.0")]
    assert compare.compare(cur.limit(0), prev.limit(0)).count() == 0


def test_price_alerts_print_halves_as_sql(spark):
    kind = "name string, sku string, url string, price double, status string, images array<string>, characteristics map<string,string>"
    row = lambda name, price: (name, "s", "u", price, "in_stock", [], {})
    compared = compare.compare(spark.createDataFrame([row("a", 493.0), row("b", 215.0)], kind), spark.createDataFrame([row("a", 400.0), row("b", 400.0)], kind))
    assert {r.product: r.message for r in alerts.price_alerts(compared).collect()} == {"a": alerts.PRICE % 23.25, "b": alerts.PRICE % -46.25}
    assert alerts.PRICE % 23.25 == "Значительное изменение цены: 23.2%"


def test_quality_alerts_and_the_sheet_print_halves_as_sql(spark):
    metrics = spark.createDataFrame([(0.625, 3, 8)], "quality_score double, invalid_products long, total_products long")
    found = alerts.quality_alerts(metrics)
    assert [r.message for r in found.where("type = 'DATA_QUALITY'").collect()] == [alerts.QUALITY % 0.625] == ["Низкое качество данных: 0.62"]
    assert {(r.kind, r.product, r.message) for r in reports.alert_sheet(found).collect()} == {
        (reports.GROUPS["quality"], "Общий", m) for m in (alerts.QUALITY % 0.625, alerts.INVALID % (3, 8))}


def test_validation_of_missing_columns_and_long_values(spark):
    kind = "name string, price double, url string, images array<string>, characteristics map<string,string>"
    rows = [("Good", 1.0, "https://a.b/c", ["https://a.b/c.jpg"], {"k": "v"}), (None, None, None, None, None), ("x" * 501, 2e7, "https://a.b/" + "c" * 2000, ["bad", "https://a.b/c.tif"] * 11, {"k" * 101: "v" * 501})]
    v = validate.validate(spark.createDataFrame(rows, kind)).collect()
    codes = [([e.code for e in r.errors], [w.code for w in r.warnings]) for r in v]
    assert codes[0] == ([], []) and codes[1][0] == ["missing:name", "missing:price", "missing:url", "price_null"]
    assert codes[2][0] == ["image_format"] * 11 and set(codes[2][1]) == {"name_long", "price_high", "url_long", "images_many", "image_extension", "key_long", "value_long"}
    assert validate.validate(spark.createDataFrame([("n",)], "name string")).first().is_valid is False
    assert validate.quality_metrics(validate.validate(spark.createDataFrame([], kind))).first().quality_score == 0.0


def test_filters(spark):
    df = spark.createDataFrame([(1, None, None, {"w": "5 kg"}), (2, 10.0, "Lamps", {"w": "15 kg", "c": "Red"}), (3, 0.0, "Desks", None)], "i int, price double, category string, traits map<string,string>")
    ids = lambda c: [r.i for r in df.where(c).orderBy("i").collect()]
    assert ids(filters.price_between(F.col("price"), 0, 5)) == [1, 3] and ids(filters.price_between(F.col("price"))) == [1, 2, 3]
    assert ids(filters.category_any(F.col("category"), ["lamp"])) == [2] and ids(filters.category_any(F.col("category"), [])) == [1, 2, 3]
    assert ids(filters.characteristics_match(F.col("traits"), "w:10-20,c:red")) == [2] and filters.parse_spec("a:1-2, b:x") == {"a": "1-2", "b": "x"}


def test_boxes(spark):
    rows = [(1, 1, 0, 0, 10, 10, 0.9), (1, 2, 1, 1, 10, 10, 0.8), (1, 3, 50, 50, 5, 5, 0.7), (2, 4, 1, 1, 10, 10, 0.1)]
    df = spark.createDataFrame(rows, "image long, box_id long, x long, y long, w long, h long, confidence double")
    assert sorted(r.box_id for r in images.non_overlapping(df).collect()) == [1, 3, 4]
    box = lambda *v: dict(zip("xywh", map(F.lit, v), strict=True))
    r = spark.range(1).select(images.iou(box(0, 0, 10, 10), box(5, 0, 10, 10)).alias("a"), images.iou(box(0, 0, 1, 1), box(5, 5, 1, 1)).alias("b")).first()
    assert r.a == pytest.approx(1 / 3) and r.b == 0


def test_picture_headers_and_pixels(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x06\x01\x01\x11\x00"
    assert images.parse_header(png) == ("png", 7, 9) and images.parse_header(jpg) == ("jpeg", 6, 5) and images.parse_header(b"GIF89a\x02\x00\x03\x00") == ("gif", 2, 3) and images.parse_header(b"no") == (None, None, None)
    px = bytes(range(4 * 2 * 3))
    df = spark.createDataFrame([(1, 4, 2, bytearray(px))], pixels.SCHEMA)
    r = pixels.crop(df, 1, 0, 2, 1).first()
    assert (r.width, r.height, bytes(r.pixels)) == (2, 1, px[3:9])
    assert (pixels.resize(df, 2, 2).first().width, pixels.resize(df, 2, 2).first().height) == (2, 1)
    assert bytes(pixels.adjust(df).first().pixels) == px and max(pixels.adjust(df, brightness=255).first().pixels) == 255


def test_rewriting_is_seeded_and_keeps_terms(spark):
    text = "Новый большой стол. Вес 5 кг точно. Красивый дом, старый сад и важный полезный удобный день. Хороший день!"
    df = spark.createDataFrame([(i, text) for i in range(30)], "id long, text string")
    one, two = rewrite.rewrite(df).collect(), rewrite.rewrite(df).collect()
    assert one == two and {r.rewritten for r in rewrite.rewrite(df, seed=9).collect()} != {r.rewritten for r in one}
    assert all("Вес 5 кг точно." in r.rewritten for r in one) and len({r.rewritten for r in one}) > 5
    assert rewrite.rewrite(spark.createDataFrame([(1, ""), (2, None)], "id long, text string")).count() == 2


def test_rewriting_checks(spark):
    df = spark.createDataFrame([(1, "Новый дом стоит тут.", "Современный дом стоит здесь."), (2, "a", "a"), (3, "", "")], "id long, text string, rewritten string")
    r = {x.id: x for x in rewrite.check_rewriting(df).collect()}
    assert 0.3 < r[1].similarity < 0.9 and r[2].similarity == 1.0 and r[3].ratio == 1.0 and not r[2].is_valid
    assert r[2].recommendation.startswith("Рекомендации: Уменьшить схожесть")
    t = rewrite.add_synonyms(spark.createDataFrame([("a", ["x"])], "word string, synonyms array<string>"), spark.createDataFrame([("A", ["x", "y"]), ("b", ["z"])], "word string, synonyms array<string>"))
    assert {x.word: list(x.synonyms) for x in t.collect()} == {"a": ["x", "y"], "b": ["z"]}


def test_wide_sheet_and_widths(spark):
    df = spark.createDataFrame([("c", 1.0, {"b": "1", "a": "2"}), ("d", 2.0, {"z": "3"})], "category string, price double, characteristics map<string,string>")
    wide = reports.wide_products(df)
    assert wide.columns == ["category", "price", "a", "b", "z"] and [r.z for r in wide.orderBy("category").collect()] == ["", "3"]
    with pytest.raises(ValueError, match="more than 2"):
        reports.wide_products(df, most=2)
    assert {r["column"]: r.width for r in reports.column_widths(spark.createDataFrame([("x" * 80, "y")], "a string, long_name string")).collect()} == {"a": 50, "long_name": 11}
