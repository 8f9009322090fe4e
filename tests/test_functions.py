"""Scalar functions on tables of cases and against small models."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import ids, labels, measures, sql, urls
from quarryline.functions import text as X


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = {
    "price": (measures.price, [("1 299,50 руб", 1299.5), ("$1,299.00", 1.299), ("none", None), ("", None), (None, None), ("от 5", 5.0)]),
    "price_locale": (measures.price_locale, [("1,299.00", 1299.0), ("1.299,00 €", 1299.0), ("1299", 1299.0), ("12,5", 12.5), ("no", None)]),
    "weight": (measures.weight_g, [("2 кг", 2000.0), ("1,5kg", 1500.0), ("3 lb", 1360.78), ("10 oz", 283.5), ("7", 7.0), ("7 pud", 7.0), ("x", None)]),
    "volume": (measures.volume_l, [("500 мл", 0.5), ("2 м3", 2000.0), ("2m³", 2000.0), ("1 gal", 3.785), ("3", 3.0), ("x", None)]),
    "length": (measures.length_mm, [("10 см", 100.0), ("2 m", 2000.0), ("1 foot", 304.8), ("5", 5.0), ("-", None)]),
    "color": (measures.color, [("Черный", "black"), (" teal ", "teal"), (None, None)]),
    "availability": (measures.availability_status, [("Нет в наличии", "out_of_stock"), ("Есть в наличии", "in_stock"), ("unavailable", "out_of_stock"), ("Available", "in_stock"), ("soon", "unknown")]),
    "rating": (measures.rating, [("4,5 из 5", 4.5), ("★★★", 3.0), ("none", None), (None, None)]),
    "sku": (measures.sku, [("Арт № 12-3_x!", "Арт12-3_x"), ("!!", None)]),
    "key": (measures.key, [(" Вес ", "weight"), ("Brand", "manufacturer"), ("Foo", "foo")]),
    "collapse": (X.collapse, [("  a \n b\t", "a b"), (" ", None), (None, None)]),
    "shouting": (X.title_if_shouting, [("НОВЫЙ дом", "НОВЫЙ дом"), ("НОВЫЙ ДОМ", "Новый Дом"), ("123", "123")]),
    "preprocess": (X.preprocess, [("Ёлка №5!!! ок...", "Ёлка 5! ок..."), ("a??b  c", "a?b c"), ("x@#y", "xy")]),
    "readability": (X.readability, [("a b c. d e f.", 1.35), (" ... ", 0.0), ("", 0.0), (" ".join(["w"] * 40), 0.0)]),
    "grammar": (X.grammar_issues, [("Aa. Bb.", 2), ("aa", 1), ("Aa  bb", 1), ("", 0)]),
    "grammar_intent": (lambda c: X.grammar_issues(c, compat=False), [("Aa. Bb.", 0), ("Aa", 1), ("aa.", 1)]),
    "correct": (X.correct_grammar, [("привет.мир", "Привет. Мир."), ("a  b! c?", "A b! C?"), ("", "")]),
    "terms": (X.technical_terms, [("Вес 5 кг", ["5 кг", "Вес"]), ("", []), ("веский довод", [])]),
    "site": (urls.site_key, [("https://a.b/c", "a.b"), ("a.b/c", "a.b")]),
    "page": (urls.page_number, [("http://x/?page=12", 12), ("http://x/Page/3", 3), ("http://x", 1)]),
    "category_name": (urls.category_name, [("http://x/hand-tools_a/", "Hand Tools A"), ("http://x", "X")]),
    "subdomain": (urls.subdomain, [("http://a.b.c.d/x", "a.b"), ("http://c.d", ""), ("http://localhost", "")]),
    "domain": (urls.registered_domain, [("http://a.b.c.d/x", "c.d"), ("http://localhost", "")]),
    "problem": (urls.problem, [("http://a.b", None), ("ftp://a.b", "bad_scheme"), ("x", "no_host"), (None, "no_host")]),
    "name": (labels.name, [(None, "Без названия"), ("", "Без названия"), (" a  b ", "a b"), ("x" * 201, "x" * 197 + "...")]),
    "label": (labels.availability, [("in_stock", "В наличии"), (None, "Неизвестно"), ("odd", "odd")]),
    "trait": (labels.characteristic, [("some_key", "Some key"), ("", "Характеристика")]),
    "file": (labels.file_name, [('a<b>:"c', "a_b_c"), ("x" * 120, "x" * 100)]),
    "prefix": (ids.category_prefix, [("Игровой ноутбук", "NB"), ("Мебель", "FRN"), ("x", "GEN")]),
    "brand": (ids.brand, [("New SAMSUNG tv", "samsung"), ("x", "UNK")]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    f, rows = CASES[name]
    got = apply(spark, f, [v for v, _ in rows])
    assert got == pytest.approx([w for _, w in rows]) if isinstance(rows[0][1], float) and None not in got else got == [w for _, w in rows]


@pytest.mark.parametrize("text, want", [("10x20x30 см", (100.0, 200.0, 300.0)), ("1,5 × 2 m", (1500.0, 2000.0, None)), ("7", (7.0, None, None)), ("-", (None, None, None))])
def test_dimensions(spark, text, want):
    assert tuple(apply(spark, measures.dimensions_mm, [text])[0]) == want


def test_maps(spark):
    got = apply(spark, measures.normalize_map, [{"Вес": "2 кг", "weight": "3 kg", "Цвет": "белый", "объем": "?", "Материал": "СТАЛЬ"}, {}, None], "map<string,string>")
    assert got == [{"weight": "3000.0", "color": "white", "material": "Сталь"}, {}, None]
    a = apply(spark, lambda m: ids.hash_article(F.lit("n"), F.lit("c"), m), [{"a": "1", "b": "2"}, {"b": "2", "a": "1"}], "map<string,string>")
    assert a[0] == a[1] and a[0].startswith("GEN-") and len(a[0]) == 12


def test_resolve(spark):
    page = F.lit("https://h.x/a/b.html?q#f")
    got = apply(spark, lambda h: urls.resolve(h, page), ["http://z/1", "//cdn/2", "/three", "four"])
    assert got == ["http://z/1", "https://cdn/2", "https://h.x/three", "https://h.x/a/four"]


def test_sql_functions(spark):
    names = sql.register(spark)
    assert len(names) == len(sql.BODIES)
    r = spark.sql("select price_parse('1 299,5 р') p, text_collapse(' a  b ') t, sku_clean('№ а-1') s, url_host('https://a.b/c') h, page_number('x?page=4') n, availability_status('Нет в наличии') a").first()
    assert tuple(r) == (1299.5, "a b", "а-1", "a.b", 4, "out_of_stock")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("0123456789.,  руб$"), max_size=12), min_size=1, max_size=20))
def test_price_equals_a_model(spark_once, texts):
    import re

    def model(t):
        clean = re.sub(r"[^\d,.]", "", t).replace(",", ".")
        m = re.search(r"\d+\.?\d*", clean)
        return float(m[0]) if m else None

    assert apply(spark_once, measures.price, texts) == [model(t) for t in texts]


@pytest.fixture(scope="module")
def spark_once(spark):
    return spark


def test_numbers_are_printed_by_their_exact_value(spark):
    xs = [0.125, 0.375, -33.125, 15.45, 23.25, 1.005, 2.675, 99.995, -0.001, -0.0, 0.0, 1e-300, 2.0**45 + 0.375, -(2.0**52) - 0.5, 2.0**53 + 2, 9.1e18]
    for digits in (1, 2):
        assert apply(spark, lambda c, t=f"a %.{digits}f%%": X.printf(t, c), [*xs, None], "double") == [*(f"a {x:.{digits}f}%" for x in xs), None]
    assert apply(spark, labels.percent, [0.125, 15.625, -33.125], "double") == ["0.12%", "15.62%", "-33.12%"]


def test_analysis_and_lemmas(spark):
    got = apply(spark, X.analyze, ["Вес 5 кг, да. Ok?! end", "", None])
    assert [(s.text, s.tokens, s.n_words, s.n_numbers) for s in got[0]] == [
        ("Вес 5 кг, да.", ["Вес", "5", "кг", ",", "да", "."], 4, 1), ("Ok?!", ["Ok", "?", "!"], 1, 0), ("end", ["end"], 1, 0)]
    assert got[1] == [] and got[2] is None
    table = F.create_map(F.lit("дома"), F.lit("дом"))
    assert apply(spark, lambda c: X.lemma(c, table), ["Дома", "x"]) == ["дом", "x"] and apply(spark, X.lemma, ["x"]) == ["x"]


def test_retries():
    from quarryline.plans.retry import error_event, retry

    calls, waits = [], []

    @retry(times=3, sleep=waits.append)
    def fails(until):
        calls.append(1)
        if len(calls) < until:
            raise ConnectionError("no")
        return len(calls)

    assert fails(3) == 3 and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(ConnectionError):
        fails(9)
    assert len(calls) == 4
    assert error_event(ValueError("x"), step="a")["can_recover"] is False
