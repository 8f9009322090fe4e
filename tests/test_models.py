"""Queries that SQL cannot express, against plain models over their whole tables."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import alerts, compare, rewrite
from quarryline.plans.queries import ORACLE_SQL, QUERIES
from quarryline.sources import files


def test_similarity_equals_the_ratio(spark, sf_dir):
    texts = {r.item_id: (r.text, r.clean) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text", X.preprocess(F.col("text")).alias("clean")).collect()}
    for r in QUERIES["similarity_ratio"](spark, sf_dir).collect():
        assert r.similarity == SequenceMatcher(None, *texts[r.item_id]).ratio()


def test_boxes_equal_greedy_suppression(spark, sf_dir):
    keys = [r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()]
    per = {}
    for k in keys:
        per.setdefault(k % 100, []).append((-(k * 31 % 101 / 100), k, k * 7 % 50, k * 13 % 50, k % 17 + 10, k % 19 + 10))
    want = set()
    for boxes in per.values():
        kept = []
        for b in sorted(boxes):
            def overlap(c):
                w, h = min(b[2] + b[4], c[2] + c[4]) - max(b[2], c[2]), min(b[3] + b[5], c[3] + c[5]) - max(b[3], c[3])  # noqa: B023
                both = max(w, 0) * max(h, 0)
                return both / (b[4] * b[5] + c[4] * c[5] - both)  # noqa: B023
            if all(overlap(c) <= 0.3 for c in kept):
                kept.append(b)
        want |= {b[1] for b in kept}
    assert {r.box_id for r in QUERIES["box_nms"](spark, sf_dir).collect()} == want and len(want) < len(keys)


def test_rewriting_keeps_words_but_for_synonyms_and_openers(spark):
    rows = [(i, f"Новый большой стол. Хороший дом, красивый сад {i}. Модель X{i} весит 5 кг! Быстрый и удобный?") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r.id: r.rewritten for r in rewrite.rewrite(df).collect()}
    assert out == {r.id: r.rewritten for r in rewrite.rewrite(df.repartition(5)).collect()}  # a function of id and place alone
    fixed = {s: w for w, own in rewrite.SYNONYMS.items() for s in own}
    changed = 0
    for i, text in rows:
        plain = lambda t: sorted(fixed.get(w, w) for w in t.lower().replace(".", " ").replace(",", " ").replace("!", " ").replace("?", " ").split())
        more = list(plain(out[i]))
        for w in plain(text):
            assert w in more, (w, out[i])
            more.remove(w)
        assert all(fixed.get(w, w) in {fixed.get(o, o) for o in rewrite.OPENERS} for w in more)
        assert "5 кг" in out[i]
        changed += out[i] != text
    assert changed > 50


def test_one_row_a_key_by_order_and_without_keys(spark):
    kind = "name string, sku string, url string, price double, status string, images array<string>, characteristics map<string,string>, seq int"
    row = lambda name, price, seq: (name, None, None, price, "in_stock", [], {}, seq)
    cur = spark.createDataFrame([row("a", 5.0, 2), row("a", 9.0, 1), row(None, 1.0, 1), row(None, 2.0, 2), row(None, 7.0, 0)], kind)
    prev = spark.createDataFrame([row("a", 4.0, 1), row("a", 3.0, 2), row(None, 2.0, 1)], kind)
    got = sorted((r.name, r.old_price, r.new_price) for r in compare.compare(cur, prev, order=["seq"]).collect())
    assert got == [("", 2.0, 2.0), ("a", 3.0, 5.0)]
    assert compare.compare(cur, prev).count() == 2


def test_all_alerts_are_delivered(spark, capsys):
    rows = [("price", "PRICE_CHANGE", "CRITICAL" if i % 2 else "WARNING", str(i), f"m{i}") for i in range(2500)]
    assert alerts.send(spark.createDataFrame(rows, "alert_group string, type string, level string, product string, message string"), "console")
    said = capsys.readouterr().out.splitlines()
    assert len(said) == 2500 and said[0].startswith("CRITICAL") and said[-1].startswith("WARNING")


def test_pictures_and_templates_in_files(spark, tmp_path):
    images = spark.createDataFrame([("A1", 1, "png", bytearray(b"x")), ("A1", 2, "jpg", bytearray(b"yy")), ("B", 1, "gif", None)], "article string, idx int, extension string, content binary")
    got = sorted((r.path.rsplit("/", 1)[1], r["size"]) for r in files.write_images(images, str(tmp_path / "pictures")).collect())
    assert got == [("A1_01.png", 1), ("A1_02.jpg", 2), ("B_01.gif", 0)]
    assert (tmp_path / "pictures" / "A1" / "A1_02.jpg").read_bytes() == b"yy"
    own = {"sheets": ["products"], "columns": {"products": ["name"]}}
    files.save_template("mine", own, str(tmp_path / "t"))
    assert files.list_templates(str(tmp_path / "t"))["mine"] == own and "basic" in files.list_templates()
    with pytest.raises(ValueError):
        files.save_template("bad", {"sheets": ["x"]}, str(tmp_path / "t"))


def test_only_these_lack_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"similarity_ratio", "rewrite_description", "box_nms"}
