import json
import os
import time

from pyspark.sql import functions as F

from quarryline.operators.compare import keep_last_n
from quarryline.sources import files
from quarryline.streaming import history


def test_snapshots_lists_and_dictionaries(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"url": "u", "name": "n", "price": 1.5, "characteristics": {"a": "b"}, "extra": 1}]))
    r = files.read_snapshot(spark, str(tmp_path / "p.json")).first()
    assert (r.name, r.price, r.characteristics) == ("n", 1.5, {"a": "b"})
    (tmp_path / "urls.txt").write_text("# no\n\n  https://a.b \nhttps://c.d\n")
    assert [x.url for x in files.read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.b", "https://c.d"]
    assert files.target_url(spark, None, str(tmp_path / "urls.txt")) == "https://a.b" and files.target_url(spark, "x") == "x" and files.target_url(spark) is None
    files.write_synonyms(spark.createDataFrame([("a", ["b", "c"])], "word string, synonyms array<string>"), str(tmp_path / "s.json"))
    assert [(x.word, x.synonyms) for x in files.read_synonyms(spark, str(tmp_path / "s.json")).collect()] == [("a", ["b", "c"])]
    (tmp_path / "t.json").write_text(json.dumps({"preserved_terms": ["мм", "кг"]}))
    assert [x.term for x in files.read_terms(spark, str(tmp_path / "t.json")).collect()] == ["мм", "кг"]
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    for name in ("one", "two", "one"):
        files.write_snapshot(df, str(tmp_path / "snaps"), name)
    assert {x.snapshot for x in spark.read.parquet(str(tmp_path / "snaps")).collect()} == {"one", "two"} and spark.read.parquet(str(tmp_path / "snaps")).count() == 2


def test_cache_files_and_backups(spark, tmp_path):
    now = 1_700_000_000.0
    for at, value in ((now - 90_000, "old"), (now - 10, "new")):
        files.cache_put(spark.createDataFrame([("k", value)], "key string, value string"), str(tmp_path / "cache"), at)
    alive = files.not_expired(spark.read.parquet(str(tmp_path / "cache")), F.lit(now).cast("timestamp"))
    assert [(r.key, r.value) for r in alive.collect()] == [("k", "new")]
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.png").write_bytes(b"123")
    assert [(r.size, r.extension) for r in files.file_infos(spark, str(data), "*.png").collect()] == [(3, ".png")]
    for _ in range(3):
        path = files.create_backup([str(data)], str(tmp_path / "b"), keep=2)
    assert files.backup_stats(str(tmp_path / "b"))["count"] == 2 and files.list_backups(str(tmp_path / "b"))[0]["path"] == path
    files.restore_backup(path, str(tmp_path / "r"))
    assert (tmp_path / "r/data/a.png").read_bytes() == b"123"
    os.utime(data / "a.png", (time.time() - 10 * 86400,) * 2)
    assert files.remove_older(str(data), 7) == 1 and files.remove_older(str(data), 7) == 0
    assert files.template("none") == files.TEMPLATES["basic"] and files.template_errors({"sheets": ["x"]}) == ["missing: columns", "no columns: x"]
    assert files.write_report({"s": spark.createDataFrame([(1,)], "a int")}, str(tmp_path / "rep")) == [f"{tmp_path}/rep/s"]


def test_history_keeps_the_newest(spark):
    old = spark.createDataFrame([("s", "k", i, float(i)) for i in range(5)], "site string, product_key string, ts long, price double")
    new = spark.createDataFrame([("s", "k", 9, 9.0, "n", "a")], "site string, product_key string, ts long, price double, name string, article string")
    from quarryline.schema import Settings

    got = keep_last_n(old.unionByName(new, allowMissingColumns=True), ["site", "product_key"], ["ts"], 2)
    assert sorted(r.ts for r in got.collect()) == [4, 9]
    full = old.withColumn("name", F.lit("x")).withColumn("article", F.lit("y"))
    assert files.append_history(full, new, settings=Settings(history_kept=3)).count() == 3


def test_stream_of_snapshots_finds_changes(spark, tmp_path):
    kind = "name string, sku string, url string, price double, status string, images array<string>, characteristics map<string,string>"
    seen = []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for i, price in enumerate((10.0, 20.0)):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"name": "a", "sku": "s", "url": "u", "price": price, "status": "in_stock", "images": [], "characteristics": {}}))
        os.utime(tmp_path / f"in/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    writer = history.detect_changes(stream, str(tmp_path / "store"), lambda df, n: seen.append([(r.status, r.change_percent) for r in df.collect()]))
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [[("changed", 100.0)]]


def test_windowed_stream_equals_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    q = history.windowed_totals(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("w")) == key(history.windowed_totals(table))
