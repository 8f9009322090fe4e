"""Files in and out: snapshots, history, address lists, dictionaries, pictures, a table cache with expiry, backups."""

from __future__ import annotations

import json
import shutil
import time
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.compare import keep_last_n
from ..schema import DEFAULTS, PRODUCT, Settings


def read_json(spark: SparkSession, path: str, schema: T.StructType = PRODUCT) -> DataFrame:
    """Whole-file JSON (an array or one object) with a known schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A stored snapshot by the form that its name tells: json, csv, orc or parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "json":
        return read_json(spark, path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=False)
    return spark.read.orc(path) if kind == "orc" else spark.read.parquet(path)


def write_snapshot(df: DataFrame, path: str, snapshot: str) -> None:
    """Add a snapshot as a partition; one that is there under the same name is replaced, others stay."""
    out = df.withColumn("snapshot", F.lit(snapshot))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(path)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text file: a line each, trimmed; blank lines and those that start with # are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def target_url(spark: SparkSession, url: str | None = None, path: str | None = None, default: str | None = None) -> str | None:
    """The given address, else the first of a file, else the first of the default file."""
    if url:
        return url
    for p in (path, default):
        if p:
            row = read_url_list(spark, p).first()
            if row:
                return row["url"]
    return None


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(word, synonyms) of a JSON dictionary {word: [synonym]}."""
    raw = spark.read.text(path, wholetext=True)
    found = F.from_json("value", "map<string,array<string>>")
    return raw.select(F.explode(found).alias("word", "synonyms"))


def write_synonyms(table: DataFrame, path: str) -> None:
    """The dictionary as one JSON object; it is small by nature."""
    rows = {r["word"]: list(r["synonyms"]) for r in table.collect()}
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term) of a JSON object whose preserved_terms is a list."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "struct<preserved_terms:array<string>>")["preserved_terms"]).alias("term"))


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of picture files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def file_infos(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, extension) of files below a folder; contents are not read."""
    files = read_images(spark, path, pattern)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1)).alias("extension"))


def append_history(history: DataFrame, new: DataFrame, key: Sequence[str] = ("site", "product_key"), settings: Settings = DEFAULTS) -> DataFrame:
    """history and new rows (key, ts, price, name, article), the newest hundred of each key."""
    return keep_last_n(history.unionByName(new, allowMissingColumns=True), list(key), ["ts", "price", "name"], settings.history_kept)


def cache_put(df: DataFrame, path: str, now: float, hours: float = 24) -> None:
    """Append rows (key, value) that expire after so many hours from now (seconds since 1970)."""
    df.withColumn("created_at", F.lit(now).cast("timestamp")).withColumn("expires_at", F.lit(now + hours * 3600).cast("timestamp")).write.mode("append").parquet(path)


def not_expired(cached: DataFrame, now) -> DataFrame:
    """The newest row of each key that has not expired; now: a Column or a timestamp."""
    alive = cached.where(F.col("expires_at") > F.lit(now))
    rest = [c for c in alive.columns if c != "key"]
    best = alive.groupBy("key").agg(F.max_by(F.struct(*rest), "created_at").alias("r"))
    return best.select("key", "r.*")


def create_backup(folders: Sequence[str], to: str, keep: int = 30) -> str:
    """A zip of some folders, with its metadata beside it; only the newest `keep` stay."""
    out = Path(to)
    out.mkdir(parents=True, exist_ok=True)
    name = out / f"backup_{datetime.now():%Y%m%d_%H%M%S}_{time.time_ns() % 10**6:06d}"
    work = out / f".{name.name}"
    for f in folders:
        if Path(f).is_dir():
            shutil.copytree(f, work / Path(f).name)
    work.mkdir(exist_ok=True)
    path = shutil.make_archive(str(name), "zip", work)
    shutil.rmtree(work)
    Path(f"{name}.json").write_text(json.dumps({"created": time.time(), "folders": [str(f) for f in folders], "size": Path(path).stat().st_size}))
    for old in list_backups(to)[keep:]:
        Path(old["path"]).unlink(missing_ok=True)
        Path(old["path"]).with_suffix(".json").unlink(missing_ok=True)
    return path


def list_backups(folder: str) -> list[dict]:
    """Backups, newest first."""
    found = [json.loads(m.read_text()) | {"path": str(m.with_suffix(".zip"))} for m in Path(folder).glob("backup_*.json")]
    return sorted(found, key=lambda x: (x["created"], x["path"]), reverse=True)


def restore_backup(path: str, to: str) -> None:
    shutil.unpack_archive(path, to, "zip")


def backup_stats(folder: str) -> dict:
    found = list_backups(folder)
    return {"count": len(found), "size": sum(b["size"] for b in found), "newest": found[0]["path"] if found else None, "oldest": found[-1]["path"] if found else None}


def remove_older(folder: str, days: float, now: float | None = None) -> int:
    """Delete files whose last change is more than so many days ago; returns how many."""
    cutoff = (now or time.time()) - days * 86400
    old = [p for p in Path(folder).rglob("*") if p.is_file() and p.stat().st_mtime < cutoff]
    for p in old:
        p.unlink()
    return len(old)


#: Report templates: the sheets and the columns of each.
TEMPLATES = {
    "basic": {"sheets": ["products"], "columns": {"products": ["name", "price", "url"]}},
    "full": {
        "sheets": ["products", "comparison", "trends", "validation", "alerts", "summary"],
        "columns": {"products": ["category", "article", "image_files", "description", "price"], "comparison": ["name", "sku", "old_price", "new_price", "change"],
                    "trends": ["product_key", "trend", "change_percent"], "validation": ["name", "status", "errors"], "alerts": ["kind", "level", "message"], "summary": ["metric", "value"]},
    },
}


def template(name: str, custom: dict[str, dict] | None = None) -> dict:
    """A custom template before a built-in one of the same name; an unknown name gives the basic one."""
    return (custom or {}).get(name) or TEMPLATES.get(name) or TEMPLATES["basic"]


def save_template(name: str, t: dict, folder: str) -> str:
    """A template as JSON under its name; one with errors is refused."""
    if errors := template_errors(t):
        raise ValueError("; ".join(errors))
    out = Path(folder) / f"{name}.json"
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(t, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(out)


def list_templates(folder: str | None = None) -> dict[str, dict]:
    """The built-in templates and those saved in a folder, which come before built-in ones of the same name."""
    saved = {p.stem: json.loads(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.json"))} if folder else {}
    return TEMPLATES | saved


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """(path, size): each row of images (article, idx, extension, content) as folder/article/article_idx.extension.

    Tasks write their own rows through the folder's file system as pyarrow opens it, so shared stores work; a file
    that is there already is replaced, so a task that runs again makes the same files.
    """

    def run(batches):
        import pandas as pd
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else Path(folder).absolute().as_uri())
        for b in batches:
            out = []
            for r in b.itertuples():
                fs.create_dir(f"{base}/{r.article}", recursive=True)
                path = f"{base}/{r.article}/{r.article}_{r.idx:02d}.{r.extension}"
                with fs.open_output_stream(path) as f:
                    f.write(bytes(r.content or b""))
                out.append((path, len(r.content or b"")))
            yield pd.DataFrame(out, columns=["path", "size"])

    return images.select("article", "idx", "extension", "content").mapInPandas(run, "path string, size long")


def template_errors(t: dict) -> list[str]:
    out = [f"missing: {k}" for k in ("sheets", "columns") if k not in t]
    out += [f"no columns: {s}" for s in t.get("sheets", []) if not t.get("columns", {}).get(s)]
    return out


def write_report(sheets: dict[str, DataFrame], path: str, mode: str = "overwrite") -> list[str]:
    """Each sheet as CSV with a header below path; returns what was written."""
    for name, df in sheets.items():
        df.write.mode(mode).option("header", "true").csv(f"{path}/{name}")
    return [f"{path}/{name}" for name in sheets]
