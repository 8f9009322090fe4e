"""Image metadata: quality scores, the main image of a product, moderation counts, box overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DEFAULTS, Settings


def quality_score(size: Column, width: Column, height: Column, cleaned: Column | None = None, settings: Settings = DEFAULTS) -> Column:
    """1, less for small files, small sides and a failed step, more for large sides; 0 to 1."""
    score = F.lit(1.0) - F.when(size < settings.image_min_bytes, 0.3).otherwise(0.0)
    score = score - F.when((width < settings.image_min_side) | (height < settings.image_min_side), 0.2).otherwise(0.0)
    score = score + F.when((width >= settings.image_large_side) & (height >= settings.image_large_side), 0.1).otherwise(0.0)
    if cleaned is not None:
        score = score - F.when(~cleaned, 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)


def moderate(images: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """images (article, idx, size, width, height, cleaned) with moderation_score, is_approved, and the place among the
    approved images of the article (1 is the main image)."""
    score = quality_score(F.col("size"), F.col("width"), F.col("height"), F.col("cleaned"), settings)
    out = images.withColumn("moderation_score", score).withColumn("is_approved", F.col("moderation_score") >= settings.image_approved)
    spec = W.partitionBy("article", "is_approved").orderBy(F.desc("moderation_score"), "idx")
    return out.withColumn("place", F.when(F.col("is_approved"), F.row_number().over(spec)))


def main_images(moderated: DataFrame) -> DataFrame:
    """The main image of each article, by a sum that needs no sort of its group."""
    best = F.max_by(F.struct("idx", "moderation_score"), F.struct("moderation_score", (-F.col("idx")).alias("i")))
    return moderated.where("is_approved").groupBy("article").agg(best.alias("m")).select("article", "m.idx", "m.moderation_score")


def moderation_summary(moderated: DataFrame) -> DataFrame:
    ok = F.col("is_approved")
    return moderated.groupBy("article").agg(
        F.count("*").alias("total_processed"), F.count_if(ok).alias("approved_count"), F.count_if(~ok).alias("rejected_count"),
        F.avg(ok.cast("double")).alias("approval_rate"), F.avg("moderation_score").alias("average_score"),
        F.max(F.when(ok, F.col("moderation_score"))).alias("best_score"), F.min(F.when(ok, F.col("moderation_score"))).alias("worst_approved_score"),
        F.max(F.when(~ok, F.col("moderation_score"))).alias("best_rejected_score"),
    )


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two boxes (x, y, w, h) over their union; 0 if they do not meet."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    return F.coalesce(F.try_divide(inter.cast("double"), (a["w"] * a["h"] + b["w"] * b["h"] - inter).cast("double")), F.lit(0.0))


def non_overlapping(boxes: DataFrame, overlap: float = DEFAULTS.overlap) -> DataFrame:
    """Of boxes (image, box_id, x, y, w, h, confidence) those kept by greedy suppression within each image.

    The choice of a box depends on all surer ones, so it runs per image in Arrow batches; an image's boxes are few.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["confidence", "box_id"], ascending=[False, True])
        kept: list = []
        for r in rows.itertuples():
            if all(_iou(r, k) <= overlap for k in kept):
                kept.append(r)
        return rows.loc[[k.Index for k in kept]]

    return boxes.groupBy("image").applyInPandas(keep, boxes.schema)


def _iou(a, b) -> float:
    w, h = min(a.x + a.w, b.x + b.w) - max(a.x, b.x), min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
    inter = max(w, 0) * max(h, 0)
    union = a.w * a.h + b.w * b.h - inter
    return inter / union if union else 0.0


def header_info(files: DataFrame) -> DataFrame:
    """(path, format, width, height) of image files (path, content) from their headers: PNG, GIF, JPEG, BMP."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *parse_header(bytes(c or b""))) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "format", "width", "height"]).astype({"width": "Int64", "height": "Int64"})

    return files.select("path", "content").mapInPandas(read, "path string, format string, width long, height long")


def parse_header(data: bytes) -> tuple[str | None, int | None, int | None]:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM" and len(data) >= 26:
        return "bmp", int.from_bytes(data[18:22], "little"), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + size
        return "jpeg", None, None
    return None, None, None
