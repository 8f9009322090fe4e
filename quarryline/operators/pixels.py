"""Raw RGB images as rows (id, width, height, pixels binary): resize, crop, brightness and contrast in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "id long, width int, height int, pixels binary"


def _each(images: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                x = change(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3))
                out.append((r.id, x.shape[1], x.shape[0], x.tobytes()))
            yield pd.DataFrame(out, columns=["id", "width", "height", "pixels"]).astype({"width": "int32", "height": "int32"})

    return images.select("id", "width", "height", "pixels").mapInPandas(run, SCHEMA)


def fitted(width: int, height: int, to_width: int, to_height: int) -> tuple[int, int]:
    """The largest size of the same shape within a box."""
    scale = min(to_width / width, to_height / height)
    return max(1, int(width * scale)), max(1, int(height * scale))


def resize(images: DataFrame, width: int, height: int, keep_shape: bool = True) -> DataFrame:
    """Nearest-pixel resize into a box."""

    def change(x: np.ndarray) -> np.ndarray:
        w, h = fitted(x.shape[1], x.shape[0], width, height) if keep_shape else (width, height)
        return np.ascontiguousarray(x[np.arange(h) * x.shape[0] // h][:, np.arange(w) * x.shape[1] // w])

    return _each(images, change)


def crop(images: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    return _each(images, lambda x: np.ascontiguousarray(x[top : top + height, left : left + width]))


def adjust(images: DataFrame, brightness: int = 0, contrast: int = 0) -> DataFrame:
    """Brightness -255 to 255 is added, contrast -255 to 255 turns about the middle grey."""
    factor = 259 * (contrast + 255) / (255 * (259 - contrast))
    return _each(images, lambda x: np.clip(factor * (x.astype(float) + brightness - 128) + 128, 0, 255).astype(np.uint8))
