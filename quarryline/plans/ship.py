"""Sending this package to the executors, so that a cluster needs no install of it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give this application's Python workers the package, once; returns spark."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(ROOT.rglob("*.py")):
                out.write(p, p.relative_to(ROOT.parent))
        path = os.path.join(tempfile.mkdtemp(prefix="quarryline-ship-"), "quarryline_package.zip")
        Path(path).write_bytes(held.getvalue())
        spark.sparkContext.addPyFile(path)  # the driver serves it to every executor
    return spark
