"""Tables: reading the input's, and writing intermediate ones to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of this session that settle() has written, removed by release() or when the driver ends.
_written: list[tuple[SparkSession, str]] = []
#: The folder of a session that names none.
_own: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='quarryline-')}")
    return _own[0]


def release() -> None:
    """Remove the tables that settle() has written so far; results that still read them are lost."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
            return


atexit.register(release)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and return the written table.

    This cuts the lineage, survives lost executors, and gives Catalyst the true size, so a later join
    is broadcast only if the table is below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    df = df.withColumns({c: F.lit(None).cast("string") for c, kind in df.dtypes if kind == "void"})  # Parquet has no void
    path = f"{shared_folder(spark)}/quarryline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
