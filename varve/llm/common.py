"""Helpers shared by the operators: input tables, written cut points, batch sizes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch sent to a Python worker; texts can be long, and one over the bytes is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
ROWS_SETTING, BYTES_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of long texts at once.

    Plans that are returned run later, so the session's bounds are lowered for good where they are wider: to the same values by all operators.
    """
    for setting, most in ((ROWS_SETTING, BATCH_ROWS), (BYTES_SETTING, BATCH_BYTES)):
        now = spark.conf.get(setting).removesuffix("b")  # a size in bytes ends in it
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(setting, str(most))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows for what runs inside."""
    before = spark.conf.get(ROWS_SETTING)
    spark.conf.set(ROWS_SETTING, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_SETTING, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all runs on one machine."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="varve-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs a reread only.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
