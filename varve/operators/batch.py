"""Write batches: sequence numbers, what becomes of them, and their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bytesfn as B
from ..model import PUT
from .ordering import running
from .visible import newest


def sequenced(batches: DataFrame, base: int = 0) -> DataFrame:
    """batches with seq: base + 1 on, by batch and place in it."""
    counts = batches.groupBy("batch_id").agg(F.count("*").alias("n"))
    before = running(counts, ["batch_id"], F.col("n"), "before").select(F.col("batch_id").alias("of"), "before")
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("pos"))
    rows = batches.withColumn("place", place).join(before, F.col("batch_id") == F.col("of"))
    return rows.select("batch_id", "pos", "key", (F.col("before") + F.col("place") + base).cast("long").alias("seq"), "vtype", F.when(F.col("vtype") == PUT, F.col("value")).alias("value"))


def applied(batches: DataFrame, base: int = 0) -> DataFrame:
    """The live keys after all batches, in order; the last write wins."""
    return newest(sequenced(batches, base)).where(F.col("vtype") == PUT).select("key", "seq", "value")


def batch_sizes(batches: DataFrame) -> DataFrame:
    k, v = F.length("key").cast("long"), F.coalesce(F.length("value"), F.lit(0)).cast("long")
    return batches.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum(B.batch_record_size(F.col("vtype"), k, v)).alias("approximate_size"), (F.sum(B.wal_record_size(F.col("vtype"), k, v)) + 12).alias("wal_payload"))
