"""The data model: one multi-version mutation log, and the relations around it.

    mut        key, seq BIGINT, vtype INT (1 put, 0 delete), value
    batch      batch_id BIGINT, pos BIGINT, vtype, key, value
    files      level INT, file_no BIGINT, file_size BIGINT, smallest, largest
    edits      edit_no BIGINT, op ('add' or 'del'), then the columns of files

Keys are binary or strings: Spark orders both by unsigned bytes, a prefix first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = 1, 0
LEVELS = 7

MUT_SCHEMA = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("seq", T.LongType()), T.StructField("vtype", T.IntegerType()), T.StructField("value", T.BinaryType())])
FILES_SCHEMA = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("file_no", T.LongType()), T.StructField("file_size", T.LongType()), T.StructField("smallest", T.StringType()), T.StructField("largest", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_width(number: Column, width: int = 16) -> Column:
    """A number as a key: decimal digits, filled with zeros on the left."""
    return F.lpad(number.cast("string"), width, "0")


def mut_of_events(events: DataFrame) -> DataFrame:
    """Events as a mutation log: users are keys, errors delete."""
    vtype = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    return events.select(fixed_width(F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"), vtype.alias("vtype"), F.col("props").alias("value"))


def files_of_parts(part: DataFrame) -> DataFrame:
    """Parts as file metadata: key ranges of 1 to 51 keys over seven levels."""
    return part.select(
        (F.col("p_size") % LEVELS).alias("level"),
        F.col("p_partkey").alias("file_no"),
        F.floor(F.col("p_retailprice") * 100).cast("long").alias("file_size"),
        fixed_width(F.col("p_partkey")).alias("smallest"),
        fixed_width(F.col("p_partkey") + F.col("p_size")).alias("largest"),
    )
