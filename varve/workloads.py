"""Workload generators and the figures taken of them. Keys come from arithmetic, so runs agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bytesfn as B

#: A multiplier that spreads consecutive numbers.
SPREAD = 2654435761


def fill_sequential(spark: SparkSession, n: int, value_size: int = 100) -> DataFrame:
    return spark.range(n).select(F.format_string("%016d", "id").alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).alias("vtype"), B.fixed_value(F.col("id"), value_size).alias("value"))


def fill_random(spark: SparkSession, n: int, value_size: int = 100) -> DataFrame:
    """n puts on keys of 0..n-1 that repeat."""
    hit = F.pmod(F.shiftrightunsigned(F.pmod(F.col("id") * SPREAD, F.lit(1 << 32)), 7), F.lit(n))
    return spark.range(n).select(F.format_string("%016d", hit).alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).alias("vtype"), B.fixed_value(F.col("id"), value_size).alias("value"))


def churn(spark: SparkSession, n: int, hot: int, rounds: int, value_size: int = 100) -> DataFrame:
    """n puts, then rounds of n puts on the first `hot` keys."""
    key = lambda i: B.fixed_key(F.concat(F.lit("k_"), F.lpad(i.cast("string"), 9, "0")))
    all_ = spark.range(n * (rounds + 1)).select(F.col("id"), F.when(F.col("id") < n, F.col("id")).otherwise(F.pmod(F.col("id"), F.lit(n)) % hot).alias("i"))
    return all_.select(key(F.col("i")).alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).alias("vtype"), B.fixed_value(F.pmod(F.col("id"), F.lit(n)), value_size).alias("value"))


def worker_puts(spark: SparkSession, workers: int, each: int, value_size: int = 100) -> DataFrame:
    """Puts of several workers on keys of their own."""
    rows = spark.range(workers * each).select(F.floor(F.col("id") / each).cast("int").alias("worker"), (F.col("id") % each).alias("i"), "id")
    key = B.fixed_key(F.concat(F.lit("t"), F.format_string("%03d", "worker"), F.lit("_"), F.format_string("%09d", "i")))
    value = F.rpad(F.concat(F.lit("v"), F.col("worker"), F.lit("_"), F.col("i"), F.lit("_")), value_size, "x")
    return rows.select("worker", key.alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).alias("vtype"), value.alias("value"))


def percentiles(latencies: DataFrame) -> DataFrame:
    """Exact interpolated percentiles of micros for each worker."""
    at = lambda p: F.round(F.percentile("micros", p), 6)
    return latencies.groupBy("worker").agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def throughput(name: str, ops: DataFrame) -> DataFrame:
    """Operations and MiB a second, and micros an operation, from rows of (group, micros, bytes)."""
    sums = ops.groupBy(name).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("micros").alias("micros"))
    seconds = F.col("micros") / 1e6
    return sums.select(name, "n", "bytes", "micros", F.round(F.col("n") / seconds, 6).alias("ops_per_sec"), F.round(F.col("bytes") / 1048576.0 / seconds, 6).alias("mb_per_sec"), F.round(F.col("micros") / F.col("n"), 6).alias("micros_per_op"))


def append_csv(results: DataFrame, path: str) -> None:
    """Benchmark results, a row each, added to a folder of CSV files with headers."""
    results.coalesce(1).write.mode("append").option("header", True).csv(path)
