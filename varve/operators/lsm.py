"""Maintenance: runs, overlaps, compaction rules, levels and when to compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bytesfn as B
from ..model import DELETE, LEVELS, PUT
from .ordering import held, last_before, running

WRITE_BUFFER, OUTPUT_FILE = 4 << 20, 2 << 20
L0_TRIGGER, LEVEL_BASE = 4, 10 << 20


def sized(mut: DataFrame) -> DataFrame:
    """mut with `bytes`, a record's size in memory; deletions have no value."""
    v = F.when(F.col("vtype") == PUT, F.coalesce(F.length("value"), F.lit(0))).otherwise(0).cast("long")
    return mut.withColumn("bytes", B.memtable_entry_size(F.length("key").cast("long"), v))


def assigned_runs(mut: DataFrame, buffer: int = WRITE_BUFFER) -> DataFrame:
    """mut with run_id: the log cut, in sequence order, where `buffer` bytes are full."""
    placed = running(sized(mut), ["seq"], F.col("bytes"), "before")
    return placed.withColumn("run_id", F.floor(F.col("before") / buffer).cast("long")).drop("before")


def run_metadata(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def candidates(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(key, file) pairs where the file's range holds the key."""
    return held(keys, files, "key").select("point.*", "span.*")


def overlap_pairs(files: DataFrame) -> DataFrame:
    """Pairs of files of one level whose ranges meet: the earlier one's holds where the later one begins."""
    files = files.where("smallest <= largest").select("level", "file_no", "smallest", "largest")
    met = held(files.select("level", "smallest", "file_no"), files, "smallest", ("level",))
    later = F.struct("span.smallest", "span.file_no") < F.struct("point.smallest", "point.file_no")
    a, b = F.col("span.file_no"), F.col("point.file_no")
    return met.where(later & (a != b)).select("span.level", F.least(a, b).alias("file_a"), F.greatest(a, b).alias("file_b"))


def overlap_islands(files: DataFrame) -> DataFrame:
    """The transitive closure of overlaps in a level: files by island, numbered from 0 in key order."""
    order = Window.partitionBy("level").orderBy("smallest", "file_no")
    reach = F.max("largest").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = files.withColumn("new", F.when(reach.isNull() | (F.col("smallest") > reach), 1).otherwise(0))
    return cut.select("level", "file_no", (F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long").alias("island"))


def read_amplification(keys: DataFrame, files: DataFrame) -> DataFrame:
    """How many files a lookup of each key may open: ranges that have begun and not ended, by running sums in key order."""
    begin = files.select(F.col("smallest").alias("key"), F.lit(0).alias("turn"), F.lit(1).alias("n"))
    end = files.select(F.col("largest").alias("key"), F.lit(2).alias("turn"), F.lit(-1).alias("n"))
    asked = keys.select("key", F.lit(1).alias("turn"), F.lit(0).alias("n"))
    events = begin.unionByName(end).unionByName(asked)
    open_ = running(events, ["key", "turn"], F.col("n"), "before")
    return open_.where(F.col("turn") == 1).select("key", F.col("before").cast("long").alias("n_files"))


def located(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(key, level, file_no): the file that may hold each key, in levels whose ranges are disjoint: the last one to begin, if it has not ended.

    Found in one order of the files and the keys.
    """
    levels = F.broadcast(files.select("level").distinct())  # seven rows at most
    file = F.struct(F.col("smallest").alias("smallest"), F.col("largest").alias("largest"), F.col("file_no").alias("file_no"))
    starts = files.select("level", F.col("smallest").alias("key"), F.lit(0).alias("probe"), file.alias("file"))
    asked = keys.crossJoin(levels).select("level", "key", F.lit(1).alias("probe"), F.lit(None).cast(starts.schema["file"].dataType).alias("file"))
    found = last_before(starts.unionByName(asked), ["key", "probe"], F.col("file"), "found", ("level",))
    return found.where("probe = 1 AND found.largest >= key").select("key", "level", "found.file_no")


def _newest(mut: DataFrame) -> DataFrame:
    top = F.max_by(F.struct("seq", "vtype", "value"), "seq").alias("top")
    return mut.groupBy("key").agg(top).select("key", "top.seq", "top.vtype", "top.value")


def compacted(mut: DataFrame, oldest: int | None = None) -> DataFrame:
    """What compaction keeps: a version goes if a newer one is visible at the oldest snapshot. Without snapshots, the newest of each key.

    That is every version after the snapshot and the newest one up to it: a filter and a partial aggregate, so a key
    with very many versions is not sorted in one task.
    """
    if oldest is None:
        return _newest(mut)
    late = mut.where(F.col("seq") > oldest).select("key", "seq", "vtype", "value")
    return late.unionByName(_newest(mut.where(F.col("seq") <= oldest)))


def compacted_raw(mut: DataFrame, oldest: int) -> DataFrame:
    """The rule as it runs in practice: a superseded version goes if it is itself older than the snapshot."""
    late = mut.where(F.col("seq") >= oldest).select("key", "seq", "vtype", "value")
    return late.unionByName(_newest(mut).where(F.col("seq") < oldest))


def without_old_tombstones(mut: DataFrame, oldest: int) -> DataFrame:
    """Compaction into the lowest level: deletions that all snapshots see go too."""
    return compacted(mut, oldest).where((F.col("vtype") == PUT) | (F.col("seq") > oldest))


def space(mut: DataFrame, kept: DataFrame) -> DataFrame:
    """Records and bytes before and after, and their ratio."""
    before = sized(mut).agg(F.count("*").alias("n_before"), F.sum("bytes").alias("bytes_before"))
    after = sized(kept).agg(F.count("*").alias("n_after"), F.sum("bytes").alias("bytes_after"))
    return before.crossJoin(after).withColumn("amplification", F.round(F.col("bytes_before") / F.col("bytes_after"), 6))  # one row each


def output_files(kept: DataFrame, limit: int = OUTPUT_FILE) -> DataFrame:
    """Compaction output cut, in key order and never inside a key, where `limit` bytes are full."""
    keys = sized(kept).groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    placed = running(keys, ["key"], F.col("bytes"), "before")
    cut = placed.withColumn("file_id", F.floor(F.col("before") / limit).cast("long"))
    return cut.groupBy("file_id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("key").alias("smallest"), F.max("key").alias("largest"))


def level_stats(files: DataFrame) -> DataFrame:
    """Files and bytes of all seven levels, zero where there is none."""
    levels = files.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    sums = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))
    return levels.join(sums, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n_files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def level_caps(spark: SparkSession, base: int = LEVEL_BASE) -> DataFrame:
    """The most bytes of levels 1 to 6."""
    levels = spark.range(1, LEVELS).select(F.col("id").cast("int").alias("level"))
    return levels.select("level", (F.lit(base) * F.pow(F.lit(10), F.col("level") - 1)).cast("long").alias("max_bytes"))


def pressure(files: DataFrame, trigger: int = L0_TRIGGER, base: int = LEVEL_BASE) -> DataFrame:
    """Whether each level is over its limit: files for level 0, bytes for the others, never for the last."""
    stats = level_stats(files).join(level_caps(files.sparkSession, base), "level", "left")
    over = F.when(F.col("level") == 0, F.col("n_files") >= trigger).when(F.col("level") == LEVELS - 1, False).otherwise(F.col("bytes") > F.col("max_bytes"))
    return stats.select("level", "n_files", "bytes", over.alias("over"))


def needs_compaction(files: DataFrame, trigger: int = L0_TRIGGER, base: int = LEVEL_BASE) -> DataFrame:
    return pressure(files, trigger, base).agg(F.bool_or("over").alias("needs_compaction"))


def picked_level(files: DataFrame, trigger: int = L0_TRIGGER, base: int = LEVEL_BASE) -> DataFrame:
    """The level to compact, the lowest one over its limit, with its seed: the file of the lowest number."""
    level = pressure(files, trigger, base).where("over").agg(F.min("level").alias("level"))
    return level.join(files.select("level", "file_no"), "level", "left").groupBy("level").agg(F.min("file_no").alias("seed_file"))


def level_text(stats: DataFrame) -> DataFrame:
    """One line: L0:<files>f/<bytes>b|L1:..."""
    each = F.concat(F.lit("L"), F.col("level"), F.lit(":"), F.col("n_files"), F.lit("f/"), F.col("bytes"), F.lit("b"))
    return stats.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", each.alias("t")))), lambda x: x["t"]), "|").alias("stats"))


def tombstones(mut: DataFrame) -> DataFrame:
    return mut.where(F.col("vtype") == DELETE)
