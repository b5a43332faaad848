"""The manifest as a fold of file edits, and what it leaves obsolete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replayed(edits: DataFrame) -> DataFrame:
    """The live files: those whose last edit, in order, adds them. A file is its level and number."""
    last = F.max_by(F.struct("op", "file_size", "smallest", "largest"), "edit_no").alias("last")
    state = edits.groupBy("level", "file_no").agg(last).where("last.op = 'add'")
    return state.select("level", "file_no", "last.file_size", "last.smallest", "last.largest")


def applied(files: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """One edit: deletions first, then additions."""
    return files.join(gone, ["level", "file_no"], "left_anti").unionByName(new)


def obsolete(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files (file_no) that no live file accounts for."""
    return listed.join(files, "file_no", "left_anti")


def obsolete_logs(logs: DataFrame, log_no: int) -> DataFrame:
    """Logs (log_no) before the one in use, in order."""
    return logs.where(F.col("log_no") < log_no).orderBy("log_no")


def directory_stats(listing: DataFrame) -> DataFrame:
    """Tables, logs and bytes of a listing (name, size)."""
    return listing.agg(F.count_if(F.col("name").endswith(".sst")).alias("n_tables"), F.count_if(F.col("name").endswith(".log")).alias("n_logs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def live_files(versions: list[DataFrame]) -> DataFrame:
    """(file_no, level) of the files that any of the versions still needs."""
    return reduce(DataFrame.unionByName, (v.select("file_no", "level") for v in versions)).distinct()


def in_order(files: DataFrame) -> DataFrame:
    """Each level's files by their smallest key, from place 1. File lists are metadata."""
    order = Window.partitionBy("level").orderBy("smallest", "file_no")
    return files.select("level", "file_no", "smallest", F.row_number().over(order).cast("long").alias("place"))
