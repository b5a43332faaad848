"""What a reader sees: newest versions, snapshots, batched lookups and version history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import DELETE, PUT


def at_snapshot(mut: DataFrame, snapshot: int | None) -> DataFrame:
    return mut if snapshot is None else mut.where(F.col("seq") <= snapshot)


def newest(mut: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest version of each key, deletions too. A partial aggregate, so that a hot key sends a row a task."""
    top = F.max_by(F.struct("seq", "vtype", "value"), "seq").alias("top")
    return at_snapshot(mut, snapshot).groupBy("key").agg(top).select("key", "top.seq", "top.vtype", "top.value")


def live(mut: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest versions that are not deletions."""
    return newest(mut, snapshot).where(F.col("vtype") == PUT).select("key", "seq", "value")


def deleted(mut: DataFrame, snapshot: int | None = None) -> DataFrame:
    return newest(mut, snapshot).where(F.col("vtype") == DELETE).select("key", "seq")


def point(mut: DataFrame, key: object, snapshot: int | None = None) -> DataFrame:
    """One key; the filter reaches the scan of a stored key column."""
    return live(mut.where(F.col("key") == F.lit(key)), snapshot)


def multi_get(mut: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """keys (key) with status and value. Only asked keys are aggregated."""
    asked = keys.select("key").distinct()
    found = live(mut.join(asked, "key", "left_semi"), snapshot)
    status = F.when(F.col("seq").isNull(), "NotFound").otherwise("OK")
    return keys.join(found, "key", "left").select(*keys.columns, status.alias("status"), "seq", "value")


def as_of(mut: DataFrame, probes: DataFrame, id_col: str) -> DataFrame:
    """probes (id, key, at) with the newest version of the key at that sequence number.

    Probes and versions are put in one order by key and number, and each probe takes the last version before it,
    so a key with many versions and many probes does not multiply them.
    """
    none = F.lit(None)
    both = mut.select("key", F.col("seq").alias("at"), F.lit(0).alias("probe"), F.struct("seq", "vtype", "value").alias("version"), none.cast(probes.schema[id_col].dataType).alias(id_col))
    both = both.unionByName(probes.select("key", "at", F.lit(1).alias("probe"), none.cast(both.schema["version"].dataType).alias("version"), id_col))
    before = Window.partitionBy("key").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seen", F.last("version", ignorenulls=True).over(before)).where(F.col("probe") == 1)
    shown = F.col("seen.vtype") == PUT
    return seen.select(id_col, "key", "at", F.when(shown, F.col("seen.seq")).alias("seq"), F.when(shown, F.col("seen.value")).alias("value"))


def history(mut: DataFrame) -> DataFrame:
    """All versions with their rank in their key, the newest first."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("vtype")))
    return mut.select("key", "seq", "vtype", "value", rank.cast("long").alias("version_rank"))


def version_counts(mut: DataFrame) -> DataFrame:
    return mut.groupBy("key").agg(F.count("*").alias("n_versions"), F.count_if(F.col("vtype") == DELETE).alias("n_deletes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def resurrected(mut: DataFrame) -> DataFrame:
    """Puts whose version before is a deletion."""
    order = Window.partitionBy("key").orderBy("seq")
    both = mut.select("key", "seq", "vtype", F.lag("vtype").over(order).alias("was"), F.lag("seq").over(order).alias("deleted_seq"))
    return both.where((F.col("vtype") == PUT) & (F.col("was") == DELETE)).select("key", "seq", "deleted_seq")


def snapshot_diff(mut: DataFrame, older: int, newer: int) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots. One pass over the log."""
    top = lambda s: F.max_by(F.when(F.col("seq") <= s, F.struct("seq", "vtype", "value")), F.when(F.col("seq") <= s, F.col("seq")))
    both = mut.groupBy("key").agg(top(older).alias("a"), top(newer).alias("b"))
    a, b = F.coalesce(F.col("a.vtype") == PUT, F.lit(False)), F.coalesce(F.col("b.vtype") == PUT, F.lit(False))
    change = F.when(a & ~b, "removed").when(~a & b, "added").when(a & b & (F.col("a.seq") != F.col("b.seq")), "changed")
    shown = both.withColumn("change", change).where("change is not null")
    return shown.select("key", "change", F.when(a, F.col("a.value")).alias("old_value"), F.when(b, F.col("b.value")).alias("new_value"))


def contains(mut: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The asked keys that are live."""
    return keys.join(live(mut, snapshot), "key", "left_semi")


def last_sequence(mut: DataFrame) -> int:
    """The high-water mark that a snapshot captures; 0 if there is no record."""
    return mut.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def oldest_snapshot(mut: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The oldest and newest live snapshot, the last sequence number, and what compaction must keep visible."""
    held = snapshots.agg(F.min("seq").alias("oldest"), F.max("seq").alias("newest"), F.count("*").alias("n_snapshots"))
    last = mut.agg(F.max("seq").alias("last_seq"))
    return held.crossJoin(last).withColumn("keep_from", F.coalesce("oldest", "last_seq"))  # one row each
