"""Line dedup by overlapping windows of consecutive lines.

A text is cut at line feeds. Each run of `width` consecutive lines is hashed to 128 bits; a window whose lines
occur at an earlier place (smaller doc_id, or the same document and an earlier line) is a later occurrence.
The positions that later occurrences cover are merged, and those lines are removed; the other lines stay, in
order. Windows are judged on the input, not on what is left.

The first place of each window is a partial aggregate, so a passage that a third of all documents share sends
one row from each task. Only windows that repeat are kept of these. The HOT most frequent ones at most, those with
more than one in HOT of all repeated places, are broadcast to the places; the others are dealt by window, and no one of them has more
than that part of the places. Places with a hot window are dealt by document, as they are settled already.

A very long text is one row; its covered lines are found by hashed sets, in time proportional to its lines.

Defined results: a null text stays null, with 0 lines; an empty text has one empty line; texts of fewer lines
than a window stay whole; rows of equal doc_id are places at the same document, so equal rows are not earlier
than each other and get equal results; an empty table gives an empty result. All columns are kept, whatever
their names, but for one named like the counts' column, which is replaced; a null doc_id comes before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written

WIDTH = 3
#: Windows that are broadcast at most, 50 bytes each.
HOT = 1 << 14


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_windows(documents: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, at): the windows that are later occurrences, by their first line."""

    def window(i: Column, lines: Column) -> Column:
        own = [F.element_at(lines, i + 1 + k) for k in range(width)]
        return F.struct(i.alias("at"), F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(width), *own[::-1]).alias("g"))

    slim = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), _lines(F.col(text_col)).alias("lines")).where(F.size("lines") >= width)
    each = slim.select("doc_id", "text_hash", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - width), lambda i: window(i, F.col("lines")))).alias("w"))
    places = each.select("doc_id", "text_hash", F.col("w.at").alias("at"), F.col("w.h").alias("h"), F.col("w.g").alias("g"))
    repeated = places.groupBy("h", "g").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max(F.struct("doc_id", "at")).alias("last"), F.count("*").alias("n"))
    repeated = written(repeated.where("first < last").select("h", "g", "first", "n"), "windows")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > total / HOT  # fewer than HOT windows can have as many
    hot = F.broadcast(repeated.where(is_hot).select("h", "g", F.col("first").alias("hot_first")))
    salt = F.when(F.col("hot_first").isNotNull(), F.xxhash64("doc_id", "text_hash", "at")).otherwise(0)
    cold = repeated.where(~is_hot).select("h", "g", F.lit(0).cast("long").alias("salt"), "first")
    found = places.join(hot, ["h", "g"], "left").withColumn("salt", salt).join(cold, ["h", "g", "salt"], "left")
    return found.where(F.struct("doc_id", "at") > F.coalesce("hot_first", "first")).select("doc_id", "text_hash", "at")


def lines_at(lines: Column, stay: Column) -> Column:
    """The lines at these places; the lines are cut once."""
    return F.flatten(F.transform(F.array(lines), lambda own: F.transform(stay, lambda i: F.get(own, i))))


def line_dedup(documents: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", counts_col: str = "line_dedup") -> DataFrame:
    """documents with `text_col` cut down to the lines kept, and (n_lines, n_removed) as a struct column `counts_col`."""
    id_, hash_, at = fresh(documents, "id", "hash", "at")
    later = repeated_windows(documents, width, id_col, text_col).groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("ats"))
    later = later.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("ats").alias(at))
    doc = documents.join(later, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(hash_)), "left")
    lines = _lines(F.col(text_col))

    covered = F.flatten(F.transform(at, lambda i: F.sequence(i, i + width - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)  # by a hashed set, in order

    whole = F.col(at).isNull()
    left = F.when(whole, lines).otherwise(lines_at(lines, stay))
    none = F.col(text_col).isNull()
    n = F.when(none, 0).otherwise(F.size(lines)).cast("long")
    removed = F.when(none | whole, 0).otherwise(F.size(lines) - F.size(stay)).cast("long")
    text = F.when(whole, F.col(text_col)).otherwise(F.array_join(left, "\n"))
    kept_columns = [text.alias(c) if c == text_col else F.col(c) for c in documents.columns if c != counts_col]
    return doc.select(*kept_columns, F.struct(n.alias("n_lines"), removed.alias("n_removed")).alias(counts_col))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
w AS (SELECT doc_id, unnest(range(len(l) - 2)) AS p, l FROM lines WHERE len(l) >= 3),
h AS (SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS s FROM w),
f AS (SELECT s, min({'d': doc_id, 'a': p}) AS first FROM h GROUP BY s),
c AS (SELECT doc_id, unnest([p, p + 1, p + 2]) AS i FROM h JOIN f USING (s) WHERE {'d': doc_id, 'a': p} > first),
r AS (SELECT doc_id, list(DISTINCT i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, l, CASE WHEN gone IS NULL THEN l ELSE list_filter(l, lambda x, i: NOT list_contains(gone, i - 1)) END AS kept FROM lines LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""
