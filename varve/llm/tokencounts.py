"""Token counts from flat token files by a separator scan.

A flat token file is the ids of documents one after another, each followed by a separator id, with no index. It
is read in blocks of a fixed size that begin and end anywhere. Each block is searched for separators with one
vectorised comparison, which gives the counts of the documents that lie inside it, the length before its first
separator and after its last. Boundaries are stitched by a prefix scan over the blocks' summaries: a window per
group of GROUP blocks, one over the groups, and the two put together, so no task scans a whole file's summaries.

`flat_files` writes documents as such files: a file for each input partition, as a table of blocks in the shared
folder, with the ids of the documents that end in a block, in order and without positions. Ids fit 16 bits where
the vocabulary does. The separator is the first id after the vocabulary, so no text holds it.

Defined results: null and empty texts have 0 tokens; equal rows are counted each; a block without a separator adds
to the document that ends later; an unfinished last document, which `flat_files` never leaves, is not counted; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, table, written
from .tokens import default_path, tokenizer

#: Ids in a block, and blocks whose summaries are scanned together.
BLOCK, GROUP = 1 << 16, 1 << 10


def flat_files(documents: DataFrame, path: str | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, str]:
    """Blocks (file, block, ids binary, doc_ids), the separator and the ids' numpy type."""
    path = path or default_path()
    separator = tokenizer(path).vocabulary
    kind = "<u2" if separator < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, end, size = tokenizer(path), np.array([separator], kind).tobytes(), block * np.dtype(kind).itemsize
        held, file, n, ended = bytearray(), None, 0, []  # ended: ids of documents that end in what is held, and where

        def cut(start: int, upto: int) -> pa.RecordBatch:
            nonlocal n, ended
            here = [d for d, at in ended if at <= upto]
            ended = [(d, at) for d, at in ended if at > upto]
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([n - 1], pa.int64()), pa.array([bytes(held[start:upto])], pa.binary()), pa.array([here], pa.list_(pa.int64()))], names=["file", "block", "ids", "doc_ids"])

        for b in batches:
            for doc_id, text, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                file = part
                held += np.frombuffer(tokenize(text), "<u4").astype(kind).tobytes() + end
                ended.append((doc_id, len(held)))
                full = len(held) // size * size
                for start in range(0, full, size):
                    yield cut(start, start + size)
                if full:  # what is left moves to the front once, however many blocks a text has filled
                    del held[:full]
                    ended = [(d, at - full) for d, at in ended]
        if held:
            yield cut(0, len(held))

    small_batches(documents.sparkSession)
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("file"))
    return written(slim.mapInArrow(run, "file int, block long, ids binary, doc_ids array<long>"), "flat"), separator, kind


def separator_scan(blocks: DataFrame, separator: int, kind: str = "<u2") -> DataFrame:
    """(file, block, ordinal, n_tokens): each document's tokens, by the block that has its separator and its place among those of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, counts, tail = [], [], []
            for ids in b.column(2).to_pylist():
                x = np.frombuffer(ids or b"", kind)
                at = np.flatnonzero(x == separator)
                size.append(len(x))
                counts.append(np.diff(at, prepend=-1) - 1)
                tail.append(len(x) - 1 - int(at[-1]) if len(at) else len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(counts, pa.list_(pa.int64())), pa.array(tail, pa.int64())], names=["file", "block", "size", "counts", "tail"])

    small_batches(blocks.sparkSession)
    found = written(blocks.select("file", "block", "ids").mapInArrow(run, "file int, block long, size long, counts array<long>, tail long"), "scanned")
    # what runs on over a block's end: its tail if it has a separator, else its size and what ran on before it
    summary = found.select("file", "block", F.expr(f"block div {GROUP}").alias("group"), (F.size("counts") > 0).alias("cuts"), "tail")
    inside = Window.partitionBy("file", "group").orderBy("block")
    scan = summary.withColumn("cut_no", F.sum(F.col("cuts").cast("int")).over(inside))
    run_on = F.sum("tail").over(Window.partitionBy("file", "group", "cut_no").orderBy("block"))
    scan = scan.withColumn("run_on", run_on)
    ends = scan.groupBy("file", "group").agg(F.max("cut_no").alias("cuts"), F.max_by("run_on", "block").alias("tail"))
    over = Window.partitionBy("file").orderBy("group")
    ends = ends.withColumn("part", F.sum((F.col("cuts") > 0).cast("int")).over(over))
    ends = ends.withColumn("total", F.sum("tail").over(Window.partitionBy("file", "part").orderBy("group")))
    carry = ends.withColumn("carried", F.coalesce(F.lag("total").over(over), F.lit(0))).select("file", "group", "carried")
    before = F.lag(F.struct("run_on", "cut_no")).over(inside)
    into = scan.withColumn("before", before).join(carry, ["file", "group"])
    into = into.select("file", "block", (F.coalesce("before.run_on", F.lit(0)) + F.when(F.coalesce("before.cut_no", F.lit(0)) == 0, F.col("carried")).otherwise(0)).alias("into"))
    each = found.join(into, ["file", "block"]).select("file", "block", "into", F.posexplode("counts").alias("ordinal", "n"))
    return each.select("file", "block", "ordinal", (F.col("n") + F.when(F.col("ordinal") == 0, F.col("into")).otherwise(0)).alias("n_tokens"))


def _ids(blocks: DataFrame) -> DataFrame:
    ids: Column = F.posexplode("doc_ids").alias("ordinal", "doc_id")
    return blocks.select("file", "block", ids)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, separator, kind = flat_files(table(spark, sf_dir, "documents"))
    counts = separator_scan(blocks, separator, kind)
    return _ids(blocks).join(counts, ["file", "block", "ordinal"], "left").select("doc_id", "n_tokens")
