"""Packing documents into sequences by bounded-space online best fit.

A document is its token ids and an end id. Those longer than a sequence are cut into pieces of its length; the
last piece may be shorter; no other document is cut. Pieces are dealt out to shards by a hash, and come in hashed
batches of about TOGETHER, the longest of a batch first. A packer keeps at most OPEN open bins. A bitset has a bit for each amount of free space that an open bin has, so the
fullest bin that still takes a piece is found by a shift and the lowest set bit. A piece that fits no open bin opens
one; if that is one too many, the fullest open bin is closed. Full bins close at once.

The bins that are open when a shard ends go on as wholes: those of MERGED shards are packed again as items of
their filled length, until one packer is left, so a sequence is left part full only at the very end or when it was the
fullest of OPEN bins. What a packer holds is bounded: OPEN bins, and OPEN * MERGED items.

Defined results: null and empty texts are one piece, the end id alone; equal rows are packed each by itself, and
pieces of one document need not lie in one sequence; an empty table gives an empty result; other columns are
not read, whatever their names. Reruns agree, as the order of pieces is that of a hash, the length, the id and the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .tokens import default_path, tokenizer

LENGTH, OPEN, END_ID = 2048, 4096, 0
#: Pieces of a shard, about, and shards whose open bins are packed together.
SHARD, MERGED = 1 << 17, 64
#: Pieces that come together, about; of these the longest come first.
TOGETHER = 1 << 14


class Packer:
    """Bounded-space best fit; bins are numbered in the order they are opened."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN) -> None:
        self.length, self.most_open = length, most_open
        self.free: dict[int, list[int]] = {}
        self.bits = self.opened = self.n_open = 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        return found

    def place(self, need: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece."""
        fits = self.bits >> need
        if fits:
            space = need + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.n_open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            space, found = self.length, self.opened
            self.opened += 1
            self.n_open += 1
        if space > need:
            self.free.setdefault(space - need, []).append(found)
            self.bits |= 1 << (space - need)
        else:
            self.n_open -= 1
        return found, self.length - space

    def still_open(self) -> dict[int, int]:
        """Free space by open bin."""
        return {b: space for space, bins in self.free.items() for b in bins}


def pieces(documents: DataFrame, path: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, tie): the pieces of all documents."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, end, step = tokenizer(path), np.array([END_ID], "<u4").tobytes(), 4 * length
        for b in batches:
            out = []
            for doc_id, text, tie in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = tokenize(text) + end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), tie))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)] if out else [pa.array([], t) for t in KINDS], names=NAMES)

    small_batches(documents.sparkSession)
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, tie long")


KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "tie"]


def _pack(length: int, most_open: int):
    """Adds bin, offset and, in a shard's last rows, the free space of the bins that stay open. Rows come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer = None, Packer(length, most_open)

        def left() -> pa.RecordBatch:
            open_ = sorted(packer.still_open().items())
            n = len(open_)
            return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([b for b, _ in open_], pa.int64()), pa.nulls(n, pa.int64()), pa.array([length - s for _, s in open_], pa.int64())], names=PACKED)

        for b in batches:
            shards, items, needs = (c.to_pylist() for c in b.columns)
            bins, offsets = [], []
            for i, (s, need) in enumerate(zip(shards, needs, strict=True)):
                if s != shard:
                    if bins:
                        yield _rows(shards, items, bins, offsets, i)
                    if shard is not None:
                        yield left()
                    bins, offsets, shard, packer = [], [], s, Packer(length, most_open)
                found, offset = packer.place(need)
                bins.append(found)
                offsets.append(offset)
            if bins:
                yield _rows(shards, items, bins, offsets, len(items))
        if shard is not None:
            yield left()

    return run


PACKED = ["shard", "item", "bin", "offset", "filled"]


def _rows(shards: list[int], items: list[int], bins: list[int], offsets: list[int], end: int) -> pa.RecordBatch:
    a = end - len(bins)
    return pa.RecordBatch.from_arrays([pa.array(shards[a:end], pa.int64()), pa.array(items[a:end], pa.int64()), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64()), pa.nulls(len(bins), pa.int64())], names=PACKED)


def pack(cut: DataFrame, length: int = LENGTH, most_open: int = OPEN, shard: int = SHARD, merged: int = MERGED) -> DataFrame:
    """`pieces` with sequence_id and offset."""
    schema = "shard long, item long, bin long, offset long, filled long"
    # a row's item is its place where it is written, so it stays the same when a lost task runs again
    rows = written(cut.withColumn("item", F.monotonically_increasing_id()), "items")
    total = rows.count()
    n = -(-total // shard) or 1
    order = F.xxhash64("doc_id", "piece", "tie")
    level = rows.select(F.pmod(order, F.lit(n)).alias("shard"), "item", "length", F.pmod(F.xxhash64(order), F.lit(-(-shard // TOGETHER) if n > 1 else -(-total // TOGETHER) or 1)).alias("batch"), order.alias("at"), "doc_id", "piece", "tie")
    level = level.repartition("shard").sortWithinPartitions("shard", "batch", F.desc("length"), "at", "doc_id", "piece", "tie", "item").select("shard", "item", "length")
    done = written(level.mapInArrow(_pack(length, most_open), schema), "packed")
    # bin names: the level, the shard and the number in it
    placed = done.where("filled is null").select("item", F.struct(F.lit(0).alias("level"), "shard", "bin").alias("bin"), "offset")
    step = 0
    while n > 1:
        n = -(-n // merged)
        bins = done.where("filled is not null").select(F.struct("shard", "bin").alias("was"), "filled")
        at = F.xxhash64("was.shard", "was.bin")
        items = written(bins.select(F.expr(f"was.shard div {merged}").alias("shard"), "was", F.col("filled").alias("length"), at.alias("at")).withColumn("item", F.monotonically_increasing_id()), "bins")
        done = written(items.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "at", "was").select("shard", "item", "length").mapInArrow(_pack(length, most_open), schema), "repacked")
        level_of = lambda k, shard, bin_: F.struct(F.lit(k).alias("level"), F.col(shard).alias("shard"), F.col(bin_).alias("bin"))
        moved = items.select("item", "was").join(done.where("filled is null"), "item")
        moved = moved.select(level_of(step, "was.shard", "was.bin").alias("bin"), level_of(step + 1, "shard", "bin").alias("to"), F.col("offset").alias("base"))
        placed = placed.join(moved, "bin", "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
        step += 1
    numbered = placed.select("item", "offset", ((F.col("bin.level") * F.lit(1 << 56)) + F.col("bin.shard") * F.lit(1 << 32) + F.col("bin.bin")).alias("sequence_id"))
    return rows.join(numbered, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
