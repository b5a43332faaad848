"""Mixing sources to target weights by Sainte-Laguë apportionment.

The size of a document is its number of words (runs without ASCII white space). Sources, in code point order
with null last, weigh 5, 2, 1 and so on again; the mix holds SHARE of all words. A source's target is its part by
weight, at most CAP times its size; what that leaves over is dealt to the others by weight, until none is above.

Quotas. The mix is cut into blocks of BLOCK words. Sources get blocks by the highest quotients target / (2n - 1);
a source's blocks go to its shards, by their sizes, in the same way. A shard holds about SHARD words or ROWS documents
of a source, whichever makes it smaller, drawn by a seeded hash of the id and the text.

Selection. A shard's documents, in seeded order, are one stream of words. Its quota takes the stream as often
as it holds it whole, and then the stream's first blocks. What a document gives is how much of it lies there, at
most CAP times its size. Equal seeds give equal mixes, however the input is split.

A source with a third of all rows is only ever summed by partial aggregates and then worked on by shard. The
table of sources, one short row each, is one task's group.

Defined results: null and empty texts have size 0 and give 0; a source of size 0 has target 0; a null source is a
source; repeated rows are documents of their own, in the order of their texts' hash; an empty table gives an
empty result; `mix` reads no other columns, and `mixed_texts` keeps them, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, small_batches, table, written

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BLOCK, SHARD, ROWS = 16, 1 << 24, 1 << 14
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients weight / (2n - 1); ties to the first."""
    w = np.asarray(weights, np.float64)
    if seats <= 0 or not w.sum() > 0:
        return np.zeros(len(w), np.int64)
    # all quotients above some divisor are a set of highest ones; then the next or the last few are put right
    got = np.floor(w * (seats / w.sum()) + 0.5).astype(np.int64)
    lack = int(seats - got.sum())
    if lack > 0:
        heap = [(-x / (2 * n + 1), i) for i, (x, n) in enumerate(zip(w.tolist(), got.tolist(), strict=True)) if x > 0]
    else:
        heap = [(x / (2 * n - 1), -i) for i, (x, n) in enumerate(zip(w.tolist(), got.tolist(), strict=True)) if n > 0]
    heapq.heapify(heap)
    for _ in range(abs(lack)):
        i = abs(heapq.heappop(heap)[1])
        got[i] += 1 if lack > 0 else -1
        if lack > 0:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
        elif got[i] > 0:
            heapq.heappush(heap, (w[i] / (2 * got[i] - 1), -i))
    return got


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, cap: float = CAP) -> np.ndarray:
    """Parts by weight of share times all sizes, none above cap times its size."""
    most, total = cap * sizes.astype(np.float64), share * float(sizes.sum())
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        level = (total - most[~open_].sum()) / weights[open_].sum()
        over = open_ & (most <= level * weights)
        if not over.any():
            out[open_] = level * weights[open_]
            break
        out[over], open_ = most[over], open_ & ~over
    return out


def _source_quotas(block: int, shard: int, rows: int):
    def run(sources: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(sources)), key=lambda i: (sources["source"].iloc[i] is None, sources["source"].iloc[i] or ""))
        s = sources.iloc[order].reset_index(drop=True)
        sizes = s["source_size"].to_numpy(np.int64)
        t = targets(sizes, np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(s))], np.float64))
        shards = np.maximum(1, np.maximum(-(-sizes // shard), -(-s["documents"].to_numpy(np.int64) // rows)))
        return s.drop(columns="documents").assign(target=t, blocks=sainte_lague(t, round(float(t.sum()) / block)), shards=shards)

    return run


def _shard_quotas(shards: pd.DataFrame) -> pd.DataFrame:
    s = shards.sort_values("shard").reset_index(drop=True)
    return s.assign(quota=sainte_lague(s["shard_size"].to_numpy(), int(s["blocks"].iloc[0])))[["source", "shard", "shard_size", "quota"]]


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block: int = BLOCK, shard: int = SHARD, rows: int = ROWS) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken), a row for each document."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("text_hash"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)).alias("draw")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    quotas = written(sources.groupBy().applyInPandas(_source_quotas(block, shard, rows), "source string, source_size long, target double, blocks long, shards long"), "quotas")
    q = quotas.withColumnRenamed("source", "of")
    dealt = sized.join(q, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("shard", F.pmod(F.xxhash64("draw"), "shards"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("blocks").alias("blocks"))
    shards = shards.groupBy("source").applyInPandas(_shard_quotas, "source string, shard long, shard_size long, quota long")
    shards = shards.select(F.col("source").alias("of"), F.col("shard").alias("nth"), "shard_size", "quota")
    stream = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("nth")))
    words = F.least(F.col("quota") * block, F.col("shard_size") * CAP)
    whole = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0)
    rest = words - whole * F.col("shard_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("doc_id", "source", "text_hash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_texts(documents: DataFrame, **how: object) -> DataFrame:
    """documents as the mix has them: whole copies of each text, and its first words where a block ends inside it."""
    cols = documents.columns
    id_, hash_, source_, size, taken, copy, words = fresh(documents, "id", "hash", "source_of", "size", "taken", "copy", "words")
    m = mix(documents, **how).where("taken > 0").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("source").alias(source_), F.col("size").alias(size), F.col("taken").alias(taken))
    doc, same = documents, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)) & F.col("source").cast("string").eqNullSafe(F.col(source_))
    m = written(m, "mix")
    if not m.groupBy(id_, hash_, source_).count().where("count > 1").isEmpty():
        # equal rows may be taken differently: the n-th of them in the mix goes to the n-th in the table
        nth, nth_ = fresh(documents, "nth", "nth_of")
        m = m.withColumn(nth_, F.row_number().over(Window.partitionBy(id_, hash_, source_).orderBy(F.desc(taken))))
        doc = documents.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), F.col("source").cast("string")).orderBy(F.lit(0))))
        same = same & (F.col(nth) == F.col(nth_))
    doc = doc.join(m, same)
    copies = F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))
    doc = doc.withColumn(copy, F.explode(copies)).withColumn(words, F.least(F.col(size), F.col(taken) - (F.col(copy) - 1) * F.col(size)))
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            whole, words = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            texts = [t if w == n else first_words(t, w) for t, n, w in zip(b.column(at).to_pylist(), whole, words, strict=True)]
            columns = [*b.columns[:-2]]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=cols)

    small_batches(documents.sparkSession)
    return doc.select(*cols, size, words).mapInArrow(run, schema)


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    return text[: next(itertools.islice(re.finditer(WORD, text), n - 1, None)).end()]


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
