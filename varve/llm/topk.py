"""Exact top-k inner-product search by a three-phase uniform threshold.

Every component x becomes floor(1024 * x); the score of two vectors is the integer inner product. A vector is
cut into PARTS ranges of components. A node is one block of candidates with one range: its local score list
holds, for each query, the candidates' partial products over that range.

1. Gather: each node ranks its candidates by their partial products and lists the k best for each query. What a task's
   lists name is multiplied out, and its k best whole products go on. The k-th best of all these is a safe cutoff t.
2. Collect: a total of t or more needs a partial product of t / PARTS or more in some range. With the cutoffs at hand,
   each node picks all entries that reach their share. Partial products are made again for this: stored, they would be
   16 bytes for each of the few per cent of all pairs that are picked, many times the input.
3. Resolve: the picked candidates' whole products are computed, each task keeps its k best of them, and the best k
   over all tasks are the result.

Lists and picks may use rounded products, lowered by a bound on the rounding; whole products are exact.

Queries come in full blocks, and GROUP bytes of them at a time are broadcast to the candidates' blocks, which stay
where they are: a candidate is read for each such group and never shuffled. What is shuffled is k rows a query and task.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of other
lengths than the query's are not its candidates; a candidate with the query's own id is the query's own row;
rows of equal id are all candidates, and each of them is a query if the id is one; ties go to the smaller id;
fewer candidates than k give all of them; an empty table gives no rows. Products beyond 2^53 are computed with
Python's integers and held to the range of a long. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, small_batches, table, written

SCALE = 1024
#: Candidates and queries in a block, and queries whose products are in memory at once.
CANDIDATES, QUERIES, SLICE = 8192, 2048, 256
#: Bytes of query blocks that are broadcast together.
GROUP = 32 << 20
PARTS = 2
#: In float64, sums of integers are exact up to this; a float32 product of vectors is off by their lengths times ROUNDING and a component's count, at most.
EXACT, ROUNDING = float(1 << 53), 2.0**-23
#: Larger numbers than this are not rounded to float32.
BEYOND = 1e37


def _blocks(vectors: DataFrame, rows: int, kind: str) -> DataFrame:
    """(dim, block, ids, data): at most `rows` vectors of one length in a row, as bytes of int64 ids and float64 components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        n = 0
        part = None

        def row(dim: int) -> pa.RecordBatch:
            nonlocal n
            got, n = held.pop(dim), n + 1
            ids, data = np.array([i for i, _ in got], np.int64), np.concatenate([v for _, v in got]) if dim else np.zeros(0)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([f"{part}:{n}"]), pa.array([ids.tobytes()]), pa.array([data.tobytes()])], names=["dim", "block", "ids", "data"])

        for b in batches:
            for vec_id, p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                part = p
                v = np.floor(SCALE * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                held.setdefault(len(v), []).append((vec_id, v))
                if len(held[len(v)]) >= rows:
                    yield row(len(v))
        for dim in list(held):
            yield row(dim)

    part = F.spark_partition_id()
    slim = vectors.select("vec_id", part.alias("part"), "embedding")
    return written(slim.mapInArrow(run, "dim int, block string, ids binary, data binary"), kind)


def _matrix(data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, dim)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products, in float64 where that is exact."""
    most = (np.abs(q).max(initial=0) * np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return q @ v.T
    ints = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return ints(q) @ ints(v).T


def _long(x: object) -> int:
    return min(max(int(x), -(1 << 63)), (1 << 63) - 1)


def _ranges(dim: int) -> list[slice]:
    edges = [dim * i // PARTS for i in range(PARTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to smaller ids."""
    if len(scores) > k:
        floor = np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def _picks(q: np.ndarray, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each range the partial products, rounded, and by how much each query's may be too low."""
    out = []
    for part in _ranges(q.shape[1]):
        a, b = q[:, part], v[:, part]
        far = np.sqrt((a**2).sum(axis=1)) * np.sqrt((b**2).sum(axis=1).max(initial=0))
        unit = ROUNDING
        if max(far.max(initial=0), np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < BEYOND:
            a, b = a.astype(np.float32), b.astype(np.float32)
        else:
            unit = 4 / EXACT
        out.append((a @ b.T, far * unit * (a.shape[1] + 4)))
    return out


class _Running:
    """The k best (score, vec_id) of each query of a block over all that a task has seen; repeated rows are kept apart."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(n)]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = self.rows[i] + [(-x, d) for x, d in zip(scores.tolist(), ids.tolist(), strict=True)]
        own.sort()
        self.rows[i] = own[: self.k]


def _phase(k: int, resolve: bool):
    """Over (dim, q_block, q_ids, q_data, cutoffs, ids, data): (query_id, q_block, q, vec_id, score), k of each query and task at most.

    Phase 1 gives whole products of what the lists name, phases 2 and 3 the best of what reaches its share of the cutoff.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, _Running]] = {}
        for b in batches:
            for dim, block, q_ids, q_data, cutoffs, ids, data in zip(*(b.column(n).to_pylist() for n in ("dim", "q_block", "q_ids", "q_data", "cutoffs", "ids", "data")), strict=True):
                qids, vids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q, v = _matrix(q_data, dim, len(qids)), _matrix(data, dim, len(vids))
                _, best = found.setdefault(block, (qids, _Running(len(qids), k)))
                cut = np.full(len(qids), -np.inf)
                for c in cutoffs or []:
                    cut[c["q"]] = c["cutoff"]
                for a in range(0, len(qids), SLICE):
                    parts = _picks(q[a : a + SLICE], v)
                    for i in range(a, min(a + SLICE, len(qids))):
                        if resolve:
                            share = cut[i] / PARTS
                            named = np.zeros(len(vids), bool)
                            for s, slack in parts:
                                named |= s[i - a] >= share - abs(share) * ROUNDING - slack[i - a]
                            at = np.flatnonzero(named & (vids != qids[i]))
                        else:
                            at = [np.argpartition(-s[i - a], k)[: k + 1] if len(vids) > k + 1 else np.arange(len(vids)) for s, _ in parts]
                            at = np.unique(np.concatenate(at))
                            at = at[vids[at] != qids[i]]
                        if len(at):
                            s = _products(q[i : i + 1], v[at])[0]
                            top = _best(s, vids[at], k)
                            best.add(i, s[top], vids[at][top])
        for block, (qids, best) in found.items():
            rows = [(int(qids[i]), i, d, _long(-x)) for i, own in enumerate(best.rows) for x, d in own]
            query_id, at, vec_id, score = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(query_id, pa.int64()), pa.array([block] * len(rows), pa.string()), pa.array(at, pa.int32()), pa.array(vec_id, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "q_block", "q", "vec_id", "score"])

    return run


def _taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col(vector_col)
    fit: Column = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(x.isNotNull() & fit & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("embedding"))


FOUND = "query_id long, q_block string, q int, vec_id long, score long"


def _top(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_block", "q").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores."""
    spark = candidates.sparkSession
    small_batches(spark)
    asked = _taking_part(queries, id_col, vector_col)
    n = asked.count()
    q = _blocks(asked.repartition(max(1, -(-n // QUERIES)), "vec_id"), QUERIES, "queries")
    v = _blocks(_taking_part(candidates, id_col, vector_col), CANDIDATES, "candidates")
    q = q.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    size = q.agg(F.sum(F.length("q_ids") + F.length("q_data"))).first()[0] or 0
    # blocks are of one size but the last of each input, so their groups are about `group` bytes; a block is the least
    groups = max(1, -(-size // group))
    none = F.lit(None).cast("array<struct<q: int, cutoff: double>>")
    out = None
    with batches_of(spark, 2):
        for g in range(groups):
            own = q.where(F.pmod(F.xxhash64("q_block"), F.lit(groups)) == g) if groups > 1 else q
            scan = lambda own: v.join(F.broadcast(own), "dim")
            lists = written(scan(own.withColumn("cutoffs", none)).mapInArrow(_phase(k, False), FOUND), "lists")
            cut = _top(lists, k).where(F.col("rank") == k).groupBy("q_block").agg(F.collect_list(F.struct("q", F.when(F.col("score") > -(1 << 63), F.col("score").cast("double")).otherwise(float("-inf")).alias("cutoff"))).alias("cutoffs"))
            best = written(scan(own.join(cut, "q_block", "left")).mapInArrow(_phase(k, True), FOUND), "best")
            out = best if out is None else out.unionByName(best)
    return _top(out, k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors.where("vec_id % 100 = 0"), vectors)


OP1_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
  FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND len(e.v) = len(q.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
