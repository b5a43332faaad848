"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, Hamming check, connected components.

Fingerprint. A text is lower-cased (A-Z only) and split into words at ASCII white space; every run of
`width` words, repeats included, is hashed with XXH64 (seed 42). A bit is set if over half of the hashes
have it. A text of fewer words has its whole sequence as one shingle; no words or a null text: zero.

Blocks. Two 64-bit fingerprints that differ in at most 3 bits agree in one of 4 blocks of 16 bits, and in
one of 4 blocks of what remains. So 16 keys of 28 bits find every close pair. A bucket of more than
HOT_BUCKET fingerprints is cut again in the same way (the rest of the bits into 4 blocks, one of which
agrees), up to a key that leaves 2^21 possible fingerprints at most, without dropping any pair.

Only different fingerprints meet in buckets: copies are merged before. A bucket gives a spanning forest of
its links, not all pairs, which keeps its components. Components: large star and small star by turns, each
round written to the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows keep
their rows and share fingerprint and component; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, fresh, small_batches, table, written

SEED = 42
#: A bucket of more fingerprints is cut by a further block.
HOT_BUCKET = 4096
#: A node with more than one in so many of all edge ends is hot: there are fewer hot nodes than this.
HOT_NODES = 1 << 14
#: Shingles that are hashed and counted at once.
SLICE = 1 << 15


def fingerprint(text: bytes | None, width: int = 3) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    ends = ends[width - 1 :].tolist()
    digest, set_bits, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, SLICE):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + SLICE], ends[at : at + SLICE], strict=True)], np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a row for each document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    small_batches(documents.sparkSession)
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def _fields(bits: int) -> list[tuple[int, int]]:
    """(low bit, width) of 4 blocks that cover `bits` bits."""
    edges = [bits * i // 4 for i in range(5)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _finer(rows: DataFrame, bits: int) -> DataFrame:
    """(key, rest, fp, node) with 4 rows for each: the key has one block of the rest more, the rest has it less."""

    def cut(j: int, low: int, width: int) -> Column:
        block = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << width) - 1))
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", low + width), low) if low + width < bits else F.lit(0).cast("long")
        key = F.shiftleft("key", 2 + width).bitwiseOR(F.lit(j << width).cast("long")).bitwiseOR(block)
        return F.struct(key.alias("key"), below.bitwiseOR(above).alias("rest"))

    cuts = F.array(*(cut(j, low, width) for j, (low, width) in enumerate(_fields(bits))))
    return rows.select(F.explode(cuts).alias("cut"), "fp", "node").select("cut.key", "cut.rest", "fp", "node")


def _spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links of a bucket."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            found = left[near].tolist()
            edges += [(at, x) for x in found]
            queue += found
            left = left[~near]
    return edges


def _bucket_links(distance: int):
    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        two = start[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = [node[two]], [node[two + 1]]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if edges := _spanning(fp[s : s + n], distance):
                e = np.array(edges) + s
                a.append(node[e[:, 0]])
                b.append(node[e[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by key; the last bucket of each waits for the next."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols[1] = cols[1].view(np.uint64)
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [c[cut:] for c in cols]
            if cut:
                yield links(*(c[:cut] for c in cols))
        if held:
            yield links(*held)

    return run


def _buckets(nodes: DataFrame) -> list[DataFrame]:
    """(key, fp, node) for distinct (fp, node): buckets of at most HOT_BUCKET rows, or of the finest cut."""
    rows = nodes.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp", "node")
    rows, bits, found = _finer(_finer(rows, 64), 48), 36, []
    while bits > 21:
        hot = written(rows.groupBy("key").count().where(F.col("count") > HOT_BUCKET).select("key"), "hot")
        if hot.isEmpty():
            break
        found.append(rows.join(hot, "key", "left_anti"))
        rows, bits = _finer(rows.join(hot, "key"), bits), bits - bits // 4
    return [r.select("key", "fp", "node") for r in [*found, rows]]


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """(u, v), u > v: for distinct (fp, node), node pairs that span the components of fingerprints at most `distance` (3 at most) bits apart."""
    if not 0 <= distance <= 3:
        raise ValueError("the blocks find pairs of at most 3 differing bits")
    out = None
    for r in _buckets(nodes):
        e = r.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(distance), "u long, v long")
        out = e if out is None else out.unionByName(e)
    return out.distinct()


def _at_hubs(rows: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """rows joined with values (u, m, ends), ends being the rows of u among n: hot ones by broadcast, so a hub's rows stay where they are."""
    hot = F.col("ends") > n / HOT_NODES
    here = rows.join(F.broadcast(values.where(hot).select("u", "m")), "u", "left")
    rest = here.where("m is null").drop("m").join(values.where(~hot).select("u", "m"), "u")
    return here.where("m is not null").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (u, v) reaches, by large star and small star.

    A node may be in a third of all edges: its least neighbour comes from partial aggregates and goes to its edges.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    check = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    before = e.select(check).first()
    while before[0][0]:
        n = 2 * before[0][0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("ends"))
        large = _at_hubs(both.where("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("ends"))
        small = _at_hubs(large, low, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = e.select(check).first()
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(documents: DataFrame, width: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): a row for each document; component_id is the smallest doc_id that it reaches over links.

    A null doc_id takes part with its fingerprint; a component of null ids only has id null.
    """
    docs = written(fingerprints(documents, width, id_col, text_col), "fingerprints")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(links(nodes.where("node is not null"), distance))
    label = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return docs.join(label, "fp").select("doc_id", "fp", "component_id")


#: Least hashes in a sketch of shingles.
MINIMA = 128
#: One of so many texts is drawn for the counts of shingles, and a shingle is frequent from so many of them; at most so many frequent ones.
DRAWN, FREQUENT, MOST_FREQUENT = 16, 8, 1 << 20
#: How far under the wanted similarity a sketch's estimate may lie for a pair to be compared in full.
MARGIN = 0.25
#: Rows of an Arrow batch with two texts each.
PAIR_ROWS = 64
#: A bucket of more texts has one text compared with all others before all are compared with each other.
FEW = 4096
#: Partners that a text is compared with in the first round, and how many times as many in each next one.
MOST, MORE = 1, 64
TURNS = np.random.default_rng(64).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, width: int) -> list[bytes]:
    """Runs of `width` words of a text, lower-cased; the whole sequence if it has fewer."""
    words = (text or b"").lower().split()
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def _hashes(items: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, SEED) for x in items], np.uint64)


def hashed(text: bytes | None, width: int) -> np.ndarray:
    """The hashes of a text's different shingles, ascending."""
    return np.unique(_hashes(shingles(text, width)))


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Keys of the first shingles of a text, the rare ones first: two texts of at least `similarity` have one in common.

    A key has the rank of a frequent shingle (0 of any other) in its top 6 bits, then the hash.
    """
    keys = hashes >> np.uint64(6)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        keys |= np.where(frequent[at] == hashes, ranks[at], np.uint64(0)) << np.uint64(58)
    keys.sort()
    return keys[: len(keys) - math.ceil(similarity * len(keys) - 1e-6) + 1]


def sketch(h: np.ndarray) -> bytes:
    """16 bits of each of MINIMA least hashes of a text's shingles."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), SLICE // 16):
        x = h[a : a + SLICE // 16, None] * TURNS[None, :MINIMA]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, x.min(axis=0))
    return (least * TURNS[0] >> np.uint64(48)).astype("<u2").tobytes()


def _close_sets(similarity: float):
    mixed = lambda x: (x ^ (x >> np.uint64(31))) * TURNS[1]

    def may_link(n: np.ndarray, at: np.ndarray, n2: np.ndarray, at2: np.ndarray) -> np.ndarray:
        """Whether texts of n and n2 shingles can reach the similarity if their first common ones are at these places."""
        return np.minimum(n - at, n2 - at2) >= similarity / (1 + similarity) * (n + n2) - 1e-6

    def sets(key: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        two = start[size == 2]
        two = two[may_link(n[two], at[two], n[two + 1], at[two + 1])]
        a, b = np.minimum(node[two], node[two + 1]), np.maximum(node[two], node[two + 1])
        name = (mixed(mixed(a.view(np.uint64)) + b.view(np.uint64))).view(np.int64)
        out = [(name, a), (name, b)]
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own, k, i = node[s : s + m], n[s : s + m], at[s : s + m]
            if m <= FEW:
                near = [may_link(k[a : a + 256, None], i[a : a + 256, None], k[None, :], i[None, :]).sum(axis=1) > may_link(k[a : a + 256], i[a : a + 256], k[a : a + 256], i[a : a + 256]) for a in range(0, m, 256)]
                own = own[np.concatenate(near)]
            if len(own) > 1:
                own = np.sort(own)
                out.append((np.full(len(own), xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), np.int64), own))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["bucket", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (key, node, n, at) sorted by key: the texts of each bucket with another that may link, as (hash of the set, node)."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [c[cut:] for c in cols]
            if cut:
                yield sets(*(c[:cut] for c in cols))
        if held:
            yield sets(*held)

    return run


def proposals(label: np.ndarray, sketches: np.ndarray, least: float, most: int, star: bool = False) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of pairs of different labels whose sketches agree in a part of at least `least`, and whether there are more.

    Of each text, its `most` strongest ones; the texts of the largest label need not seek, as the others find them. If
    `star`, those of the first text of the largest label: in a large bucket they leave few labels in most.
    """
    _, of, sizes = np.unique(label, return_inverse=True, return_counts=True)
    largest = of == sizes.argmax()
    us, vs, more = [], [], star
    for x in [int(largest.argmax())] if star else np.flatnonzero(~largest).tolist():
        like = np.bitwise_count((sketches == sketches[x]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero((like >= least * sketches.shape[1]) & (of != of[x]))
        if len(near) > most and not star:
            near, more = near[np.argpartition(-like[near], most)[:most]], True
        us.append(np.full(len(near), x))
        vs.append(near)
    return np.concatenate(us or [np.zeros(0, np.int64)]), np.concatenate(vs or [np.zeros(0, np.int64)]), more


def _proposed(least: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (bucket, node, label, sketch) sorted by bucket and node. A bucket with more pairs but none yet gives a node with itself."""
        at, nodes, labels, held = None, [], [], []

        def found() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                star = most == MOST and len(nodes) > FEW
                x, y, more = proposals(np.array(labels), np.frombuffer(b"".join(held), "<u2").reshape(len(held), -1), least, most, star)
                own = np.array(nodes)
                if more and not len(x):
                    x = y = np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(own[x], own[y])), pa.array(np.minimum(own[x], own[y])), pa.array(np.full(len(x), more))], names=["u", "v", "more"])

        for b in batches:
            for bucket, node, label, sketched in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at:
                    yield from found()
                    at, nodes, labels, held = bucket, [], [], []
                nodes.append(node)
                labels.append(label)
                held.append(sketched)
        yield from found()

    return run


def _confirmed(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, last, own = [], None, set()
            for i, v in enumerate(b.column(1).to_pylist()):
                if v != last:
                    last, own = v, set(shingles(b.column(3)[i].as_py(), width))
                other = set(shingles(b.column(2)[i].as_py(), width))
                both = len(own & other)
                if both >= similarity * (len(own) + len(other) - both):
                    kept.append(i)
            rows = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["u", "v"])

    return run


def _print_links(documents: DataFrame, distance: int, id_col: str) -> DataFrame:
    """(u, v), u > v: pairs of ids that span the components of near_duplicates."""
    prints = written(fingerprints(documents, id_col=id_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    same = prints.join(nodes, "fp").where("doc_id > node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    return links(nodes, distance).unionByName(same)


def _linked(sets: DataFrame, sketches: DataFrame, text: DataFrame, width: int, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of the links inside the buckets of `sets` (bucket, node) and of `known` ones (u, v).

    In rounds: texts of a bucket that are not in one component yet are compared in full with their strongest partners of
    other components, and with MORE times as many in the next round, until every such pair has been compared.
    """
    left, tested, most = sets.withColumn("label", F.col("node")), None, MOST
    while True:
        full = left.join(sketches, "node").select("bucket", "node", "label", "sketch")
        full = full.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_proposed(similarity - MARGIN, most), "u long, v long, more boolean")
        given = written(full.groupBy("u", "v").agg(F.max("more").alias("more")), "candidates")
        pairs = given.where("u <> v")
        new = pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti")
        xy = new.select("u", "v").join(text.select(F.col("id").alias("u"), F.col("text").alias("x")), "u").join(text.select(F.col("id").alias("v"), F.col("text").alias("y")), "v").select("u", "v", "x", "y")
        with batches_of(text.sparkSession, PAIR_ROWS):
            hits = written(xy.mapInArrow(_confirmed(width, similarity), "u long, v long"), "links")
        found = components(hits if known is None else hits.unionByName(known))
        if given.where("more").isEmpty():
            return found
        tested = pairs.select("u", "v") if tested is None else tested.unionByName(new.select("u", "v"))
        found = written(found, "found")
        known = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        left = sets.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
        open_ = left.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("bucket")
        left, most = left.join(open_, "bucket"), most * MORE


def near_copies(documents: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", distance: int | None = None) -> DataFrame:
    """(text_hash, text_hash2, component_id): the near-duplicate groups of different texts, by their two hashes; component_id is the smallest doc_id of a group.

    Texts link if their shingles of `width` words have a Jaccard similarity of `similarity` or more. Candidates are all
    pairs with a common shingle among the first of each, rare ones first: as many that a pair without one can't reach the
    similarity. Where the common one stands in both bounds what they can reach. Buckets with the same texts are merged, and in
    each texts are compared in full with those that a sketch of the shingles finds alike, the most similar ones first, until
    they are in one component or no pair is left.

    With a `distance`, texts also link as in near_duplicates: if their SimHash fingerprints differ by at most so many bits,
    whatever their similarity. Both kinds of links make the components.

    Null texts are empty; texts without a word are alike, and texts of fewer words than a shingle are alike if all their
    words are. Rows without an id take no part. Equal texts are one, with the smallest of their ids.
    """
    spark = documents.sparkSession
    small_batches(spark)
    hashes = [F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit(1), F.col("text")).alias("text_hash2")]
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = written(slim.where("doc_id is not null").select("doc_id", *hashes).groupBy("text_hash", "text_hash2").agg(F.min("doc_id").alias("node")), "texts")
    # a text's smallest id stands for it
    stand = slim.select("doc_id", "text", *hashes).join(texts.select(F.col("node").alias("doc_id"), "text_hash", "text_hash2"), ["doc_id", "text_hash", "text_hash2"]).dropDuplicates(["doc_id", "text_hash", "text_hash2"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.concatenate([np.zeros(0, np.uint64), *(hashed(t, width) for t in b.column(0).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    # the order only saves work: pairs are found in any that is the same for all texts
    some = slim.select("text", hashes[0]).where(F.pmod("text_hash", F.lit(DRAWN)) == 0).dropDuplicates(["text_hash"])
    counts = some.select(F.col("text").cast("binary").alias("text")).mapInArrow(draw, "h long").groupBy("h").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    frequent = often.column("h").to_numpy().view(np.uint64)
    by_hash = np.argsort(frequent)
    frequent, ranks = frequent[by_hash], np.log2(often.column("n").to_numpy()[by_hash]).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [hashed(t, width) for t in b.column(1).to_pylist()]
            keys = [prefix(h, similarity, frequent, ranks).view(np.int64) for h in every]
            n = pa.array([len(h) for h in every], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(keys, pa.list_(pa.int64())), pa.array([sketch(h) for h in every], pa.binary())], names=["node", "text", "n", "keys", "sketch"])

    signed = written(stand.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, text binary, n long, keys array<long>, sketch binary"), "signed")
    rows = signed.select("node", "n", F.posexplode("keys").alias("at", "key")).select("key", "node", "n", F.col("at").cast("long").alias("at"))
    sets = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_close_sets(similarity), "bucket long, node long").distinct()
    sets = written(sets, "sets")
    known = None if distance is None else _print_links(signed, distance, "node")
    found = _linked(sets, signed.select("node", "sketch"), signed.select(F.col("node").alias("id"), "text"), width, similarity, known)
    return texts.join(found, "node", "left").select("text_hash", "text_hash2", F.coalesce("component", "node").alias("component_id"))


def one_of_each(documents: DataFrame, width: int = 5, similarity: float = 0.8, distance: int | None = None) -> DataFrame:
    """documents with one row of each group of near copies: the smallest doc_id's. Rows without an id stay."""
    cols = documents.columns
    groups = near_copies(documents, width, similarity, distance=distance)
    text = F.coalesce(F.col("text"), F.lit(""))
    # of the texts that hold the smallest id, the one with the smaller hash: rows of one id may differ
    own = documents.select(F.col("doc_id").cast("long").alias("component_id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")).distinct()
    own = own.join(groups.withColumnRenamed("text_hash", "h").withColumnRenamed("text_hash2", "g"), ["component_id", "h", "g"])
    id_, h, g = fresh(documents, "id", "h", "g")
    first = own.groupBy("component_id").agg(F.min(F.struct("h", "g")).alias("t")).select(F.col("component_id").alias(id_), F.col("t.h").alias(h), F.col("t.g").alias(g))
    kept = documents.join(first, (F.col("doc_id") == F.col(id_)) & (F.xxhash64(text) == F.col(h)) & (F.xxhash64(F.lit(1), text) == F.col(g)))
    once = kept.dropDuplicates([id_, h, g]).select(*cols)
    return once.unionByName(documents.where("doc_id is null"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
