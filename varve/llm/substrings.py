"""Exact removal of long repeated byte strings through a run-length index.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or in the same
document before. Strings are judged on the input; matches never cross documents.

Anchors. Each window of LENGTH bytes is owned by the GRAM-byte string in it with the least hash, the first of
equals. Equal windows have the same owner at the same place, so they only need to be looked for among windows
whose owners hold the same bytes. Consecutive windows with one owner are a context: about every 39th byte starts
one. A context travels as two hashes of 64 bits, of its owner and of all its bytes, with its place. Equal contexts of
a task's slice are merged before the shuffle, so copies and common passages send one row a slice.

Resolving. Contexts are dealt by owner and sorted. A context alone with its owner is new. All but the first of equal
contexts repeat as a whole. Owners with different contexts need the bytes: the first of each is read again. Owners of
more than HOT contexts, counted before, are not dealt by owner: aggregates by owner and context settle them.

Index. Groups of such contexts, a MB or a few together, are sorted into a Burrows-Wheeler transform. Only its runs are kept: the
runs' starts and characters, the rank of each run's first row, the text places sampled at run ends, and the rows where
a match with the row before is shorter than LENGTH. Contexts are streamed through it from their last byte
to their first, all at once, one step of the LF mapping each: a row's matching statistic says whether it matches
another suffix for LENGTH bytes or more, and the first place of such a class says whether one starts earlier. Those are
the long matches that are marked. A walk's place is checked against the samples wherever it meets a run end.

An owner of more than HOT different contexts, which are more than an index takes, is not indexed: its windows are hashed
to 128 bits one by one and their first places found by an aggregate, so no owner is unbounded in a task.

Defined results: a null text is empty; texts shorter than LENGTH stay whole; rows of equal doc_id are places in the
same document, so equal rows are not earlier than each other and get equal results; an empty table gives an
empty result. Other columns are not read, whatever their names. doc_id must not be null where a text is to be
compared: rows without an id stay whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

LENGTH, GRAM = 100, 24
#: Bytes of text whose windows are hashed at once, contexts of a slice, bytes of contexts indexed together, and most bytes of one owner's.
TEXT, CONTEXTS, INDEXED, LARGEST = 1 << 18, 1 << 17, 1 << 20, 3 << 20
#: Contexts of one owner from which they are compared by window: what LARGEST bytes hold of the longest ones.
HOT = LARGEST // (2 * LENGTH - GRAM)
#: Owners of more contexts than HOT that are broadcast, 8 bytes each.
HEAVY = 1 << 20
_RANDOM = np.random.default_rng(20240229)
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= ODD[6]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (24) bytes from each place of x on, by doubling."""
    sixteen, eight = BYTE[x], None
    for k in range(4):  # of 2, 4, 8 and 16 bytes
        eight, half = sixteen, 1 << k
        sixteen = _mixed(eight[:-half] * ODD[k] + eight[half:])
    n = len(x) - GRAM + 1
    return _mixed(sixteen[:n] * ODD[4] + eight[16 : 16 + n])


def contexts(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner hash, first window, windows) of the contexts of texts that lie one after another and end at `ends`."""
    n = len(x) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = gram_hashes(x)
    place = np.arange(len(g), dtype=np.uint64)
    least = (g & ~np.uint64((1 << 24) - 1)) | place
    span, width = LENGTH - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    owner = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    new = np.flatnonzero(np.concatenate(([True], owner[at[1:]] != owner[at[:-1]])))
    return _mixed(g[owner[at[new]]]), at[new], np.diff(np.append(new, len(at)))


FOUND = ["h", "c", "doc_id", "crc", "lo", "n", "whole"]
FOUND_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
FOUND_SCHEMA = "h long, c long, doc_id long, crc int, lo int, n int, whole boolean"


def _merged(doc: np.ndarray, crc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Covered runs (doc_id, crc, first byte, bytes) with those that touch put together."""
    order = np.lexsort((lo, crc, doc))
    doc, crc, lo, end = doc[order], crc[order], lo[order].astype(np.int64), (lo[order] + n[order]).astype(np.int64)
    if not len(doc):
        return doc, crc, lo, end
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])))
    group = np.cumsum(new)
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    cut = np.concatenate(([True], new[1:] | (lo[1:] > reach[:-1])))
    first = np.flatnonzero(cut)
    return doc[first], crc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1] - lo[first]


def _signed_crc(data: bytes) -> int:
    return zlib.crc32(data) - (1 << 31)


def _crc(text: Column) -> Column:
    return (F.crc32(text.cast("binary")) - F.lit(1 << 31)).cast("int")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of all texts; within a slice, equal ones but the first as covered runs (whole)."""
    rows: list[tuple[np.ndarray, ...]] = []
    held = 0
    digest = xxhash.xxh3_64_intdigest

    def add(parts: list[tuple[int, bytes, int]], start: int = 0) -> None:
        nonlocal held
        data = b"".join(p[1] for p in parts)
        ends = np.cumsum([len(p[1]) for p in parts])
        h, lo, n = contexts(np.frombuffer(data, np.uint8), ends)
        if not len(h):
            return
        c = np.fromiter((digest(data[a:b]) for a, b in zip(lo.tolist(), (lo + n + LENGTH - 1).tolist(), strict=True)), np.uint64, len(h))
        which = np.searchsorted(ends, lo, side="right")
        begin = np.concatenate(([0], ends[:-1]))[which]
        rows.append((h.view(np.int64), c.view(np.int64), np.array([p[0] for p in parts], np.int64)[which], np.array([p[2] for p in parts], np.int32)[which], (lo - begin + start).astype(np.int32), n.astype(np.int32)))
        held += len(h)

    def flush() -> pa.RecordBatch:
        nonlocal rows, held
        h, c, doc, crc, lo, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        rows, held = [], 0
        order = np.lexsort((lo, doc, c, h))
        h, c, doc, crc, lo, n = (x[order] for x in (h, c, doc, crc, lo, n))
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & ((doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1]))))
        # equal places of rows with one id are not earlier than each other, so both stay if either is a first
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (doc[1:] == doc[:-1]) & (lo[1:] == lo[:-1])))
        if same.any():
            head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))))
            of = head[np.searchsorted(head, np.arange(len(h)), side="right") - 1]
            again = (doc != doc[of]) | (lo != lo[of])
        d, k, a, m = _merged(doc[again], crc[again], lo[again], n[again] + LENGTH - 1)
        key = d * np.int64(-7046029254386353131) + a  # spreads covered runs over tasks
        out = [(np.concatenate(x)) for x in ((h[~again], key), (c[~again], np.zeros(len(d), np.int64)), (doc[~again], d), (crc[~again], k), (lo[~again], a), (n[~again], m), (np.zeros(int((~again).sum()), bool), np.ones(len(d), bool)))]
        return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(out, FOUND_KINDS, strict=True)], names=FOUND)

    for b in batches:
        parts, size = [], 0
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if doc_id is None or len(text or b"") < LENGTH:
                continue
            crc = _signed_crc(text)
            if len(text) > TEXT:
                for a in range(0, len(text) - LENGTH + 1, TEXT):
                    add([(doc_id, text[a : a + TEXT + LENGTH - 1], crc)], a)
                continue
            parts.append((doc_id, text, crc))
            size += len(text)
            if size >= TEXT:
                add(parts)
                parts, size = [], 0
        if parts:
            add(parts)
        if held >= CONTEXTS:
            yield flush()
    if held:
        yield flush()


RESOLVED = ["kind", "h", "doc_id", "crc", "lo", "n"]
RESOLVED_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
RESOLVED_SCHEMA = "kind int, h long, doc_id long, crc int, lo int, n int"
COVERED, INDEX, WINDOWS = 0, 1, 2


def _resolve(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by owner, bytes and place: covered runs, and the contexts of owners that have different ones."""
    last: tuple | None = None  # owner, bytes and place of the first of the equal contexts that the last batch ended in
    open_: list[np.ndarray] = []  # first contexts of the owner that it ended in, while they may all be indexed
    n_open, hot = 0, False

    def rows(kind: int, h: np.ndarray, doc: np.ndarray, crc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind)).cast(pa.int32()), *(pa.array(x).cast(t) for x, t in zip((h, doc, crc, lo, n), RESOLVED_KINDS[1:], strict=True))], names=RESOLVED)

    for b in batches:
        if not b.num_rows:
            continue
        whole = b.column(6).to_numpy(zero_copy_only=False)
        cols = [x.to_numpy(zero_copy_only=False) for x in b.columns[:6]]
        if whole.any():
            h, _, doc, crc, lo, n = (x[whole] for x in cols)
            yield rows(COVERED, h, doc, crc, lo, n)
            cols = [x[~whole] for x in cols]
        h, c, doc, crc, lo, n = cols
        if not len(h):
            continue
        new = np.concatenate(([last is None or h[0] != last[0] or c[0] != last[1]], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        head = np.flatnonzero(new)
        of = np.searchsorted(head, np.arange(len(h)), side="right") - 1
        d0 = np.where(of >= 0, doc[head[of]] if len(head) else 0, last[2] if last else 0)
        l0 = np.where(of >= 0, lo[head[of]] if len(head) else 0, last[3] if last else 0)
        again = (doc != d0) | (lo != l0)
        if again.any():
            yield rows(COVERED, h[again], doc[again], crc[again], lo[again], n[again] + LENGTH - 1)
        last = (h[-1], c[-1], d0[-1], l0[-1])
        firsts = np.stack([x[~again].astype(np.int64) for x in (h, doc, crc, lo, n)] + [new[~again].astype(np.int64)])
        if not firsts.shape[1]:
            continue
        at = np.flatnonzero(np.concatenate(([True], firsts[0, 1:] != firsts[0, :-1])))
        groups = np.split(firsts, at[1:], axis=1) if len(at) < 2 else [firsts[:, : at[1]], firsts[:, at[1] : at[-1]], firsts[:, at[-1] :]]
        # the first group may go on from before, the last may go on after; between them all are complete
        if open_ and groups[0][0, 0] != open_[0][0, 0]:
            yield from _close(rows, open_, hot)
            open_, n_open, hot = [], 0, False
        for i, g in enumerate(groups):
            if not g.shape[1]:
                continue
            if 0 < i < len(groups) - 1:
                start = np.flatnonzero(np.concatenate(([True], g[0, 1:] != g[0, :-1])))
                several = np.repeat(np.add.reduceat(g[5], start) > 1, np.diff(np.append(start, g.shape[1])))
                size = np.repeat(np.diff(np.append(start, g.shape[1])), np.diff(np.append(start, g.shape[1])))
                for kind, pick in ((INDEX, several & (size <= most)), (WINDOWS, several & (size > most))):
                    if pick.any():
                        yield rows(kind, *g[:5, pick])
                continue
            if i == len(groups) - 1 and i:
                yield from _close(rows, open_, hot)
                open_, n_open, hot = [], 0, False
            open_.append(g)
            n_open += g.shape[1]
            if n_open > most:  # what is held goes on, so that no more contexts than that are
                hot = True
                yield rows(WINDOWS, *np.concatenate(open_, axis=1)[:5])
                open_, n_open = [g[:, -1:]], 0  # the owner, for what comes; a row that is sent again does no harm: its windows are the same places
    yield from _close(rows, open_, hot)


def _close(rows, open_: list[np.ndarray], hot: bool) -> Iterator[pa.RecordBatch]:
    if not open_:
        return
    g = np.concatenate(open_[1:] if hot else open_, axis=1) if len(open_) > hot else None
    if g is not None and g.shape[1] and (hot or g[5].sum() > 1):
        yield rows(WINDOWS if hot else INDEX, *g[:5])


class RunLengthIndex:
    """The Burrows-Wheeler transform of texts, as runs, with what a walk from the last byte to the first needs.

    The text is each string and a terminator of its own, smaller than any byte and than those that come later.
    """

    def __init__(self, strings: list[bytes], length: int = LENGTH) -> None:
        m = len(strings)
        self.sizes = np.fromiter(map(len, strings), np.int64, m)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + m
        symbols[self.begin + self.sizes] = np.arange(m)
        suffixes, half, rest = self._sorted(symbols, m + 256, length)
        before = symbols[suffixes - 1]
        change = np.concatenate(([True], before[1:] != before[:-1]))
        self.starts = np.flatnonzero(change)
        self.chars = before[self.starts]
        lengths = np.diff(np.append(self.starts, len(before)))
        order = np.argsort(self.chars, kind="stable")
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.cumsum(lengths[order]) - lengths[order]
        self.moves = ranks - self.starts  # LF moves all rows of a run by as much
        self.samples = suffixes[self.starts], suffixes[self.starts + lengths - 1]
        beyond = np.minimum(suffixes + rest, len(symbols) - 1)
        short = (half[suffixes][1:] != half[suffixes][:-1]) | (half[beyond][1:] != half[beyond][:-1])
        self.cuts = np.flatnonzero(short) + 1  # the rows where a class of equal long matches begins, but for the first

    @staticmethod
    def _sorted(symbols: np.ndarray, top: int, length: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The suffix array, ranks by the first 2^k <= length symbols, and length - 2^k."""
        n, bits = len(symbols), max(1, (top - 1).bit_length())
        width = 4 if 4 * bits < 63 else 2 if 2 * bits < 63 else 1
        key = symbols.copy()
        for k in range(1, width):
            key = (key << bits) | np.concatenate((symbols[k:], np.zeros(k, np.int64)))[:n]
        # a rank is the place of the first suffix that is equal so far; only suffixes with equals are sorted on
        rank, open_, old, half = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), None
        while True:
            order = np.argsort(key)
            open_, key, old = open_[order], key[order], old[order]
            at = np.arange(len(open_))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.concatenate(([True], old[1:] != old[:-1]))
            rank[open_] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            if width <= length < 2 * width:
                half, rest = rank.copy(), length - width
            open_ = open_[~(new & np.append(new[1:], True))]
            if not len(open_):
                suffixes = np.empty(n, np.int64)
                suffixes[rank] = np.arange(n)
                return (suffixes, rank, 0) if half is None else (suffixes, half, rest)
            old, beyond = rank[open_], open_ + width
            key = (old << 32) | np.where(beyond < n, rank[np.minimum(beyond, n - 1)], 0)
            width *= 2

    def runs(self, rows: np.ndarray) -> np.ndarray:
        """The runs that rows lie in."""
        return np.searchsorted(self.starts, rows, side="right") - 1

    def streamed(self) -> tuple[np.ndarray, np.ndarray]:
        """Each string's rows from its last byte to its first: (place in the text, class of equal long matches)."""
        order = np.argsort(-self.sizes, kind="stable")
        rows, begin, sizes = order, self.begin[order], self.sizes[order]
        run, places, seen = self.runs(rows), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        first, final = self.samples
        for t in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -t, side="right"))
            rows = rows[:active] + self.moves[run[:active]]  # LF: the suffixes one byte longer
            run, begin, sizes = self.runs(rows), begin[:active], sizes[:active]
            place = begin + sizes - t
            if not ((self.starts[run] != rows) | (first[run] == place)).all():
                raise AssertionError("a walk left its text")
            places.append(place)
            seen.append(rows)
        return np.concatenate(places), np.searchsorted(self.cuts, np.concatenate(seen), side="right")


def long_matches(strings: list[bytes], doc: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows, among the first n of each string, that start earlier elsewhere too. Strings come in the order of (doc, lo)."""
    index = RunLengthIndex(strings, length)
    place, kind = index.streamed()
    string = np.searchsorted(index.begin, place, side="right") - 1
    offset = place - index.begin[string]
    own = offset < n[string]
    place, kind, string, offset = place[own], kind[own], string[own], offset[own]
    first = np.full(len(index.cuts) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, kind, place)
    there = first[kind]
    of = np.searchsorted(index.begin, there, side="right") - 1
    earlier = (doc[of] < doc[string]) | ((doc[of] == doc[string]) & (lo[of] + there - index.begin[of] < lo[string] + offset))
    return string[earlier], offset[earlier]


COVERS = ["doc_id", "crc", "lo", "n"]
COVERS_SCHEMA = "doc_id long, crc int, lo int, n int"


def _covers(doc: np.ndarray, crc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(_merged(doc, crc, lo, n), RESOLVED_KINDS[2:], strict=True)], names=COVERS)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by owner: groups are put together up to INDEXED bytes, indexed and streamed."""
    held: list[tuple] = []
    size, owner = 0, None

    def run() -> pa.RecordBatch:
        nonlocal held, size
        rows, held, size = sorted(held, key=lambda r: (r[0], r[2])), [], 0
        doc, crc, lo, n = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        string, offset = long_matches([r[4] for r in rows], doc, lo, n)
        return _covers(doc[string], crc[string], lo[string] + offset, np.full(len(string), LENGTH, np.int64))

    for b in batches:
        for h, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if h != owner and size >= INDEXED:
                yield run()
            owner = h
            held.append(row)
            size += len(row[4])
    if held:
        yield run()


FETCHED = {"kind": pa.int32(), "h": pa.int64(), "doc_id": pa.int64(), "crc": pa.int32(), "lo": pa.int32(), "n": pa.int32(), "context": pa.binary()}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each document's contexts that are asked for."""
    for b in batches:
        out = [(f["kind"], f["h"], doc_id, crc, f["lo"], f["n"], text[f["lo"] : f["lo"] + f["n"] + LENGTH - 1]) for doc_id, crc, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True) for f in found]
        columns = zip(*out, strict=True) if out else [[]] * len(FETCHED)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, FETCHED.values(), strict=True)], names=list(FETCHED))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the contexts (doc_id, crc, lo, n, context) by itself, as two hashes."""
    names, kinds = ["h", "c", "doc_id", "crc", "lo"], [pa.int64(), *RESOLVED_KINDS[1:5]]
    for b in batches:
        out = [(xxhash.xxh3_64_intdigest(w) - (1 << 63), xxhash.xxh3_64_intdigest(w, 1) - (1 << 63), doc_id, crc, lo + s) for doc_id, crc, lo, n, context in zip(*(c.to_pylist() for c in b.columns), strict=True) for s in range(n) for w in (context[s : s + LENGTH],)]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _fetch(documents: DataFrame, resolved: DataFrame) -> DataFrame:
    """The contexts of `resolved` that are to be indexed or cut into windows, with their bytes: one join of the documents for both."""
    wanted = resolved.where(F.col("kind") != COVERED).groupBy(F.col("doc_id").alias("id"), F.col("crc").alias("sum")).agg(F.collect_list(F.struct("kind", "h", "lo", "n")).alias("found"))
    there = documents.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("crc") == F.col("sum"))).select("doc_id", "crc", "text", "found")
    return there.mapInArrow(_read, "kind int, h long, doc_id long, crc int, lo int, n int, context binary")


def _resolved_heavy(found: DataFrame, hot: int, n_owners: int) -> DataFrame:
    """What _resolve gives for owners of many contexts, by aggregates: no owner's contexts meet in one task."""
    place = F.struct("doc_id", "lo")
    first = written(found.groupBy("h", "c").agg(F.min(place).alias("first")), "first")
    sizes = first.groupBy("h").agg(F.count("*").alias("contexts"))
    kind = F.when(place > F.col("first"), COVERED).when(F.col("contexts") > hot, WINDOWS).when(F.col("contexts") > 1, INDEX)
    rows = found.join(first, ["h", "c"]).join(F.broadcast(sizes) if n_owners <= HEAVY else sizes, "h").withColumn("kind", kind).where("kind is not null")
    n = F.when(F.col("kind") == COVERED, F.col("n") + LENGTH - 1).otherwise(F.col("n"))
    return rows.select(F.col("kind").cast("int").alias("kind"), "h", "doc_id", "crc", "lo", n.cast("int").alias("n"))


def covered_runs(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, crc, lo, n): runs of bytes to remove, which may overlap; documents are (doc_id long, text binary, crc)."""
    small_batches(documents.sparkSession)
    found = written(documents.select("doc_id", "text").mapInArrow(_find, FOUND_SCHEMA), "contexts")
    heavy = written(found.where("not whole").groupBy("h").count().where(F.col("count") > hot).select("h"), "heavy")
    n_heavy = heavy.count()
    cold = found
    if n_heavy:
        heavy = F.broadcast(heavy) if n_heavy <= HEAVY else heavy
        cold = found.where("whole").unionByName(found.where("not whole").join(heavy, "h", "left_anti"))
    dealt = cold.repartition("h").sortWithinPartitions("h", "c", "doc_id", "lo")
    resolved = dealt.mapInArrow(lambda batches: _resolve(batches, hot), RESOLVED_SCHEMA)
    if n_heavy:
        resolved = resolved.unionByName(_resolved_heavy(found.where("not whole").join(heavy, "h"), hot, n_heavy))
    resolved = written(resolved, "resolved")
    fetched = written(_fetch(documents, resolved), "fetched")
    indexed = fetched.where(F.col("kind") == INDEX).repartition("h").sortWithinPartitions("h").select("h", "doc_id", "crc", "lo", "n", "context").mapInArrow(_match, COVERS_SCHEMA)
    out = resolved.where(F.col("kind") == COVERED).select(*COVERS).unionByName(written(indexed, "matched"))
    crowded = fetched.where(F.col("kind") == WINDOWS)
    if not crowded.isEmpty():
        windows = written(crowded.select("doc_id", "crc", "lo", "n", "context").mapInArrow(_windows, "h long, c long, doc_id long, crc int, lo int"), "windows")
        first = windows.groupBy("h", "c").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.max(F.struct("doc_id", "lo")).alias("last")).where("first < last")
        # written first, so that its size is known when the join is planned
        again = windows.join(written(first.select("h", "c", "first"), "repeated"), ["h", "c"]).where(F.struct("doc_id", "lo") > F.col("first"))
        out = out.unionByName(again.select("doc_id", "crc", "lo", F.lit(LENGTH).alias("n")))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            kept, at, spans, text = [], 0, 0, text or b""
            for a, e in sorted((r["lo"], r["lo"] + r["n"]) for r in runs or []):
                if a > at or not spans:
                    kept.append(text[at:a])
                    spans += 1
                at = max(at, e)
            left = b"".join([*kept, text[at:]])
            out.append((len(text), len(text) - len(left), spans, left))
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary), a row for each document."""
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).withColumn("crc", _crc(F.coalesce(F.col("text"), F.lit(b""))))
    runs = covered_runs(slim, hot).groupBy(F.col("doc_id").alias("id"), F.col("crc").alias("sum")).agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    doc = slim.join(runs, (F.col("doc_id") == F.col("id")) & (F.col("crc") == F.col("sum")), "left").select("doc_id", "text", "runs")
    return doc.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
