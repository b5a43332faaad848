"""A store on disk: a framed log for small writes, sorted Parquet runs in levels, a manifest with a pointer.

    CURRENT                       the name of the manifest in use, replaced by a rename
    manifest/MANIFEST-000001      the whole state at a version, as JSON; never changed
    log/000007.log                a batch, until a run holds it
    runs/000009-.../              a folder of Parquet files, sorted by (key, seq descending)

A write is durable once its log, or for bulk writes its run and manifest, is published. Readers take one version and
only read files that never change, so they need no lock. Two writers can't publish the same version: the second fails.
Level 0 runs may overlap; the files of a lower level never share a key, as they are cut by ranges of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bytesfn import STATUS
from ..model import DELETE, FILES_SCHEMA, LEVELS, MUT_SCHEMA, PUT
from ..operators import lsm, scan, visible
from . import wal
from .files import Files


class StoreError(Exception):
    code = 2


class NotFound(StoreError, KeyError):
    code = 1


class InvalidArgument(StoreError, ValueError):
    code = 4


class StoreIOError(StoreError, OSError):
    code = 5


def status_of(error: StoreError | None) -> str:
    return STATUS[error.code if error else 0]


@dataclass
class Options:
    create_if_missing: bool = False
    write_buffer_size: int = 4 << 20
    l0_compaction_trigger: int = 4
    max_bytes_for_level_base: int = 10 << 20
    disable_auto_compaction: bool = False
    output_file_size: int = 2 << 20
    bloom: bool = True
    #: What keys are ordered by, a column that differs for different keys; other than the key itself, ranges of files are
    #: not used to leave files out.
    comparator: Callable[[Column], Column] | None = None


class WriteBatch:
    """Puts and deletions that are applied together, in order."""

    def __init__(self) -> None:
        self.records: list[tuple[int, bytes, bytes]] = []

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.records.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.records.append((DELETE, bytes(key), b""))
        return self

    def clear(self) -> None:
        self.records.clear()

    def approximate_size(self) -> int:
        return sum(len(k) + (len(v) if t == PUT else 0) + 8 for t, k, v in self.records)


@dataclass
class Version:
    number: int = 0
    last_seq: int = 0
    next_file: int = 1
    log_no: int = 0
    files: list[dict] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)

    def level(self, n: int) -> list[dict]:
        return [f for f in self.files if f["level"] == n]


class KVStore:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.io = Files(spark, self.path)
        if not self.io.exists(f"{self.path}/CURRENT"):
            if not self.options.create_if_missing:
                raise NotFound(self.path)
            for d in ("manifest", "log", "runs"):
                self.io.make(f"{self.path}/{d}")
            self.version = Version()
            self._publish(self.version)
        self.version = self._recovered()
        self.buffer: list[tuple[bytes, int, int, bytes]] = []  # key, seq, vtype, value
        self.size, self.seq, self.next_log = 0, self.version.last_seq, self.version.log_no
        self.snapshots: list[int] = []
        self.closed = False
        for name, _, at in self.io.list(f"{self.path}/log"):
            number = int(name.split(".")[0])
            if not name.endswith(".log") or number < self.version.log_no:
                continue
            self.next_log = max(self.next_log, number + 1)
            for payload in wal.payloads(self.io.read(at)):
                self._remember(*wal.decode_batch(payload))

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: object) -> KVStore:
        return cls(spark, path, Options(**options))

    def __enter__(self) -> KVStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.closed = True

    # Manifest

    def _recovered(self) -> Version:
        name = self.io.read(f"{self.path}/CURRENT").decode().strip()
        try:
            return Version(**json.loads(self.io.read(f"{self.path}/manifest/{name}")))
        except (ValueError, TypeError) as e:
            raise StoreError(f"Corruption: {name}: {e}") from e

    def _publish(self, version: Version) -> None:
        name = f"MANIFEST-{version.number:06d}"
        try:
            self.io.write(f"{self.path}/manifest/{name}", json.dumps(version.__dict__).encode())
        except FileExistsError as e:
            raise StoreIOError(f"another writer has published version {version.number}") from e
        self.io.write(f"{self.path}/CURRENT", name.encode(), overwrite=True)
        self.version = version

    def _edit(self, gone: list[dict], new: list[dict], **changes: object) -> None:
        """Publish the next version: deletions first, then additions."""
        lost = {(f["level"], f["file_no"]) for f in gone}
        v = self.version
        state = {"last_seq": v.last_seq, "next_file": v.next_file, "log_no": v.log_no, "streams": v.streams} | changes
        files = [f for f in v.files if (f["level"], f["file_no"]) not in lost] + new
        self._publish(Version(number=v.number + 1, files=sorted(files, key=lambda f: (f["level"], f["smallest"], f["file_no"])), **state))

    # Writes

    def _open(self) -> None:
        if self.closed:
            raise InvalidArgument("the store is closed")

    def _remember(self, first: int, records: list[tuple[int, bytes, bytes]]) -> None:
        for i, (vtype, key, value) in enumerate(records):
            self.buffer.append((key, first + i, vtype, value))
            self.size += len(key) + len(value) + 24
        self.seq = max(self.seq, first + len(records) - 1)

    def put(self, key: bytes, value: bytes) -> None:
        self.write(WriteBatch().put(key, value))

    def delete(self, key: bytes) -> None:
        self.write(WriteBatch().delete(key))

    def write(self, batch: WriteBatch) -> None:
        """All of the batch or nothing of it: one log, complete under its name."""
        self._open()
        if not batch.records:
            return
        first = self.seq + 1
        try:
            self.io.write(f"{self.path}/log/{self.next_log:06d}.log", wal.framed([wal.encode_batch(first, batch.records)]))
        except FileExistsError as e:
            raise StoreIOError(f"another writer has written log {self.next_log}") from e
        self.next_log += 1
        self._remember(first, list(batch.records))
        if self.size >= self.options.write_buffer_size:
            self.flush()
            self.maintain()

    def write_frame(self, rows: DataFrame, order: str | None = None, stream: tuple[str, int] | None = None) -> None:
        """A bulk write of rows (key, vtype, value), as one run. Later rows of a key win, by `order`; without one, keys must differ.

        Numbers are given by key and order, which needs no global order: what a reader sees only depends on the
        order inside a key and on the whole batch coming after all before it.
        """
        self._open()
        if stream and self.version.streams.get(stream[0], -1) >= stream[1]:
            return
        self.flush()
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(order)) if order else F.lit(1))
        numbered = rows.select(F.col("key").cast("binary").alias("key"), (F.col("nth") + self.seq).cast("long").alias("seq"), F.col("vtype").cast("int").alias("vtype"), F.when(F.col("vtype") == PUT, F.col("value").cast("binary")).otherwise(F.lit(b"")).alias("value"))
        new = self._run(numbered, 0)
        last = max([self.seq, *(f["last_seq"] for f in new)])
        streams = self.version.streams | ({stream[0]: stream[1]} if stream else {})
        self._edit([], new, last_seq=last, next_file=self._next(new), log_no=self.next_log, streams=streams)
        self.seq = last
        self.maintain()

    # Runs

    def _next(self, new: list[dict]) -> int:
        return max([self.version.next_file, *(f["file_no"] + 1 for f in new)])

    def _run(self, mut: DataFrame, level: int, files: int | None = None) -> list[dict]:
        """Write rows as one folder of files cut by key ranges; their metadata."""
        # a name of its own, so that a second writer, whose publishing will fail, harms nothing
        folder = f"{self.path}/runs/{self.version.next_file:06d}-{uuid.uuid4().hex[:12]}"
        cut = mut.repartitionByRange(files or int(self.spark.conf.get("spark.sql.shuffle.partitions")), "key")
        writer = cut.sortWithinPartitions("key", F.desc("seq")).write
        if self.options.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(folder)
        sizes = {name: size for name, size, _ in self.io.list(folder) if name.endswith(".parquet")}
        meta = self.spark.read.schema(MUT_SCHEMA).parquet(folder).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
        rows = meta.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("seq").alias("s"), F.max("seq").alias("t"), F.count("*").alias("n")).collect()  # one row a file
        out = []
        for i, r in enumerate(sorted(rows, key=lambda r: bytes(r["a"]))):
            out.append({"level": level, "file_no": self.version.next_file + i, "file_size": sizes[r["name"]], "smallest": bytes(r["a"]).hex(), "largest": bytes(r["b"]).hex(), "first_seq": r["s"], "last_seq": r["t"], "n": r["n"], "path": f"{folder}/{r['name']}"})
        return out

    def _read(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], MUT_SCHEMA)
        return self.spark.read.schema(MUT_SCHEMA).parquet(*(f["path"] for f in files))

    def _memory(self) -> DataFrame:
        return self.spark.createDataFrame([(bytearray(k), s, t, bytearray(v)) for k, s, t, v in self.buffer], MUT_SCHEMA)

    def flush(self) -> None:
        """The buffered writes as one level 0 run; their logs go once it is published."""
        self._open()
        if not self.buffer:
            return
        new = self._run(self._memory(), 0, 1)
        self._edit([], new, last_seq=self.seq, next_file=self._next(new), log_no=self.next_log)
        self.buffer, self.size = [], 0

    # Reads

    def mut(self, low: bytes | None = None, high: bytes | None = None, snapshot: int | None = None) -> DataFrame:
        """All versions; files whose keys lie outside [low, high], or that are newer than the snapshot, are not read."""
        self._open()
        files = self.version.files
        if self.options.comparator is None:
            files = [f for f in files if (low is None or bytes.fromhex(f["largest"]) >= low) and (high is None or bytes.fromhex(f["smallest"]) <= high)]
        files = [f for f in files if snapshot is None or f["first_seq"] <= snapshot]
        out = self._read(files)
        return out.unionByName(self._memory()) if self.buffer else out

    def get(self, key: bytes, snapshot: int | None = None) -> bytes:
        key = bytes(key)
        own = [r for r in self.buffer if r[0] == key and (snapshot is None or r[1] <= snapshot)]
        if own:  # the buffer is newer than all runs
            _, _, vtype, value = max(own, key=lambda r: r[1])
            if vtype == PUT:
                return value
            raise NotFound(key)
        found = visible.point(self.mut(key, key, snapshot), bytearray(key), snapshot).select("value").take(1)
        if not found:
            raise NotFound(key)
        return bytes(found[0]["value"])

    def multi_get(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        return visible.multi_get(self.mut(snapshot=snapshot), keys, snapshot)

    def _order(self, c: Column) -> Column:
        return (self.options.comparator or (lambda x: x))(c)

    def scan(self, low: bytes | None = None, high: bytes | None = None, snapshot: int | None = None, reverse: bool = False, after: bytes | None = None) -> DataFrame:
        """Live keys, low <= key < high and key > after, in order; all of them under the comparator, if there is one."""
        ends = [bytearray(x) if x is not None else None for x in (low, high, after)]
        mut = self.mut(max((x for x in (low, after) if x is not None), default=None), high, snapshot).where(scan.between(ends[0], ends[1], self._order))
        if after is not None:
            mut = mut.where(self._order(F.col("key")) > self._order(F.lit(ends[2])))
        by = self._order(F.col("key"))
        return visible.live(mut, snapshot).orderBy(by.desc() if reverse else by.asc())

    def scan_internal(self) -> DataFrame:
        """All versions and deletions, in internal order."""
        return scan.internal_order(self.mut())

    def iterator(self, snapshot: int | None = None) -> Cursor:
        return Cursor(self, self.seq if snapshot is None else snapshot)

    def snapshot(self) -> int:
        self.snapshots = sorted([*self.snapshots, self.seq])
        return self.seq

    def release(self, snapshot: int) -> None:
        if snapshot not in self.snapshots:
            raise InvalidArgument(f"{snapshot} is not held")
        self.snapshots.remove(snapshot)

    # Maintenance

    def files(self) -> DataFrame:
        return self.spark.createDataFrame([(f["level"], f["file_no"], f["file_size"], f["smallest"], f["largest"]) for f in self.version.files], FILES_SCHEMA)

    def level_file_stats(self) -> list[tuple[int, int]]:
        """(files, bytes) of all seven levels."""
        return [(len(own), sum(f["file_size"] for f in own)) for own in (self.version.level(n) for n in range(LEVELS))]

    def level_over(self) -> int | None:
        """The lowest level over its limit: of runs in level 0, of bytes in the others."""
        stats = self.level_file_stats()
        if len({f["path"].rsplit("/", 1)[0] for f in self.version.level(0)}) >= self.options.l0_compaction_trigger:
            return 0
        return next((n for n in range(1, LEVELS - 1) if stats[n][1] > self.options.max_bytes_for_level_base * 10 ** (n - 1)), None)

    def picked(self, level: int) -> tuple[list[dict], list[dict]]:
        """A seed file with all of level 0 that it overlaps, also by way of others, and the overlapped files of the next level."""
        own = self.version.level(level)
        chosen = [min(own, key=lambda f: f["file_no"])]
        low, high = chosen[0]["smallest"], chosen[0]["largest"]
        while level == 0:
            reach = [f for f in own if f["largest"] >= low and f["smallest"] <= high]
            low, high = min(f["smallest"] for f in reach), max(f["largest"] for f in reach)
            if len(reach) == len(chosen):
                break
            chosen = reach
        return chosen, [f for f in self.version.level(level + 1) if f["largest"] >= low and f["smallest"] <= high]

    def compact(self, level: int = 0) -> None:
        """Merge a level's picked files into the next one, keeping what any live snapshot sees."""
        self._open()
        if not self.version.level(level) or level >= LEVELS - 1:
            return
        upper, lower = self.picked(level)
        oldest = self.snapshots[0] if self.snapshots else None
        size = sum(f["file_size"] for f in upper + lower)
        merged = self._read(upper + lower)
        # with nothing of these keys further down, a deletion that every snapshot sees hides nothing any more
        kept = lsm.without_old_tombstones(merged, self.seq if oldest is None else oldest) if self._lowest(upper + lower, level + 1) else lsm.compacted(merged, oldest)
        new = self._run(kept, level + 1, max(1, -(-size // self.options.output_file_size)))  # none, if all of it was deletions
        self._edit(upper + lower, new, next_file=self._next(new))

    def _lowest(self, files: list[dict], level: int) -> bool:
        """Whether no level under this one has a file that these files' keys reach into."""
        low, high = min(f["smallest"] for f in files), max(f["largest"] for f in files)
        return not any(f["level"] > level and f["largest"] >= low and f["smallest"] <= high for f in self.version.files)

    def maintain(self) -> None:
        """Compact while a level is over its limit."""
        while not self.options.disable_auto_compaction and (level := self.level_over()) is not None:
            self.compact(level)

    def vacuum(self) -> list[str]:
        """Remove the runs and logs that the version in use does not need; for when no older reader is left."""
        live = {f["path"] for f in self.version.files}
        gone = []
        for name, _, at in self.io.list(f"{self.path}/runs"):
            parts = [p for n, _, p in self.io.list(at) if n.endswith(".parquet")]
            if not any(f"{self.path}/runs/{name}/{p.rsplit('/', 1)[1]}" in live for p in parts):
                gone.append(at)
        gone += [at for name, _, at in self.io.list(f"{self.path}/log") if int(name.split(".")[0]) < self.version.log_no]
        for at in gone:
            self.io.remove(at)
        return gone


class Cursor:
    """A forward and backward cursor over the live keys of a snapshot, in blocks of rows.

    A block is read from the files that reach up to the next end of one, so that going through a store reads each file
    about as often as it has blocks, not the rest of the store for each block.
    """

    BLOCK = 1000

    def __init__(self, store: KVStore, snapshot: int) -> None:
        self.store, self.at_seq = store, snapshot
        self.rows: list[tuple[bytes, bytes]] = []
        self.at = 0

    def _rows(self, **ends: object) -> list[tuple[bytes, bytes]]:
        rows = self.store.scan(snapshot=self.at_seq, **ends).limit(self.BLOCK).select("key", "value").collect()  # one block
        return [(bytes(r["key"]), bytes(r["value"])) for r in rows]

    def _steps(self, key: bytes | None, forward: bool) -> list[bytes | None]:
        """Where to read up to from a key: the ends of files in the way, at growing distances, then the end of all."""
        if self.store.options.comparator is not None:
            return [None]
        ends = sorted({bytes.fromhex(f["largest" if forward else "smallest"]) for f in self.store.version.files}, reverse=not forward)
        ends = [e for e in ends if key is None or (e >= key if forward else e < key)]
        return [*(ends[(1 << n) - 1] for n in range(len(ends).bit_length())), None]

    def _forward(self, low: bytes | None, after: bytes | None) -> None:
        self.rows, self.at = [], 0
        for end in self._steps(low if after is None else after, True):
            self.rows = self._rows(low=low, after=after, high=None if end is None else end + b"\0")
            if self.rows:
                return

    def _backward(self, high: bytes | None) -> None:
        self.rows = []
        for end in self._steps(high, False):
            self.rows = self._rows(low=end, high=high, reverse=True)[::-1]
            if self.rows:
                break
        self.at = len(self.rows) - 1

    def valid(self) -> bool:
        return 0 <= self.at < len(self.rows)

    def seek(self, key: bytes) -> None:
        self._forward(bytes(key), None)

    def seek_to_first(self) -> None:
        self._forward(None, None)

    def seek_to_last(self) -> None:
        self._backward(None)

    def next(self) -> None:
        if self.at + 1 < len(self.rows):
            self.at += 1
        else:
            self._forward(None, self.key())

    def prev(self) -> None:
        if self.at > 0:
            self.at -= 1
        else:
            self._backward(self.key())

    def key(self) -> bytes:
        if not self.valid():
            raise InvalidArgument("the cursor is not at a key")
        return self.rows[self.at][0]

    def value(self) -> bytes:
        self.key()
        return self.rows[self.at][1]
