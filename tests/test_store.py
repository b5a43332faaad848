"""The store's life cycle, against a dictionary and over reopening."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varve.functions import bytesfn as B
from varve.sources import wal
from varve.sources.store import InvalidArgument, KVStore, NotFound, StoreError, WriteBatch, status_of
from varve.workloads import churn, fill_random, fill_sequential


def key(s):
    return s.ljust(16, "_").encode()


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def test_open(spark, path):
    with pytest.raises(NotFound):
        KVStore.open(spark, path)
    with KVStore.open(spark, path, create_if_missing=True) as s:
        assert s.level_file_stats() == [(0, 0)] * 7 and s.scan().count() == 0
    with pytest.raises(InvalidArgument):
        s.put(b"a", b"b")
    assert status_of(NotFound()) == "NotFound" and status_of(None) == "OK"


def test_batch_and_delete(spark, path):
    s = KVStore.open(spark, path, create_if_missing=True)
    b = WriteBatch().put(key("u1"), b"v1").put(key("u2"), b"v2").put(key("u2"), b"v3")
    assert b.approximate_size() == 3 * 26
    s.write(b)
    assert s.get(key("u1")) == b"v1" and s.get(key("u2")) == b"v3"
    before = s.snapshot()
    s.delete(key("u1"))
    s.put(b"", b"")
    with pytest.raises(NotFound):
        s.get(key("u1"))
    assert s.get(b"") == b"" and s.get(key("u1"), before) == b"v1"
    s.flush()
    with pytest.raises(NotFound):
        s.get(key("u1"))
    assert s.get(key("u1"), before) == b"v1"
    again = KVStore.open(spark, path)
    assert again.seq == s.seq and again.get(key("u2")) == b"v3"


def test_overwrites_survive_reopening(spark, path):
    s = KVStore.open(spark, path, create_if_missing=True, write_buffer_size=600, l0_compaction_trigger=2)
    s.put(key("a"), b"1")
    s.put(key("a"), b"2")
    for i in range(40):
        s.put(key(f"hot_{i % 4}"), f"value_{i}".encode())
    for _ in range(3):
        assert s.get(key("a")) == b"2" and s.get(key("hot_3")) == b"value_39"
        assert [bytes(r["key"]) for r in s.scan().collect()] == sorted(key(k) for k in ("a", "hot_0", "hot_1", "hot_2", "hot_3"))
        s = KVStore.open(spark, path)
    s.vacuum()
    assert s.get(key("a")) == b"2" and s.vacuum() == []


def test_bulk_compaction_and_levels(spark, path):
    s = KVStore.open(spark, path, create_if_missing=True, disable_auto_compaction=True, output_file_size=1 << 14)
    rows = churn(spark, 1000, 100, 2)
    s.write_frame(rows.where("seq <= 1000"), "seq")
    held = s.snapshot()
    s.write_frame(rows.where("seq > 1000 and seq <= 2000"), "seq")
    s.write_frame(rows.where("seq > 2000"), "seq")
    live = {bytes(r["key"]): bytes(r["value"]) for r in s.scan().collect()}
    old = {bytes(r["key"]): bytes(r["value"]) for r in s.scan(snapshot=held).collect()}
    n = s.mut().count()
    while s.version.level(0):
        s.compact(0)
    assert s.level_file_stats()[0] == (0, 0) and s.level_file_stats()[1][0] > 1
    assert {bytes(r["key"]): bytes(r["value"]) for r in s.scan().collect()} == live
    assert {bytes(r["key"]): bytes(r["value"]) for r in s.scan(snapshot=held).collect()} == old
    files = sorted((f["smallest"], f["largest"]) for f in s.version.level(1))
    assert all(a[1] < b[0] for a, b in zip(files, files[1:], strict=False))
    s.release(held)
    s.compact(1)
    assert s.mut().count() < n and {bytes(r["key"]): bytes(r["value"]) for r in s.scan().collect()} == live
    with pytest.raises(InvalidArgument):
        s.release(held)


def test_multi_get_and_pruning(spark, path):
    s = KVStore.open(spark, path, create_if_missing=True, disable_auto_compaction=True)
    s.write_frame(fill_sequential(spark, 500))
    s.write_frame(fill_random(spark, 500), "seq")
    asked = spark.range(600).select(F.format_string("%016d", "id").cast("binary").alias("key"))
    got = s.multi_get(asked).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"OK": 500, "NotFound": 100}
    assert s.mut(b"9", b"9").count() == 0  # no file holds it
    assert s.scan(b"%016d" % 10, b"%016d" % 20, reverse=True).count() == 10


def test_cursor(spark, path):
    s = KVStore.open(spark, path, create_if_missing=True)
    for i in range(7):
        s.put(b"%d" % i, b"v%d" % i)
    s.delete(b"3")
    it = s.iterator()
    it.BLOCK = 2
    it.seek_to_first()
    seen = []
    while it.valid():
        seen.append(it.key())
        it.next()
    assert seen == [b"0", b"1", b"2", b"4", b"5", b"6"]
    it.seek(b"3")
    assert it.key() == b"4" and it.value() == b"v4"
    it.prev()
    assert it.key() == b"2"
    it.seek_to_last()
    assert it.key() == b"6"
    it.seek(b"7")
    assert not it.valid()


def test_two_writers(spark, path):
    a = KVStore.open(spark, path, create_if_missing=True)
    b = KVStore.open(spark, path)
    a.write_frame(fill_sequential(spark, 10))
    with pytest.raises(StoreError):
        b.write_frame(fill_sequential(spark, 10))
    assert KVStore.open(spark, path).scan().count() == 10


def test_damaged_manifest(spark, path):
    s = KVStore.open(spark, path, create_if_missing=True)
    s.io.write(f"{path}/CURRENT", b"MANIFEST-000009", overwrite=True)
    with pytest.raises(Exception):  # noqa: B017
        KVStore.open(spark, path)


def test_stream(spark, path, tmp_path):
    from varve.streaming.ingest import ingest

    s = KVStore.open(spark, path, create_if_missing=True, disable_auto_compaction=True)
    source = str(tmp_path / "in")
    fill_random(spark, 300).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("key string, seq long, vtype int, value string").parquet(source)
        ingest(stream, s, "in", str(tmp_path / "checkpoint"), "seq").awaitTermination()
    expected = fill_random(spark, 300).groupBy("key").agg(F.max_by("value", "seq").alias("value")).collect()
    assert {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in s.scan().collect()} == {r["key"]: r["value"] for r in expected}
    assert s.version.streams == {"in": 0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=70000), max_size=6), st.integers(0, 200))
def test_log_round_trip(payloads, torn):
    log = wal.framed(payloads)
    assert list(wal.payloads(log)) == payloads
    got = list(wal.payloads(log[: max(0, len(log) - torn)]))
    assert got == payloads[: len(got)]


def test_log_damage():
    payloads = [bytes([i]) * 20000 for i in range(5)]
    log = bytearray(wal.framed(payloads))
    log[10] ^= 1
    with pytest.raises(wal.Corruption):
        list(wal.payloads(bytes(log)))
    reports = []
    got = list(wal.payloads(bytes(log), lambda at, why: reports.append((at, why))))
    assert reports and got == payloads[2:]


@given(st.integers(0, 2**40), st.lists(st.tuples(st.integers(0, 1), st.binary(max_size=40), st.binary(max_size=300)), max_size=20))
def test_batch_payload(seq, records):
    records = [(t, k, v if t else b"") for t, k, v in records]
    assert wal.decode_batch(wal.encode_batch(seq, records)) == (seq, records)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_dictionary(spark, tmp_path, seed):
    """Random writes, deletions, snapshots, flushes, compactions and reopenings."""
    rng = random.Random(seed)
    s = KVStore.open(spark, str(tmp_path / "s"), create_if_missing=True, disable_auto_compaction=True)
    model, held = {}, []
    for _ in range(60):
        what = rng.choice(["put", "put", "put", "delete", "batch", "batch", "snapshot", "flush", "compact", "reopen"])
        k = b"k%d" % rng.randrange(12)
        if what == "put":
            v = b"%d" % rng.randrange(1000)
            s.put(k, v)
            model[k] = v
        elif what == "delete":
            s.delete(k)
            model.pop(k, None)
        elif what == "batch":
            b = WriteBatch()
            for _ in range(rng.randrange(4)):
                k, v = b"k%d" % rng.randrange(12), b"%d" % rng.randrange(1000)
                if rng.random() < 0.3:
                    b.delete(k)
                    model.pop(k, None)
                else:
                    b.put(k, v)
                    model[k] = v
            s.write(b)
        elif what == "snapshot" and len(held) < 3:
            held.append((s.snapshot(), dict(model)))
        elif what == "flush":
            s.flush()
        elif what == "compact":
            s.compact(rng.choice([0, 0, 1]))
        elif what == "reopen":
            snaps = s.snapshots
            s = KVStore.open(spark, str(tmp_path / "s"), disable_auto_compaction=True)
            s.snapshots = snaps
    for at, then in [*held, (None, model)]:
        assert {bytes(r["key"]): bytes(r["value"]) for r in s.scan(snapshot=at).collect()} == then


def test_level_text(spark):
    from varve.operators.lsm import level_stats, level_text

    files = spark.createDataFrame([(0, 1, 10, "a", "b"), (2, 2, 5, "a", "c")], "level int, file_no long, file_size long, smallest string, largest string")
    assert level_text(level_stats(files)).first()[0] == "L0:1f/10b|L1:0f/0b|L2:1f/5b|L3:0f/0b|L4:0f/0b|L5:0f/0b|L6:0f/0b"
    assert B.bloom_probes(1) == 1 and B.bloom_probes(100) == 30


def test_comparator(spark, path):
    """Scans in another order of keys; files are then not left out by their ranges."""
    s = KVStore.open(spark, path, create_if_missing=True, comparator=lambda c: F.reverse(c.cast("string")))
    for k in (b"a3", b"b1", b"c2"):
        s.put(k, b"v")
    s.flush()
    assert [bytes(r["key"]) for r in s.scan().collect()] == [b"b1", b"c2", b"a3"]
    assert [bytes(r["key"]) for r in s.scan(reverse=True).collect()] == [b"a3", b"c2", b"b1"]
    assert s.get(b"c2") == b"v" and s.scan(b"b1", b"a3").count() == 2  # bounds are in that order too


def test_comparator_in_bounds_and_cursor(spark, path):
    s = KVStore.open(spark, path, create_if_missing=True, comparator=lambda c: F.reverse(c.cast("string")))
    for k in (b"a3", b"b2", b"c1", b"d0"):
        s.put(k, b"v")
    s.flush()
    assert [bytes(r["key"]) for r in s.scan(b"c1", b"a3").collect()] == [b"c1", b"b2"]
    at = s.iterator()
    at.BLOCK = 2
    seen = []
    at.seek_to_first()
    while at.valid():
        seen.append(at.key())
        at.next()
    assert seen == [b"d0", b"c1", b"b2", b"a3"]
    at.seek(b"b2")
    seen = []
    while at.valid():
        seen.append(at.key())
        at.prev()
    assert seen == [b"b2", b"c1", b"d0"]
    at.seek(b"z9")
    assert not at.valid()


def test_cursor_reads_few_files(spark, path):
    """A refill reads up to the next end of a file, and goes further only where all in between is deleted."""
    s = KVStore.open(spark, path, create_if_missing=True, disable_auto_compaction=True)
    s.write_frame(fill_sequential(spark, 400))
    s.write_frame(fill_sequential(spark, 300).withColumn("vtype", F.lit(0)).where("key >= '0000000000000020'"))
    want = [b"%016d" % i for i in [*range(20), *range(300, 400)]]
    at = s.iterator()
    at.BLOCK = 7
    read = []
    mut = s.mut
    s.mut = lambda low=None, high=None, snapshot=None: read.append((low, high)) or mut(low, high, snapshot)
    seen = []
    at.seek_to_first()
    while at.valid():
        seen.append(at.key())
        at.next()
    assert seen == want and sum(high is None for _, high in read) <= 2
    seen = []
    at.seek_to_last()
    while at.valid():
        seen.append(at.key())
        at.prev()
    assert seen == want[::-1]


def test_deletions_leave_the_lowest_level(spark, path):
    s = KVStore.open(spark, path, create_if_missing=True, disable_auto_compaction=True)
    for i in range(6):
        s.put(key(f"k{i}"), b"v")
    s.flush()
    s.compact(0)
    held = s.snapshot()
    s.delete(key("k1"))
    s.flush()
    s.compact(0)
    assert s.mut().where("vtype = 0").count() == 1 and s.scan(snapshot=held).count() == 6 and s.scan().count() == 5
    s.release(held)
    s.delete(key("k2"))
    s.flush()
    s.compact(0)
    assert s.mut().where("vtype = 0").count() == 0 and s.mut().count() == 4 and s.scan().count() == 4
    for i in range(6):
        s.delete(key(f"k{i}"))
    s.flush()
    s.compact(0)
    assert s.mut().count() == 0 and KVStore.open(spark, path).scan().count() == 0


def test_a_publish_between_another_ones_write_and_rename(spark, path):
    """A second writer's file can't go out under the first one's name."""
    from varve.sources.files import Files

    a, b = Files(spark, path), Files(spark, path)
    a.make(path)
    rename, done = a.fs.rename, []

    class Late:
        def __getattr__(self, name):
            return getattr(b.fs, name)

        def rename(self, temp, to):
            if not done:
                done.append(1)
                b.write(f"{path}/x", b"second")
            return rename(temp, to)

    a.fs = Late()
    with pytest.raises(FileExistsError):
        a.write(f"{path}/x", b"first")
    assert b.read(f"{path}/x") == b"second" and [n for n, *_ in b.list(path) if n.startswith("x")] == ["x"]


def test_logs_as_rows(spark, path):
    """A folder of logs, with an offset to start from and rows for damaged places."""
    import os

    os.makedirs(path)
    batches = [wal.encode_batch(1 + 3 * n, [(1, b"k%d" % n, bytes(9000)), (0, b"d%d" % n, b""), (1, b"e", b"")]) for n in range(12)]
    log = bytearray(wal.framed(batches))
    with open(f"{path}/000001.log", "wb") as f:
        f.write(log)
    log[wal.LOG_BLOCK + 20] ^= 1
    with open(f"{path}/000002.log", "wb") as f:
        f.write(log)
    got = wal.read_logs(spark, path).collect()
    whole = [r for r in got if r["file"] == "000001.log"]
    assert [(r["seq"], r["vtype"]) for r in whole] == [(i + 1, (1, 0, 1)[i % 3]) for i in range(36)] and not any(r["error"] for r in whole)
    broken = [r for r in got if r["file"] == "000002.log"]
    assert any(r["error"] and r["at"] == wal.LOG_BLOCK for r in broken) and 18 < len([r for r in broken if r["seq"]]) < 36
    later = list(wal.payloads(wal.framed(batches), start=wal.LOG_BLOCK + 5))
    assert later == batches[-len(later) :] and 0 < len(later) < 12
    assert wal.read_logs(spark, path, wal.LOG_BLOCK).where("file = '000001.log'").count() == 3 * len(later)
