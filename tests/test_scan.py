"""Scans, seeks and ranks against sorted lists, with keys of any length."""

import bisect
import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from varve.operators import lsm, scan, visible
from varve.operators.ordering import Ranges, last_before, neighbours, running

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module", params=[1, 2])
def keys(request):
    rng = random.Random(request.param)
    return sorted({"".join(rng.choices("abé\U0001f600z0", k=rng.randrange(20))) for _ in range(80)} | {"", "a" * 30, "a" * 31}, key=str.encode)


def frame(spark, values, name="key"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string").repartition(3)


@pytest.mark.parametrize("prefix", ["", "http://example.org/a/long/common/prefix/"])
def test_neighbours_and_ranks(spark, keys, prefix):
    keys = [prefix + k for k in keys]
    got = {r["key"]: (r["prev_key"], r["next_key"]) for r in neighbours(frame(spark, keys), "key").collect()}
    assert got == {k: (keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)}
    for down in (False, True):
        got = {r["key"]: r["n"] for r in scan.ranked(frame(spark, keys), "key", "n", down).collect()}
        assert got == {k: len(keys) - i if down else i + 1 for i, k in enumerate(keys)}
    sums = {r["key"]: r["before"] for r in running(frame(spark, keys), ["key"], F.length("key"), "before").collect()}
    assert sums == {k: sum(map(len, keys[:i])) for i, k in enumerate(keys)}
    assert neighbours(frame(spark, keys).limit(0), "key").count() == 0


def test_ranges_are_even(spark):
    """Whatever the keys look like, and with most rows under one key."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "http://a/hot").otherwise(F.concat(F.lit("http://a/"), F.col("id"))).alias("key"), F.col("id").alias("seq"))
    by = ["key", -F.col("seq")]
    sizes = rows.groupBy(Ranges(rows, *by, parts=16).of(*by).alias("range")).count().collect()
    assert sorted(r["range"] for r in sizes) == list(range(16)) and max(r["count"] for r in sizes) < 3 * 20_000 / 16
    placed = running(rows, by, F.lit(1), "before").orderBy("before").collect()
    assert [r["before"] for r in placed] == list(range(20_000)) and [(r["key"], -r["seq"]) for r in placed] == sorted((r["key"], -r["seq"]) for r in placed)


def test_last_before_in_groups(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, rng.choice([None, i])) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "g int, at long, x long")
    for forward in (False, True):
        for r in last_before(df, ["at"], F.col("x"), "found", ("g",), forward).collect():
            near = [x for g, at, x in rows if g == r["g"] and x is not None and (at >= r["at"] if forward else at <= r["at"])]
            assert r["found"] == ((min if forward else max)(near) if near else None)


def test_ranges_of_files(spark):
    rng = random.Random(5)
    files = [(rng.randrange(2), i, *sorted((f"k{rng.randrange(1000):04d}", f"k{rng.randrange(1000):04d}"))) for i in range(60)] + [(0, 100, "a", "z"), (1, 101, "z", "a")]
    df = spark.createDataFrame(files, "level int, file_no long, smallest string, largest string")
    pairs = {(a[0], a[1], b[1]) for a in files for b in files if a[0] == b[0] and a[1] < b[1] and a[3] >= b[2] and b[3] >= a[2] and 101 not in (a[1], b[1])}
    got = [tuple(r) for r in lsm.overlap_pairs(df).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    asked = [f"k{i:04d}" for i in range(0, 1000, 37)] + ["", "zz"]
    got = sorted((r["key"], r["file_no"]) for r in lsm.candidates(frame(spark, asked), df).collect())
    assert got == sorted((k, f[1]) for k in asked for f in files if f[2] <= k <= f[3])


def test_no_task_sees_all_rows(spark):
    """Only the summaries of ranges go to one task, and no ranges are compared pair by pair."""
    mut = spark.range(1000).select(F.col("id").cast("string").alias("key"), F.col("id").alias("seq"), F.lit(1).alias("vtype"), F.lit("v").alias("value"))
    files = mut.select(F.lit(0).alias("level"), F.col("seq").alias("file_no"), F.col("key").alias("smallest"), F.col("key").alias("largest"))
    keys = mut.select("key")
    for df in (scan.internal_scan(mut), scan.with_neighbours(mut), scan.seek(keys, keys.withColumnRenamed("key", "target")), lsm.output_files(mut), lsm.candidates(keys, files), lsm.overlap_pairs(files)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        for before, line in zip(plan.splitlines(), plan.splitlines()[1:], strict=False):
            if "SinglePartition" in before:
                assert "Aggregate(key" in line, plan


def test_seeks(spark, keys):
    targets = [*keys[::7], "zz", "a", "0a", keys[3] + "\u0001", "\U0001f600" * 40]
    raw = [k.encode() for k in keys]
    got = {r["target"]: r["key"] for r in scan.seek(frame(spark, keys), frame(spark, targets, "target")).collect()}
    before = {r["target"]: r["key"] for r in scan.seek_before(frame(spark, keys), frame(spark, targets, "target")).collect()}
    for t in targets:
        at = bisect.bisect_left(raw, t.encode())
        assert got[t] == (keys[at] if at < len(keys) else None) and before[t] == (keys[at - 1] if at else None)


def test_prefix_bound():
    assert scan.after_prefix("ab") == "ac" and scan.after_prefix("a\U0010ffff") == "b" and scan.after_prefix("\U0010ffff") is None and scan.after_prefix("") is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_log_operators_against_lists(spark, seed):
    rng = random.Random(seed)
    log = [(f"k{rng.randrange(9)}", s, rng.randrange(2), f"v{s}") for s in rng.sample(range(1, 200), 90)]
    mut = spark.createDataFrame(log, "key string, seq long, vtype int, value string")

    def state(rows, at=10**9):
        top = {}
        for k, s, t, v in sorted((r for r in rows if r[1] <= at), key=lambda r: r[1]):
            top[k] = (s, t, v)
        return {k: (s, v) for k, (s, t, v) in top.items() if t}

    old, new = 60, 140
    for at in (0, old, new, 10**9):
        assert {r["key"]: (r["seq"], r["value"]) for r in visible.live(mut, at).collect()} == state(log, at)
    kept = lsm.compacted(mut, old)
    rows = [tuple(r) for r in kept.collect()]
    for at in (old, new, 10**9):
        assert state(rows, at) == state(log, at)
    gone = [tuple(r) for r in lsm.without_old_tombstones(mut, old).collect()]
    assert state(gone, old) == state(log, old) and state(gone) == state(log) and not [r for r in gone if r[1] <= old and not r[2]]
    a, b = state(log, old), state(log, new)
    want = {(k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k, (0,))[0] != b.get(k, (0,))[0]}
    assert {(r["key"], r["change"]) for r in visible.snapshot_diff(mut, old, new).collect()} == want
    probes = spark.createDataFrame([(i, f"k{i % 11}", rng.randrange(220)) for i in range(120)], "id long, key string, at long")
    for r in visible.as_of(mut, probes, "id").collect():
        assert (r["seq"], r["value"]) == state(log, r["at"]).get(r["key"], (None, None))
    merged = [tuple(r) for r in scan.merge_runs([mut.where(F.col("seq") % 3 == i) for i in range(3)]).orderBy("place").collect()]
    assert [m[:4] for m in merged] == sorted(log, key=lambda r: (r[0], -r[1])) and [m[4] for m in merged] == list(range(1, 91))


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "run")
    spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "y")], "key string, seq long, vtype int, value string").write.parquet(path)
    plan = visible.point(spark.read.parquet(path), "a", 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan and "LessThanOrEqual(seq,5)" in plan
    plan = scan.range_scan(spark.read.parquet(path), "a", "b").select("key")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and "LessThan(key,b)" in plan


@pytest.mark.parametrize("name", ["kv_next_prev", "fn_shared_prefix", "lsm_run_contains_key"])
def test_first_query_of_a_session(name, tmp_path):
    """In a new session, where Spark numbers columns from 0, it inferred a filter with a column that its input did not have."""
    code = f"""import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
from varve.plans.queries import QUERIES
assert QUERIES[{name!r}](spark, "/root/testdata/sf0.001").collect()
spark.stop()"""
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_held_points_of_crowded_and_equal_spans(spark):
    """Equal points and spans keep their number, and one crowded place is dealt to more than one task, by no more rows than its pairs need."""
    points = [f"{i:04d}" for i in range(4000)] + ["0050"] * 3
    spans = [("0040", "0539", n) for n in range(100)] + [("0050", "0050", 300)] * 2 + [("0139", "0040", 301), ("0300", "0400", 302), (None, "0400", 303)]
    df = spark.createDataFrame(spans, "smallest string, largest string, n int").repartition(3)
    got = lsm.candidates(frame(spark, points), df).select("key", "n", F.spark_partition_id().alias("task"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        rows = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert Counter(r[:2] for r in rows) == Counter((k, n) for k in points for a, b, n in spans if a and a <= k <= b)
    sizes = Counter(r[2] for r in rows)
    assert len(sizes) > 1 and max(sizes.values()) < 0.75 * len(rows)


def test_overlap_pairs_makes_only_its_pairs(spark):
    """Files that don't meet are not compared, in however few ranges they are."""
    files = spark.range(4000).select(F.lit(0).alias("level"), F.col("id").alias("file_no"), *(F.format_string("%06d", F.col("id") * 2 + d).alias(c) for c, d in (("smallest", 0), ("largest", 1))))
    assert lsm.overlap_pairs(files).collect() == []
    plan = lsm.overlap_pairs(files)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines()), plan
