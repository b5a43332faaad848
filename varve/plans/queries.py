"""The query catalogue: each query on the driver's tables, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workloads as W
from ..functions import bytesfn as B
from ..model import files_of_parts, fixed_width, mut_of_events, table
from ..operators import batch, blocks, filters, lsm, manifest, scan, visible

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Relations that the SQL of several queries begins with.
MUT = "mut AS (SELECT lpad(CAST(user_id AS VARCHAR), 16, '0') AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS vtype, props AS value FROM events)"
NEWEST = "newest AS (SELECT key, max(seq) AS seq, arg_max(vtype, seq) AS vtype, arg_max(value, seq) AS value FROM mut GROUP BY key)"
LIVE = f"{MUT}, {NEWEST}, live AS (SELECT key, seq, value FROM newest WHERE vtype = 1)"
LAST = "last AS (SELECT max(seq) AS s FROM mut)"
FILES = "files AS (SELECT p_size % 7 AS level, p_partkey AS file_no, CAST(floor(p_retailprice * 100) AS BIGINT) AS file_size, lpad(CAST(p_partkey AS VARCHAR), 16, '0') AS smallest, lpad(CAST(p_partkey + p_size AS VARCHAR), 16, '0') AS largest FROM part)"
CUSTOMERS = "asked AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS key FROM customer)"


def _varint(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} < {1 << (7 * n)} THEN {n}" for n in range(1, 9)) + " ELSE 9 END)"


SIZED = f"sized AS (SELECT *, CASE WHEN vtype = 1 THEN length(value) ELSE 0 END AS v FROM mut), bytes AS (SELECT key, seq, vtype, value, {_varint('(length(key) + 8)')} + length(key) + 8 + {_varint('v')} + v AS bytes FROM sized)"
EDITS = """edits AS (SELECT file_no AS edit_no, 'add' AS op, level, file_no, file_size, smallest, largest FROM files
  UNION ALL SELECT 1000000000 + file_no, 'del', level, file_no, NULL, NULL, NULL FROM files WHERE file_no % 3 = 0
  UNION ALL SELECT 2000000000 + file_no, 'add', level, file_no, file_size + 1, smallest, largest FROM files WHERE file_no % 9 = 0)"""


def query(name: str, sql: str | None = None):
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _mut(spark: SparkSession, d: str) -> DataFrame:
    return mut_of_events(table(spark, d, "events"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return files_of_parts(table(spark, d, "part"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(fixed_width(F.col("c_custkey")).alias("key"))


def _half(mut: DataFrame) -> int:
    return visible.last_sequence(mut) // 2


def _edits(files: DataFrame) -> DataFrame:
    add = files.select(F.col("file_no").alias("edit_no"), F.lit("add").alias("op"), "level", "file_no", "file_size", "smallest", "largest")
    none = F.lit(None)
    gone = files.where("file_no % 3 = 0").select((F.col("file_no") + 1000000000).alias("edit_no"), F.lit("del").alias("op"), "level", "file_no", none.cast("long").alias("file_size"), none.cast("string").alias("smallest"), none.cast("string").alias("largest"))
    again = files.where("file_no % 9 = 0").select((F.col("file_no") + 2000000000).alias("edit_no"), F.lit("add").alias("op"), "level", "file_no", (F.col("file_size") + 1).alias("file_size"), "smallest", "largest")
    return add.unionByName(gone).unionByName(again)


def _batches(spark: SparkSession, d: str) -> DataFrame:
    mut = _mut(spark, d)
    return mut.select(F.floor((F.col("seq") - 1) / 100).cast("long").alias("batch_id"), ((F.col("seq") - 1) % 100).alias("pos"), "vtype", "key", "value")


BATCHES = "batches AS (SELECT (seq - 1) // 100 AS batch_id, (seq - 1) % 100 AS pos, vtype, key, value FROM mut)"


@query("kv_get_latest", f"WITH {LIVE} SELECT key, seq, value FROM live")
def _(spark, d):
    return visible.live(_mut(spark, d))


@query("kv_get_point", f"WITH {LIVE} SELECT key, seq, value FROM live WHERE key = '0000000000000007'")
def _(spark, d):
    return visible.point(_mut(spark, d), "0000000000000007")


@query("kv_get_snapshot", f"WITH {MUT}, {LAST}, seen AS (SELECT mut.* FROM mut, last WHERE seq <= s // 2) SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM seen GROUP BY key HAVING arg_max(vtype, seq) = 1")
def _(spark, d):
    mut = _mut(spark, d)
    return visible.live(mut, _half(mut))


PROBES = ("0000000000000000", "0000000000000001", "0000000000000002", "0000000000000003", "0000000000999999", "")


@query("kv_get_missing", f"WITH {LIVE}, asked AS (SELECT unnest([{', '.join(repr(p) for p in PROBES)}]) AS key) SELECT asked.key, CASE WHEN live.key IS NULL THEN 'NotFound' ELSE 'OK' END AS status, seq, value FROM asked LEFT JOIN live USING (key)")
def _(spark, d):
    asked = spark.createDataFrame([(p,) for p in PROBES], "key string")
    return visible.multi_get(_mut(spark, d), asked)


@query("kv_multi_get", f"WITH {LIVE}, {CUSTOMERS} SELECT asked.key, CASE WHEN live.key IS NULL THEN 'NotFound' ELSE 'OK' END AS status, seq, value FROM asked LEFT JOIN live USING (key)")
def _(spark, d):
    return visible.multi_get(_mut(spark, d), _asked(spark, d))


@query(
    "kv_as_of_join",
    f"""WITH {MUT}, {LAST}, asked AS (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 16, '0') AS key, o_orderkey % s + 1 AS at_seq FROM orders, last),
    found AS (SELECT o_orderkey, arg_max(vtype, seq) AS vtype, max(seq) AS seq, arg_max(value, seq) AS value FROM asked JOIN mut ON asked.key = mut.key AND seq <= at_seq GROUP BY o_orderkey)
    SELECT o_orderkey, key, at_seq, CASE WHEN vtype = 1 THEN found.seq END AS seq, CASE WHEN vtype = 1 THEN value END AS value FROM asked LEFT JOIN found USING (o_orderkey)""",
)
def _(spark, d):
    mut = _mut(spark, d)
    last = visible.last_sequence(mut)
    asked = table(spark, d, "orders").select("o_orderkey", fixed_width(F.col("o_custkey")).alias("key"), (F.col("o_orderkey") % last + 1).alias("at"))
    return visible.as_of(mut, asked, "o_orderkey").withColumnRenamed("at", "at_seq")


@query("kv_delete_hides", f"WITH {MUT}, {NEWEST} SELECT key, seq FROM newest WHERE vtype = 0")
def _(spark, d):
    return visible.deleted(_mut(spark, d))


@query("kv_resurrected_keys", f"WITH {MUT}, l AS (SELECT key, seq, vtype, lag(vtype) OVER w AS was, lag(seq) OVER w AS deleted_seq FROM mut WINDOW w AS (PARTITION BY key ORDER BY seq)) SELECT key, seq, deleted_seq FROM l WHERE vtype = 1 AND was = 0")
def _(spark, d):
    return visible.resurrected(_mut(spark, d))


@query("kv_history", f"WITH {MUT} SELECT key, seq, vtype, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version_rank FROM mut")
def _(spark, d):
    return visible.history(_mut(spark, d))


@query("kv_version_count", f"WITH {MUT} SELECT key, count(*) AS n_versions, count(*) FILTER (WHERE vtype = 0) AS n_deletes, min(seq) AS first_seq, max(seq) AS last_seq FROM mut GROUP BY key")
def _(spark, d):
    return visible.version_counts(_mut(spark, d))


@query(
    "kv_snapshot_diff",
    f"""WITH {MUT}, {LAST},
    a AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM mut, last WHERE seq <= s // 4 GROUP BY key HAVING arg_max(vtype, seq) = 1),
    b AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM mut, last WHERE seq <= s * 3 // 4 GROUP BY key HAVING arg_max(vtype, seq) = 1),
    j AS (SELECT coalesce(a.key, b.key) AS key, a.seq AS x, b.seq AS y, a.value AS old_value, b.value AS new_value FROM a FULL JOIN b ON a.key = b.key)
    SELECT key, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'changed' END AS change, old_value, new_value FROM j WHERE x IS DISTINCT FROM y""",
)
def _(spark, d):
    mut = _mut(spark, d)
    last = visible.last_sequence(mut)
    return visible.snapshot_diff(mut, last // 4, last * 3 // 4)


@query("kv_exists", f"WITH {LIVE}, {CUSTOMERS} SELECT key FROM asked WHERE EXISTS (SELECT 1 FROM live WHERE live.key = asked.key)")
def _(spark, d):
    return visible.contains(_mut(spark, d), _asked(spark, d))


@query("kv_scan_internal", f"WITH {MUT} SELECT key, seq, vtype, value, row_number() OVER (ORDER BY key, seq DESC, vtype DESC) AS place FROM mut")
def _(spark, d):
    return scan.internal_scan(_mut(spark, d))


@query("kv_scan_visible", f"WITH {LIVE} SELECT key, seq, value FROM live ORDER BY key")
def _(spark, d):
    return scan.visible_scan(_mut(spark, d))


@query("kv_range_scan", f"WITH {LIVE} SELECT key, seq, value FROM live WHERE key >= '0000000000000005' AND key < '0000000000000060'")
def _(spark, d):
    return scan.range_scan(_mut(spark, d), "0000000000000005", "0000000000000060")


@query("kv_reverse_scan", f"WITH {LIVE} SELECT key, seq, value, row_number() OVER (ORDER BY key DESC) AS place FROM live")
def _(spark, d):
    return scan.ranked(visible.live(_mut(spark, d)), "key", "place", descending=True)


@query("kv_seek_first", f"WITH {LIVE} SELECT key, seq, value FROM live ORDER BY key LIMIT 1")
def _(spark, d):
    return scan.first(_mut(spark, d))


@query("kv_seek_last", f"WITH {LIVE} SELECT key, seq, value FROM live ORDER BY key DESC LIMIT 1")
def _(spark, d):
    return scan.last(_mut(spark, d))


TARGETS = ("", "0000000000000004", "0000000000000005x", "000000000000001", "0000000000000100", "0000000000999999")
TARGETS_SQL = f"targets AS (SELECT unnest([{', '.join(repr(t) for t in TARGETS)}]) AS target)"


@query("kv_seek", f"WITH {LIVE}, {TARGETS_SQL} SELECT target, (SELECT min(key) FROM live WHERE key >= target) AS key FROM targets")
def _(spark, d):
    return scan.seek(visible.live(_mut(spark, d)).select("key"), spark.createDataFrame([(t,) for t in TARGETS], "target string"))


@query("kv_prev", f"WITH {LIVE}, {TARGETS_SQL} SELECT target, (SELECT max(key) FROM live WHERE key < target) AS key FROM targets")
def _(spark, d):
    return scan.seek_before(visible.live(_mut(spark, d)).select("key"), spark.createDataFrame([(t,) for t in TARGETS], "target string"))


@query("kv_next_prev", f"WITH {LIVE} SELECT key, seq, value, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM live")
def _(spark, d):
    return scan.with_neighbours(_mut(spark, d))


@query("kv_merge_runs", f"WITH {MUT} SELECT key, seq, vtype, value, row_number() OVER (ORDER BY key, seq DESC, vtype DESC) AS place FROM mut")
def _(spark, d):
    mut = _mut(spark, d)
    return scan.merge_runs([mut.where(F.col("seq") % 4 == i) for i in range(4)])


@query("kv_batch_apply", f"WITH {MUT}, {BATCHES}, s AS (SELECT row_number() OVER (ORDER BY batch_id, pos) AS seq, vtype, key, value FROM batches) SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM s GROUP BY key HAVING arg_max(vtype, seq) = 1")
def _(spark, d):
    return batch.applied(_batches(spark, d))


@query(
    "kv_batch_size",
    f"""WITH {MUT}, {BATCHES}, z AS (SELECT batch_id, vtype, length(key) AS k, length(value) AS v FROM batches)
    SELECT batch_id, count(*) AS n, CAST(sum(k + CASE WHEN vtype = 1 THEN v ELSE 0 END + 8) AS BIGINT) AS approximate_size,
    CAST(sum(1 + {_varint("k")} + k + CASE WHEN vtype = 1 THEN {_varint("v")} + v ELSE 0 END) + 12 AS BIGINT) AS wal_payload FROM z GROUP BY batch_id""",
)
def _(spark, d):
    return batch.batch_sizes(_batches(spark, d))


@query("kv_snapshot_seq", f"WITH {MUT}, {LAST} SELECT s // 4 AS oldest, s * 3 // 4 AS newest, CAST(3 AS BIGINT) AS n_snapshots, s AS last_seq, s // 4 AS keep_from FROM last")
def _(spark, d):
    mut = _mut(spark, d)
    last = visible.last_sequence(mut)
    return visible.oldest_snapshot(mut, spark.createDataFrame([(last * i // 4,) for i in (1, 2, 3)], "seq long"))


@query("kv_prefix_scan", f"WITH {LIVE} SELECT key, seq, value FROM live WHERE starts_with(key, '000000000000001')")
def _(spark, d):
    return scan.prefix_scan(_mut(spark, d), "000000000000001")


RUN_BYTES = 16384
RUNS = f"{MUT}, {SIZED}, runs AS (SELECT *, CAST((sum(bytes) OVER (ORDER BY seq) - bytes) // {RUN_BYTES} AS BIGINT) AS run_id FROM bytes)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return lsm.assigned_runs(_mut(spark, d), RUN_BYTES)


@query("lsm_assign_runs", f"WITH {RUNS} SELECT seq, CAST(bytes AS BIGINT) AS bytes, run_id FROM runs")
def _(spark, d):
    return _runs(spark, d).select("seq", "bytes", "run_id")


META = "meta AS (SELECT run_id, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(key) AS smallest, max(key) AS largest, min(seq) AS first_seq, max(seq) AS last_seq FROM runs GROUP BY run_id)"


@query("lsm_run_metadata", f"WITH {RUNS}, {META} SELECT * FROM meta")
def _(spark, d):
    return lsm.run_metadata(_runs(spark, d))


@query("lsm_run_contains_key", f"WITH {RUNS}, {META}, {CUSTOMERS} SELECT key, run_id FROM asked JOIN meta ON smallest <= key AND key <= largest")
def _(spark, d):
    return lsm.candidates(_asked(spark, d), lsm.run_metadata(_runs(spark, d))).select("key", "run_id")


@query("lsm_overlap_pairs", f"WITH {FILES} SELECT a.level, a.file_no AS file_a, b.file_no AS file_b FROM files a JOIN files b ON a.level = b.level AND a.largest >= b.smallest AND b.largest >= a.smallest AND a.file_no < b.file_no")
def _(spark, d):
    return lsm.overlap_pairs(_files(spark, d))


@query(
    "lsm_overlap_islands",
    f"""WITH {FILES}, r AS (SELECT *, max(largest) OVER (PARTITION BY level ORDER BY smallest, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM files)
    SELECT level, file_no, CAST(sum(CASE WHEN reach IS NULL OR smallest > reach THEN 1 ELSE 0 END) OVER (PARTITION BY level ORDER BY smallest, file_no) - 1 AS BIGINT) AS island FROM r""",
)
def _(spark, d):
    return lsm.overlap_islands(_files(spark, d))


@query("lsm_read_amplification", f"WITH {FILES}, {CUSTOMERS} SELECT key, count(file_no) AS n_files FROM asked LEFT JOIN files ON smallest <= key AND key <= largest GROUP BY key")
def _(spark, d):
    return lsm.read_amplification(_asked(spark, d), _files(spark, d))


@query("lsm_compact_no_snapshot", f"WITH {MUT}, {NEWEST} SELECT key, seq, vtype, value FROM newest")
def _(spark, d):
    return lsm.compacted(_mut(spark, d))


NEWER = f"{MUT}, {LAST}, n AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM mut)"


@query("lsm_compact_with_snapshot", f"WITH {NEWER} SELECT key, seq, vtype, value FROM n, last WHERE newer IS NULL OR newer > s // 2")
def _(spark, d):
    mut = _mut(spark, d)
    return lsm.compacted(mut, _half(mut))


@query("lsm_compact_rule_raw", f"WITH {NEWER} SELECT key, seq, vtype, value FROM n, last WHERE newer IS NULL OR seq >= s // 2")
def _(spark, d):
    mut = _mut(spark, d)
    return lsm.compacted_raw(mut, _half(mut))


@query("lsm_compact_tombstone_gc", f"WITH {NEWER} SELECT key, seq, vtype, value FROM n, last WHERE (newer IS NULL OR newer > s // 2) AND (vtype = 1 OR seq > s // 2)")
def _(spark, d):
    mut = _mut(spark, d)
    return lsm.without_old_tombstones(mut, _half(mut))


@query(
    "lsm_space_amplification",
    f"""WITH {MUT}, {SIZED}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM bytes)
    SELECT count(*) AS n_before, CAST(sum(bytes) AS BIGINT) AS bytes_before, count(*) FILTER (WHERE r = 1) AS n_after, CAST(sum(bytes) FILTER (WHERE r = 1) AS BIGINT) AS bytes_after,
    round(CAST(sum(bytes) AS DOUBLE) / CAST(sum(bytes) FILTER (WHERE r = 1) AS DOUBLE), 6) AS amplification FROM k""",
)
def _(spark, d):
    mut = _mut(spark, d)
    return lsm.space(mut, lsm.compacted(mut))


@query(
    "lsm_output_split",
    f"""WITH {MUT}, {SIZED}, k AS (SELECT key, count(*) AS n, sum(bytes) AS bytes FROM bytes GROUP BY key),
    c AS (SELECT *, CAST((sum(bytes) OVER (ORDER BY key) - bytes) // 8192 AS BIGINT) AS file_id FROM k)
    SELECT file_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(key) AS smallest, max(key) AS largest FROM c GROUP BY file_id""",
)
def _(spark, d):
    return lsm.output_files(_mut(spark, d), 8192)


STATS = f"{FILES}, stats AS (SELECT CAST(l AS INTEGER) AS level, count(file_no) AS n_files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM range(7) t(l) LEFT JOIN files ON level = l GROUP BY l)"


@query("lsm_level_stats", f"WITH {STATS} SELECT * FROM stats")
def _(spark, d):
    return lsm.level_stats(_files(spark, d))


@query("lsm_level_caps", "SELECT CAST(l AS INTEGER) AS level, CAST(10485760 * pow(10, l - 1) AS BIGINT) AS max_bytes FROM range(1, 7) t(l)")
def _(spark, d):
    return lsm.level_caps(spark)


CAP = 1 << 20
OVER = f"{STATS}, over_ AS (SELECT level, n_files, bytes, CASE WHEN level = 0 THEN n_files >= 4 WHEN level = 6 THEN false ELSE bytes > {CAP} * pow(10, level - 1) END AS over FROM stats)"


@query("lsm_needs_compaction", f"WITH {OVER} SELECT bool_or(over) AS needs_compaction FROM over_")
def _(spark, d):
    return lsm.needs_compaction(_files(spark, d), base=CAP)


@query("lsm_pick_level", f"WITH {OVER}, p AS (SELECT min(level) AS level FROM over_ WHERE over) SELECT p.level, min(file_no) AS seed_file FROM p LEFT JOIN files USING (level) GROUP BY p.level")
def _(spark, d):
    return lsm.picked_level(_files(spark, d), base=CAP)


REPLAYED = f"{FILES}, {EDITS}, state AS (SELECT level, file_no, arg_max({{'op': op, 'file_size': file_size, 'smallest': smallest, 'largest': largest}}, edit_no) AS e FROM edits GROUP BY level, file_no), alive AS (SELECT level, file_no, e.file_size AS file_size, e.smallest AS smallest, e.largest AS largest FROM state WHERE e.op = 'add')"


@query("manifest_replay", f"WITH {REPLAYED} SELECT * FROM alive")
def _(spark, d):
    return manifest.replayed(_edits(_files(spark, d)))


@query("manifest_obsolete", f"WITH {REPLAYED} SELECT file_no, printf('%06d.sst', file_no) AS name FROM files WHERE file_no NOT IN (SELECT file_no FROM alive)")
def _(spark, d):
    files = _files(spark, d)
    listed = files.select("file_no", B.file_name(F.col("file_no"), "sst").alias("name"))
    return manifest.obsolete(listed, manifest.replayed(_edits(files)))


@query("fn_pack_tag", f"WITH {MUT} SELECT seq, (seq << 8) | vtype AS tag, ((seq << 8) | vtype) >> 8 AS tag_seq, CAST(((seq << 8) | vtype) & 255 AS INTEGER) AS tag_type FROM mut")
def _(spark, d):
    tag = B.pack_tag(F.col("seq"), F.col("vtype"))
    return _mut(spark, d).select("seq", tag.alias("tag"), B.tag_seq(tag).alias("tag_seq"), B.tag_type(tag).alias("tag_type"))


@query("fn_varint_len", f"SELECT o_orderkey, CAST({_varint('(o_orderkey * o_orderkey * 17)')} AS BIGINT) AS n FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", B.varint_len(F.col("o_orderkey") * F.col("o_orderkey") * 17).alias("n"))


def _prefixed(spark: SparkSession, d: str) -> DataFrame:
    """Parts by name and key: the shared prefix with the one before, zero at restarts."""
    part = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type", "p_name", F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("key"))
    placed = scan.ranked(scan.neighbours(part, "key"), "key", "place").withColumn("nth", F.col("place") - 1)
    shared = F.when(F.col("nth") % B.RESTART_INTERVAL == 0, F.lit(0).cast("long")).otherwise(B.shared_prefix_len(F.col("prev_key"), F.col("key")))
    return placed.select("key", "nth", shared.alias("shared"))


PREFIXED = """p AS (SELECT p_brand || '/' || p_type || '/' || p_name || '/' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS key FROM part),
    o AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS nth, lag(key) OVER (ORDER BY key) AS prev FROM p),
    prefixed AS (SELECT key, nth, CASE WHEN nth % 16 = 0 THEN 0 ELSE coalesce(list_max(list_filter(range(1, least(length(key), length(prev)) + 1), lambda n: key[1:n] = prev[1:n])), 0) END AS shared FROM o)"""


@query("fn_entry_sizes", f"WITH {PREFIXED}, e AS (SELECT *, length(key) AS k, length(key) % 11 AS v FROM prefixed) SELECT key, CAST({_varint('shared')} + {_varint('(k - shared)')} + {_varint('v')} + k - shared + v AS BIGINT) AS entry_size, CAST({_varint('(k + 8)')} + k + 8 + {_varint('v')} + v AS BIGINT) AS memtable_size FROM e")
def _(spark, d):
    k, v = F.length("key").cast("long"), (F.length("key") % 11).cast("long")
    return _prefixed(spark, d).select("key", B.entry_size(F.col("shared"), k, v).alias("entry_size"), B.memtable_entry_size(k, v).alias("memtable_size"))


@query("fn_shared_prefix", f"WITH {PREFIXED} SELECT key, CAST(shared AS BIGINT) AS shared FROM prefixed")
def _(spark, d):
    return _prefixed(spark, d).select("key", "shared")


@query("fn_restart_index", f"WITH {PREFIXED} SELECT key, nth // 16 AS restart FROM prefixed")
def _(spark, d):
    return _prefixed(spark, d).select("key", F.floor(F.col("nth") / B.RESTART_INTERVAL).cast("long").alias("restart"))


@query(
    "fn_wal_payload",
    f"""WITH {MUT}, {BATCHES}, z AS (SELECT batch_id, vtype, length(key) AS k, length(value) AS v FROM batches)
    SELECT batch_id, CAST(12 + sum(1 + {_varint("k")} + k + CASE WHEN vtype = 1 THEN {_varint("v")} + v ELSE 0 END) AS BIGINT) AS payload FROM z GROUP BY batch_id""",
)
def _(spark, d):
    return batch.batch_sizes(_batches(spark, d)).select("batch_id", F.col("wal_payload").alias("payload"))


@query(
    "fn_wal_fragments",
    """WITH r AS (SELECT event_id, (event_id * 7919) % 100003 AS len, (event_id * 104729) % 32768 AS off FROM events),
    a AS (SELECT *, CASE WHEN 32768 - off < 7 THEN 32761 ELSE 32768 - off - 7 END AS start FROM r),
    b AS (SELECT *, greatest(0, len - start) AS rest FROM a), c AS (SELECT *, 1 + (rest + 32760) // 32761 AS n FROM b),
    d AS (SELECT *, unnest(range(n)) AS i FROM c)
    SELECT event_id, CAST(i AS BIGINT) AS piece, CASE WHEN n = 1 THEN 1 WHEN i = 0 THEN 2 WHEN i = n - 1 THEN 4 ELSE 3 END AS kind,
    CAST(CASE WHEN i = 0 THEN least(len, start) ELSE least(32761, rest - (i - 1) * 32761) END AS BIGINT) AS length FROM d""",
)
def _(spark, d):
    records = table(spark, d, "events").select("event_id", (F.col("event_id") * 7919 % 100003).alias("len"), (F.col("event_id") * 104729 % 32768).alias("off"))
    each = records.select("event_id", F.posexplode(B.wal_fragments(F.col("len"), F.col("off"))).alias("piece", "f"))
    return each.select("event_id", F.col("piece").cast("long").alias("piece"), "f.kind", "f.length")


def _hash16_sql(key: str) -> str:
    """The hash of 16 ASCII characters, word by word."""
    m = B.HASH_MULTIPLIER
    word = lambda w: " + ".join(f"(ascii(substr({key}, {4 * w + k + 1}, 1)) << {8 * k})" for k in range(4))
    steps = [f"h0 AS (SELECT DISTINCT {key} AS key, CAST({B.BLOOM_SEED ^ (16 * m & B.U32)} AS HUGEINT) AS h FROM keys)"]
    for w in range(4):
        x = f"((((h + {word(w).replace(key, 'key')}) & {B.U32}) * {m}) & {B.U32})"
        steps.append(f"m{w} AS (SELECT key, {x} AS x FROM h{w}), h{w + 1} AS (SELECT key, xor(x, x >> 16) AS h FROM m{w})")
    return ", ".join(steps)


@query("fn_hash32", f"WITH {MUT}, keys AS (SELECT key FROM mut), {_hash16_sql('key')} SELECT key, CAST(h AS BIGINT) AS h FROM h4")
def _(spark, d):
    return _mut(spark, d).select("key").distinct().select("key", B.hash32(F.col("key")).alias("h"))


BLOOM_BITS_PER_KEY = 10
BLOOM = f"""{LIVE}, keys AS (SELECT key FROM live UNION SELECT lpad(CAST(c_custkey AS VARCHAR), 16, '0') FROM customer), {_hash16_sql('key')},
    size AS (SELECT (greatest(64, count(*) * {BLOOM_BITS_PER_KEY}) + 7) // 8 * 8 AS bits FROM live),
    probes AS (SELECT key, CAST(((h + j * (((h >> 17) | (h << 15)) & {B.U32})) & {B.U32}) % bits AS BIGINT) AS bit FROM h4, size, range(6) t(j)),
    set_ AS (SELECT DISTINCT bit FROM probes WHERE key IN (SELECT key FROM live))"""


def _bloom(keys: DataFrame) -> DataFrame:
    """The different bits of the keys' filter, with its size."""
    k = B.bloom_probes(BLOOM_BITS_PER_KEY)
    bits = keys.agg(B.bloom_bits(F.count("*"), BLOOM_BITS_PER_KEY).alias("bits"))
    return keys.crossJoin(F.broadcast(bits)).select("bits", F.explode(B.bloom_positions(F.col("key"), F.col("bits"), k)).alias("bit")).distinct()  # a size is one row


@query("fn_bloom_bits", f"WITH {BLOOM} SELECT bits, bit FROM set_, size")
def _(spark, d):
    return _bloom(visible.live(_mut(spark, d)).select("key"))


@query("fn_bloom_probe", f"WITH {BLOOM}, hit AS (SELECT key, bool_and(bit IN (SELECT bit FROM set_)) AS may_match FROM probes GROUP BY key) SELECT asked.key, may_match, EXISTS (SELECT 1 FROM live WHERE live.key = asked.key) AS is_live FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS key FROM customer) asked JOIN hit USING (key)")
def _(spark, d):
    live = visible.live(_mut(spark, d)).select("key")
    bloom, asked, k = _bloom(live), _asked(spark, d), B.bloom_probes(BLOOM_BITS_PER_KEY)
    size = live.agg(B.bloom_bits(F.count("*"), BLOOM_BITS_PER_KEY).alias("bits"))
    probes = asked.crossJoin(F.broadcast(size)).select("key", F.explode(B.bloom_positions(F.col("key"), F.col("bits"), k)).alias("bit"))  # a size is one row
    hit = probes.join(bloom.select("bit", F.lit(True).alias("set")), "bit", "left").groupBy("key").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("may_match"))
    return hit.join(live.select("key", F.lit(True).alias("there")), "key", "left").select("key", "may_match", F.coalesce("there", F.lit(False)).alias("is_live"))


@query("fn_filter_segment", "SELECT event_id, (event_id * 37) >> 11 AS segment FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", B.filter_segment(F.col("event_id") * 37).alias("segment"))


_CRC = f"xor(list_reduce(list_prepend({B.U32}::BIGINT, [CAST(ascii(substr(key, CAST(i AS INTEGER), 1)) AS BIGINT) FOR i IN range(1, length(key) + 1)]), lambda c, x: xor(c >> 8, ({B.crc32c_table()}::BIGINT[])[CAST(xor(c, x) & 255 AS INTEGER) + 1])), {B.U32}::BIGINT)"


@query("fn_crc32c_mask", f"WITH {MUT}, k AS (SELECT DISTINCT key FROM mut), c AS (SELECT key, {_CRC} AS crc FROM k), m AS (SELECT *, ((((crc >> 15) | (crc << 17)) & {B.U32}) + {B.CRC_MASK_DELTA}) & {B.U32} AS masked FROM c) SELECT key, crc, masked, crc AS unmasked FROM m")
def _(spark, d):
    crc = _mut(spark, d).select("key").distinct().select("key", B.crc32c(F.col("key")).alias("crc"))
    return crc.withColumn("masked", B.crc_mask(F.col("crc"))).withColumn("unmasked", B.crc_unmask(F.col("masked")))


@query(
    "fn_file_names",
    """SELECT p_partkey, printf('%06d.sst', p_partkey * 997) AS sst, printf('%06d.log', p_partkey) AS log, printf('MANIFEST-%06d', p_partkey) AS manifest, substr(rpad(p_name, 16, '_'), 1, 16) AS key, rpad('v_' || p_partkey || '_', 24, 'x') AS value,
    CASE p_size % 6 WHEN 0 THEN 'OK' ELSE (CASE p_size % 6 WHEN 1 THEN 'NotFound' WHEN 2 THEN 'Corruption' WHEN 3 THEN 'Not implemented' WHEN 4 THEN 'Invalid argument' ELSE 'IO error' END) || ': ' || p_brand || CASE WHEN p_size % 2 = 0 THEN '' ELSE ': ' || p_type END END AS status FROM part""",
)
def _(spark, d):
    n = F.col("p_partkey")
    more = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))
    return table(spark, d, "part").select(n, B.file_name(n * 997, "sst").alias("sst"), B.file_name(n, "log").alias("log"), B.manifest_name(n).alias("manifest"), B.fixed_key(F.col("p_name")).alias("key"), B.fixed_value(n, 24).alias("value"), B.status_text(F.col("p_size") % 6, F.col("p_brand"), more).alias("status"))


FILL = 20000


@query("wl_fillseq", f"SELECT printf('%016d', i) AS key, i + 1 AS seq, 1 AS vtype, rpad('v_' || i || '_', 100, 'x') AS value FROM range({FILL}) t(i)")
def _(spark, d):
    return W.fill_sequential(spark, FILL)


RANDOM_KEY = f"((((i * {W.SPREAD}) % 4294967296) >> 7) % {FILL})"


@query("wl_fillrandom_distinct", f"SELECT count(*) AS n, count(DISTINCT {RANDOM_KEY}) AS n_keys FROM range({FILL}) t(i)")
def _(spark, d):
    return W.fill_random(spark, FILL).agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


@query("wl_readrandom_found", f"WITH k AS (SELECT DISTINCT {RANDOM_KEY} AS key FROM range({FILL}) t(i)) SELECT count(*) AS n, count(key) AS n_found, round(count(key) / count(*), 6) AS found_ratio FROM range({FILL}) t(i) LEFT JOIN k ON key = (i * 7919) % {FILL}")
def _(spark, d):
    asked = spark.range(FILL).select(F.format_string("%016d", F.col("id") * 7919 % FILL).alias("key"))
    got = visible.multi_get(W.fill_random(spark, FILL), asked)
    return got.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "OK").alias("n_found")).withColumn("found_ratio", F.round(F.col("n_found") / F.col("n"), 6))


@query("wl_hot_churn", "WITH c AS (SELECT i, CASE WHEN i < 5000 THEN i ELSE (i % 5000) % 500 END AS k FROM range(20000) t(i)) SELECT rpad('k_' || lpad(CAST(k AS VARCHAR), 9, '0'), 16, '_') AS key, max(i) + 1 AS seq, rpad('v_' || max(i) % 5000 || '_', 100, 'x') AS value FROM c GROUP BY k")
def _(spark, d):
    return visible.live(W.churn(spark, 5000, 500, 3))


@query("wl_latency_percentiles", "SELECT CAST(user_id % 4 AS INTEGER) AS worker, count(*) AS n, round(quantile_cont(value, CAST(0.5 AS DOUBLE)), 6) AS p50, round(quantile_cont(value, CAST(0.95 AS DOUBLE)), 6) AS p95, round(quantile_cont(value, CAST(0.99 AS DOUBLE)), 6) AS p99 FROM events GROUP BY 1")
def _(spark, d):
    return W.percentiles(table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("worker"), F.col("value").alias("micros")))


@query(
    "wl_throughput",
    """WITH s AS (SELECT event_type, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS micros FROM events GROUP BY event_type)
    SELECT event_type, n, bytes, micros, round(n / (micros / 1e6::DOUBLE), 6) AS ops_per_sec, round(bytes / 1048576.0::DOUBLE / (micros / 1e6::DOUBLE), 6) AS mb_per_sec, round(micros / n, 6) AS micros_per_op FROM s""",
)
def _(spark, d):
    ops = table(spark, d, "events").select("event_type", F.floor(F.col("value") * 100).cast("long").alias("micros"), F.length("props").cast("long").alias("bytes"))
    return W.throughput("event_type", ops)


@query("wl_level_stats_text", f"WITH {STATS} SELECT string_agg('L' || level || ':' || n_files || 'f/' || bytes || 'b', '|' ORDER BY level) AS stats FROM stats")
def _(spark, d):
    return lsm.level_text(lsm.level_stats(_files(spark, d)))


@query("kv_scan_checksum", f"WITH {LIVE} SELECT count(*) AS n, CAST(sum(CAST(key AS BIGINT)) AS BIGINT) AS checksum FROM live")
def _(spark, d):
    return visible.live(_mut(spark, d)).agg(F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("checksum"))


@query(
    "lsm_locate_file",
    """WITH files AS (SELECT CAST(1 + p_partkey % 3 AS INTEGER) AS level, p_partkey AS file_no, lpad(CAST(p_partkey AS VARCHAR), 16, '0') AS smallest, lpad(CAST(p_partkey + 1 AS VARCHAR), 16, '0') AS largest FROM part),
    asked AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS key FROM customer),
    f AS (SELECT key, level, arg_min(file_no, largest) AS file_no, arg_min(smallest, largest) AS smallest FROM asked JOIN files ON largest >= key GROUP BY key, level)
    SELECT key, level, file_no FROM f WHERE smallest <= key""",
)
def _(spark, d):
    n = F.col("p_partkey")
    files = table(spark, d, "part").select((1 + n % 3).cast("int").alias("level"), n.alias("file_no"), fixed_width(n).alias("smallest"), fixed_width(n + 1).alias("largest"))
    return lsm.located(_asked(spark, d), files)


@query(
    "lsm_block_cut",
    f"""WITH RECURSIVE {PREFIXED.replace("prefixed AS", "prefixed AS MATERIALIZED")}, e AS MATERIALIZED (SELECT nth // 500 AS file_no, nth % 500 AS place, CAST({_varint("shared")} + {_varint("(length(key) - shared)")} + 1 + length(key) - shared + length(key) % 11 AS BIGINT) AS bytes FROM prefixed),
    r AS (SELECT file_no, place, bytes, CAST(0 AS BIGINT) AS block, bytes AS held FROM e WHERE place = 0
      UNION ALL SELECT e.file_no, e.place, e.bytes, CASE WHEN r.held >= 1024 THEN r.block + 1 ELSE r.block END, CASE WHEN r.held >= 1024 THEN e.bytes ELSE r.held + e.bytes END FROM r JOIN e ON e.file_no = r.file_no AND e.place = r.place + 1)
    SELECT file_no, place, bytes, block FROM r""",
)
def _(spark, d):
    k, v = F.length("key").cast("long"), (F.length("key") % 11).cast("long")
    entries = _prefixed(spark, d).select(F.floor(F.col("nth") / 500).cast("long").alias("file_no"), (F.col("nth") % 500).alias("place"), B.entry_size(F.col("shared"), k, v).alias("bytes"))
    return blocks.block_cuts(entries, 1024)


@query("manifest_apply_edit", f"WITH {FILES} SELECT level, file_no, file_size, smallest, largest FROM files WHERE file_no % 4 <> 0 UNION ALL SELECT level + 1, file_no + 1000000, file_size, smallest, largest FROM files WHERE file_no % 4 = 0")
def _(spark, d):
    files = _files(spark, d)
    gone = files.where("file_no % 4 = 0")
    new = gone.select((F.col("level") + 1).alias("level"), (F.col("file_no") + 1000000).alias("file_no"), "file_size", "smallest", "largest")
    return manifest.applied(files, gone.select("level", "file_no"), new)


@query("manifest_directory_stats", f"WITH {FILES} SELECT count(*) FILTER (WHERE file_no % 5 <> 0) AS n_tables, count(*) FILTER (WHERE file_no % 5 = 0) AS n_logs, CAST(sum(file_size) AS BIGINT) AS bytes FROM files")
def _(spark, d):
    n = F.col("file_no")
    listing = _files(spark, d).select(F.when(n % 5 == 0, B.file_name(n, "log")).otherwise(B.file_name(n, "sst")).alias("name"), F.col("file_size").alias("size"))
    return manifest.directory_stats(listing)


@query("manifest_obsolete_logs", "SELECT p_partkey AS log_no FROM part WHERE p_partkey < 100 ORDER BY log_no")
def _(spark, d):
    return manifest.obsolete_logs(table(spark, d, "part").select(F.col("p_partkey").alias("log_no")), 100)


@query("fn_slice_compare", "SELECT p_partkey, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS c FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", B.slice_compare(F.col("p_name"), F.col("p_type")).alias("c"))


def _varint_sql(x: str) -> str:
    n = _varint(x)
    return " || ".join(f"CASE WHEN {i} < {n} THEN printf('%02x', (({x} >> {7 * i}) & 127) | CASE WHEN {i} < {n} - 1 THEN 128 ELSE 0 END) ELSE '' END" for i in range(9))


@query("fn_varint_codec", f"WITH v AS (SELECT o_orderkey, o_orderkey * o_orderkey * 17 AS x FROM orders) SELECT o_orderkey, {_varint_sql('x')} AS digits, x AS value, CAST({_varint('x')} AS INTEGER) AS used FROM v")
def _(spark, d):
    digits = B.varint(F.col("o_orderkey") * F.col("o_orderkey") * 17)
    back = table(spark, d, "orders").select("o_orderkey", digits.alias("digits")).withColumn("back", B.varint_decode(F.unhex("digits")))
    return back.select("o_orderkey", "digits", "back.value", "back.used")


@query("fn_fixed_codec", "SELECT o_orderkey, " + " || ".join(f"printf('%02x', (o_orderkey * 977 >> {8 * i}) & 255)" for i in range(8)) + " AS digits, o_orderkey * 977 AS value FROM orders")
def _(spark, d):
    digits = B.fixed_le(F.col("o_orderkey") * 977, 8)
    return table(spark, d, "orders").select("o_orderkey", digits.alias("digits")).withColumn("value", B.fixed_le_decode(F.unhex("digits")))


@query("wl_worker_puts", "SELECT CAST(i // 500 AS INTEGER) AS worker, rpad('t' || printf('%03d', i // 500) || '_' || printf('%09d', i % 500), 16, '_') AS key, i + 1 AS seq, 1 AS vtype, rpad('v' || (i // 500) || '_' || (i % 500) || '_', 100, 'x') AS value FROM range(4000) t(i)")
def _(spark, d):
    return W.worker_puts(spark, 8, 500)


@query(
    "wl_compaction_ab",
    f"""WITH c AS (SELECT i, CASE WHEN i < 5000 THEN i ELSE (i % 5000) % 500 END AS k FROM range(20000) t(i)), k AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i DESC) AS r FROM c),
    z AS (SELECT count(*) AS n, count(*) FILTER (WHERE r = 1) AS m FROM k)
    SELECT n AS n_before, n * (1 + 24 + {_varint("100")} + 100) AS bytes_before, m AS n_after, m * (1 + 24 + 1 + 100) AS bytes_after, round(CAST(n AS DOUBLE) / m, 6) AS amplification FROM z""",
)
def _(spark, d):
    churned = W.churn(spark, 5000, 500, 3)
    return lsm.space(churned, lsm.compacted(churned))


# Entries of a run, 16 bytes apart, and the filters of their segments.
ENTRIES = f"{MUT}, keys AS (SELECT key FROM mut), {_hash16_sql('key')}, entries AS (SELECT (seq * 16) >> 11 AS segment, key FROM mut)"
SEGMENTS = f"""{ENTRIES}, size AS (SELECT segment, (greatest(64, count(*) * {BLOOM_BITS_PER_KEY}) + 7) // 8 * 8 AS bits FROM entries GROUP BY segment),
    own AS (SELECT DISTINCT segment, bits, CAST(((h + j * (((h >> 17) | (h << 15)) & {B.U32})) & {B.U32}) % bits AS BIGINT) AS bit FROM entries JOIN size USING (segment) JOIN h4 USING (key), range(6) t(j))"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return _mut(spark, d).select((F.col("seq") * 16).alias("offset"), "key")


@query("lsm_segment_filter_bits", f"WITH {SEGMENTS} SELECT segment, bits, bit FROM own")
def _(spark, d):
    own = _entries(spark, d).select(B.filter_segment(F.col("offset")).alias("segment"), "key")
    return filters.BloomPolicy(BLOOM_BITS_PER_KEY).bits(own, "segment")


@query(
    "lsm_segment_filters",
    f"""WITH {SEGMENTS}, octets AS (SELECT segment, bits, bit >> 3 AS nth, CAST(sum(1 << (bit % 8)) AS BIGINT) AS octet FROM own GROUP BY segment, bits, bit >> 3),
    each AS (SELECT segment, bits, unnest(range(bits // 8)) AS nth FROM size)
    SELECT segment, lower(string_agg(printf('%02x', coalesce(octet, 0)), '' ORDER BY nth)) || '06' AS filter FROM each LEFT JOIN octets USING (segment, bits, nth) GROUP BY segment""",
)
def _(spark, d):
    made = filters.segment_filters(_entries(spark, d), filters.BloomPolicy(BLOOM_BITS_PER_KEY))
    return made.select("segment", F.lower(F.hex("filter")).alias("filter"))


@query(
    "lsm_segment_probe",
    f"""WITH {MUT}, asked AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS key, c_custkey % 12 AS segment FROM customer),
    keys AS (SELECT key FROM mut UNION SELECT key FROM asked), {_hash16_sql('key')}, entries AS (SELECT (seq * 16) >> 11 AS segment, key FROM mut),
    size AS (SELECT segment, (greatest(64, count(*) * {BLOOM_BITS_PER_KEY}) + 7) // 8 * 8 AS bits FROM entries GROUP BY segment),
    own AS (SELECT DISTINCT segment, CAST(((h + j * (((h >> 17) | (h << 15)) & {B.U32})) & {B.U32}) % bits AS BIGINT) AS bit FROM entries JOIN size USING (segment) JOIN h4 USING (key), range(6) t(j)),
    probes AS (SELECT key, segment, CAST(((h + j * (((h >> 17) | (h << 15)) & {B.U32})) & {B.U32}) % bits AS BIGINT) AS bit FROM asked JOIN size USING (segment) JOIN h4 USING (key), range(6) t(j)),
    hit AS (SELECT key, segment, bool_and(own.bit IS NOT NULL) AS may_match FROM probes LEFT JOIN own USING (segment, bit) GROUP BY key, segment)
    SELECT key, segment, coalesce(may_match, false) AS may_match FROM asked LEFT JOIN hit USING (key, segment)""",
)
def _(spark, d):
    policy = filters.BloomPolicy(BLOOM_BITS_PER_KEY)
    asked = table(spark, d, "customer").select(fixed_width(F.col("c_custkey")).alias("key"), (F.col("c_custkey") % 12).alias("segment"))
    return filters.filtered(asked, filters.segment_filters(_entries(spark, d), policy), policy)


def _varint_pair_sql(x: str) -> str:
    return "(" + _varint_sql(x) + ")"


@query("fn_block_handle", f"WITH h AS (SELECT o_orderkey, o_orderkey * 131 AS a, o_custkey * 977 AS b FROM orders) SELECT o_orderkey, {_varint_pair_sql('a')} || {_varint_pair_sql('b')} AS digits, a AS offset, b AS size, CAST({_varint('a')} + {_varint('b')} AS INTEGER) AS used FROM h")
def _(spark, d):
    handle = B.block_handle(F.col("o_orderkey") * 131, F.col("o_custkey") * 977)
    made = table(spark, d, "orders").select("o_orderkey", handle.alias("digits")).withColumn("h", B.block_handle_decode(F.unhex("digits")))
    return made.select("o_orderkey", "digits", "h.offset", "h.size", "h.used")


_MAGIC = B.TABLE_MAGIC.to_bytes(8, "little").hex()


@query(
    "fn_footer",
    f"""WITH f AS (SELECT p_partkey, p_partkey * 4096 AS a, p_size AS b, p_partkey * 4097 + 7 AS c, p_partkey % 300 AS d FROM part)
    SELECT p_partkey, rpad({_varint_pair_sql('a')} || {_varint_pair_sql('b')} || {_varint_pair_sql('c')} || {_varint_pair_sql('d')}, 80, '0') || '{_MAGIC}' AS digits,
    CASE WHEN p_partkey % 5 > 0 THEN a END AS meta_offset, CASE WHEN p_partkey % 5 > 0 THEN CAST(b AS BIGINT) END AS meta_size, CASE WHEN p_partkey % 5 > 0 THEN c END AS index_offset, CASE WHEN p_partkey % 5 > 0 THEN d END AS index_size FROM f""",
)
def _(spark, d):
    n = F.col("p_partkey")
    digits = B.footer(n * 4096, F.col("p_size").cast("long"), n * 4097 + 7, n % 300)
    # every fifth one is read with its magic number damaged
    stored = F.unhex(F.when(n % 5 > 0, F.col("digits")).otherwise(F.concat(F.substring("digits", 1, 94), F.lit("00"))))
    made = table(spark, d, "part").select(n, digits.alias("digits")).withColumn("f", B.footer_decode(stored))
    return made.select(n, "digits", "f.meta_offset", "f.meta_size", "f.index_offset", "f.index_size")


@query("manifest_live_files", f"WITH {REPLAYED} SELECT file_no, level FROM alive UNION SELECT file_no, level FROM files WHERE file_no % 4 <> 0")
def _(spark, d):
    files = _files(spark, d)
    return manifest.live_files([manifest.replayed(_edits(files)), files.where("file_no % 4 <> 0")])


@query("manifest_files_in_order", f"WITH {FILES} SELECT level, file_no, smallest, row_number() OVER (PARTITION BY level ORDER BY smallest, file_no) AS place FROM files")
def _(spark, d):
    return manifest.in_order(_files(spark, d))


@query("lsm_block_index", f"{ORACLE_SQL['lsm_block_cut'].replace('SELECT file_no, place, bytes, block FROM r', '').rstrip()} SELECT file_no, block, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, max(place) AS last_place FROM r GROUP BY file_no, block")
def _(spark, d):
    return blocks.block_index(QUERIES["lsm_block_cut"](spark, d))
