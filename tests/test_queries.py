"""Every catalogue query against DuckDB on the same tables."""

import duckdb
import pytest

from varve.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert {c: TYPES[t] for c, t in df.dtypes} == {x[0]: str(x[1]) for x in rel.description}
    at = [names.index(c) for c in cols]
    assert ordered(got) == ordered([tuple(r[i] for i in at) for r in rel.fetchall()])


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_known_counts(spark):
    from pyspark.sql import functions as F

    from varve.model import mut_of_events, table
    from varve.operators import lsm, visible

    mut = mut_of_events(table(spark, "/root/testdata/sf0.01", "events"))
    assert visible.live(mut).count() == 120
    assert visible.live(mut, 5000).count() == 123
    kept = lsm.compacted(mut, 5000)
    assert kept.count() == 5150 and visible.live(kept, 5000).count() == 123
    raw = lsm.compacted_raw(mut, 5000)
    assert raw.count() == 5001 and visible.live(raw, 5000).count() == 1
    assert mut.agg(F.max("seq")).first()[0] == 10000


def test_block_index_and_csv(spark, tmp_path):
    from varve.operators.blocks import block_cuts, block_index
    from varve.workloads import append_csv

    entries = spark.createDataFrame([(1, i, 10) for i in range(7)] + [(2, 0, 99)], "file_no long, place long, bytes long")
    got = sorted(tuple(r) for r in block_index(block_cuts(entries, 25)).collect())
    assert got == [(1, 0, 3, 30, 2), (1, 1, 3, 30, 5), (1, 2, 1, 10, 6), (2, 0, 1, 99, 0)]
    for _ in range(2):
        append_csv(spark.createDataFrame([("fillseq", 1.5)], "name string, seconds double"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
