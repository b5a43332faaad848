"""Golden vectors and round trips of the byte-level functions."""

import struct

import pytest
from pyspark.sql import functions as F

from varve.functions import bytesfn as B
from varve.sources import wal

GOLDEN = [
    (b"", 3164544308, 0x00000000, 0xA282EAD8),
    (b"a", 678337968, 0xC1D04330, 0x28E46E78),
    (b"ab", 967615280, 0xE2A22936, 0xF4F0B01C),
    (b"abc", 2237464879, 0x364B3FB7, 0x21F1576E),
    (b"abcd", 3116905299, 0x92C80A31, 0xB6E61068),
    (b"0000000000000042", 360884719, 0x6E8B7C41, 0x9B05C7EE),
    (b"k_000000001_____", 1750075965, 0x45CBFCFC, 0x9C7B766F),
    (b"u1______________", 1879910447, 0x968BDCFE, 0x5C8017EF),
]


def rows(spark, values, schema):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def test_hashes(spark):
    df = rows(spark, [bytearray(g[0]) for g in GOLDEN], "b binary")
    crc = B.crc32c(F.col("b"))
    got = df.select("b", B.hash32(F.col("b")), crc, B.crc_mask(crc), B.crc_unmask(B.crc_mask(crc))).collect()
    assert [(bytes(r[0]), r[1], r[2], r[3]) for r in got] == GOLDEN
    assert all(r[4] == r[2] for r in got)
    assert wal.crc32c(b"123456789") == 0xE3069283 and wal.masked(wal.crc32c(b"ab")) == 0xF4F0B01C


def test_bloom(spark):
    keys = rows(spark, ["u1" + "_" * 14, "u2" + "_" * 14], "key string")
    k = B.bloom_probes(10)
    bits = F.lit(64).cast("long")
    got = keys.select(F.explode(B.bloom_positions(F.col("key"), bits, k)).alias("p")).agg(F.collect_set("p").alias("p")).select(B.bloom_filter(F.col("p"), bits, k)).first()[0]
    assert k == 6 and got == "aa2200000080208806"
    assert spark.range(1).select(B.bloom_bits(F.lit(10000), 10)).first()[0] == 100000


def test_varints_and_fixed(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**35 - 1, 2**55, 2**62]
    got = rows(spark, values, "v long").select("v", B.varint_len(F.col("v")), B.varint(F.col("v")), B.fixed_le(F.col("v"), 8)).collect()
    for v, n, digits, fixed in got:
        assert bytes.fromhex(digits) == wal.varint(v) and n == len(wal.varint(v)) and bytes.fromhex(fixed) == struct.pack("<Q", v)
    df = rows(spark, [bytearray(wal.varint(v) + b"\x05") for v in values] + [bytearray(b"\x80"), bytearray(b"")], "b binary")
    back = [r[0] for r in df.select(B.varint_decode(F.col("b"))).collect()]
    assert [(r["value"], r["used"]) for r in back[:-2]] == [(v, len(wal.varint(v))) for v in values] and back[-2:] == [None, None]
    assert rows(spark, [bytearray(struct.pack("<I", 77))], "b binary").select(B.fixed_le_decode(F.col("b"))).first()[0] == 77


def test_tags_and_handles(spark):
    one = spark.range(1)
    assert one.select(B.pack_tag(F.lit(1), F.lit(1)), B.pack_tag(F.lit(1), F.lit(0)), B.pack_tag(F.lit(300), F.lit(1))).first() == (257, 256, 76801)
    n = lambda x: F.lit(x).cast("long")
    foot = bytes.fromhex(one.select(B.footer(n(300), n(5), n(310), n(128))).first()[0])
    assert len(foot) == 48 and foot[:7] == wal.varint(300) + b"\x05" + wal.varint(310) + wal.varint(128) and struct.unpack("<Q", foot[40:])[0] == B.TABLE_MAGIC
    assert [r[0] for r in rows(spark, [("a", "b"), ("b", "a"), ("a", "a"), ("a", "ab")], "x string, y string").select(B.slice_compare(F.col("x"), F.col("y"))).collect()] == [-1, 1, 0, -1]


@pytest.mark.parametrize(("size", "pieces", "end"), [(0, [(1, 0)], 7), (100, [(1, 100)], 107), (32761, [(1, 32761)], 32768), (32762, [(2, 32761), (4, 1)], 32776), (100000, [(2, 32761), (3, 32761), (3, 32761), (4, 1717)], 3 * 32768 + 1724)])
def test_fragments(spark, size, pieces, end):
    got = spark.range(1).select(B.wal_fragments(F.lit(size).cast("long"), F.lit(0).cast("long"))).first()[0]
    assert [(p["kind"], p["length"]) for p in got] == pieces
    assert len(wal.framed([bytes(size)])) == end


def test_shared_prefix(spark):
    df = rows(spark, [("abc", "abd"), ("", "a"), ("abc", "abc"), ("ab", "abc"), ("x", "abc")], "a string, b string")
    assert [r[0] for r in df.select(B.shared_prefix_len(F.col("a"), F.col("b"))).collect()] == [2, 0, 3, 2, 0]


def test_handles_and_footers_read_back(spark):
    n = lambda x: F.lit(x).cast("long")
    foot = spark.range(1).select(B.footer(n(300), n(5), n(310), n(1 << 40))).first()[0]
    cases = [foot, foot[:-2] + "00", foot[:-2], "80" * 20 + foot[40:], ""]
    got = [r[0] for r in rows(spark, cases, "h string").select(B.footer_decode(F.unhex("h"))).collect()]
    assert tuple(got[0]) == (300, 5, 310, 1 << 40) and got[1:] == [None] * 4
    got = [r[0] for r in rows(spark, ["ac0205", "ac02", "80", "", "00007f"], "h string").select(B.block_handle_decode(F.unhex("h"))).collect()]
    assert tuple(got[0]) == (300, 5, 3) and got[1:4] == [None] * 3 and tuple(got[4]) == (0, 0, 2)


def test_filters_of_segments(spark):
    from varve.operators.filters import BloomPolicy, filtered, segment_filters

    policy = BloomPolicy(10)
    keys = [(o, f"k{o:06d}".encode() * (1 + o % 3)) for o in range(0, 9000, 37) if not 4096 <= o < 6144]
    made = segment_filters(rows(spark, [(o, bytearray(k)) for o, k in keys], "offset long, key binary"), policy)
    by = {r["segment"]: bytes(r["filter"]) for r in made.collect()}
    assert sorted(by) == [0, 1, 2, 3, 4] and by[2] == bytes(8) + b"\x06" and all(f[-1] == 6 for f in by.values())
    asked = rows(spark, [(o >> 11, bytearray(k)) for o, k in keys] + [(s, bytearray(b"none%d" % i)) for i in range(200) for s in (0, 2)] + [(9, bytearray(b"x"))], "segment long, key binary")
    got = filtered(asked, made, policy).collect()
    assert all(r["may_match"] for r in got if not bytes(r["key"]).startswith((b"none", b"x")))
    assert not any(r["may_match"] for r in got if r["segment"] in (2, 9)) and sum(r["may_match"] for r in got if bytes(r["key"]).startswith(b"none")) < 20
    odd = rows(spark, [bytearray(), bytearray(b"\x06"), bytearray(b"\0\x1f"), bytearray(b"\0\x1e"), bytearray(b"\0\0"), bytearray(b"\xff\x06")], "f binary")
    assert [r[0] for r in odd.select(B.bloom_may_match(F.lit("a"), F.col("f"))).collect()] == [False, False, True, False, True, True]
