"""Byte-level functions as Column expressions: hashes, checksums, varints, tags and sizes.

Binary arguments may hold any bytes. Unsigned 32-bit results are longs. ANSI mode raises on overflow, so 32-bit
products are made of 16-bit halves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
HASH_MULTIPLIER = 0xC6A4A793
BLOOM_SEED = 0xBC9F1D34
CRC32C_POLYNOMIAL = 0x82F63B78
CRC_MASK_DELTA = 0xA282EAD8
TABLE_MAGIC = 0xDB4775248B80FB57
LOG_BLOCK, LOG_HEADER = 32768, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
FILTER_BASE_BITS = 11
RESTART_INTERVAL = 16

U32 = 0xFFFFFFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; a column named twice in an expression may be computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_values(b: Column) -> Column:
    """The bytes as an array of longs."""
    data = b.cast("binary")
    # read as Latin-1, each byte is the character of its number
    each = lambda text: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(data))), lambda i: F.ascii(F.call_function("substring", text, i, F.lit(1))).cast("long"))
    return F.when(F.length(data) == 0, F.array().cast("array<bigint>")).otherwise(let(F.decode(data, "ISO-8859-1"), each))


def slice_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes, a prefix first."""
    x, y = a.cast("binary"), b.cast("binary")
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def pack_tag(seq: Column, vtype: Column) -> Column:
    """The sequence number and the type in one number; for sequence numbers under 2^55."""
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(vtype.cast("long"))


def tag_seq(tag: Column) -> Column:
    return F.shiftrightunsigned(tag, 8)


def tag_type(tag: Column) -> Column:
    return tag.bitwiseAND(_long(0xFF)).cast("int")


def multiply32(a: Column, m: int) -> Column:
    """a * m mod 2^32 for 0 <= a < 2^32."""
    low = a.bitwiseAND(_long(0xFFFF)) * _long(m)
    high = F.shiftleft((F.shiftright(a, 16) * _long(m)).bitwiseAND(_long(0xFFFF)), 16)
    return (low + high).bitwiseAND(_long(U32))


def add32(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(_long(U32))


def hash32(b: Column, seed: int = BLOOM_SEED) -> Column:
    """The 32-bit hash: little-endian words of four bytes, then a tail of one to three."""
    return let(byte_values(b), lambda values: _hash_of(values, seed))


def _hash_of(values: Column, seed: int) -> Column:
    n = F.size(values)
    start = _long(seed).bitwiseXOR(multiply32(n.cast("long"), HASH_MULTIPLIER))

    def at(i: Column) -> Column:
        return F.coalesce(F.try_element_at(values, i + 1), _long(0))

    def word(i: Column) -> Column:
        return at(i) + F.shiftleft(at(i + 1), 8) + F.shiftleft(at(i + 2), 16) + F.shiftleft(at(i + 3), 24)

    def turn(h: Column, i: Column) -> Column:
        def shifted(x: Column) -> Column:
            return x.bitwiseXOR(F.when(i + 4 <= n, F.shiftright(x, 16)).otherwise(F.shiftright(x, 24)))

        return let(add32(h, word(i)), lambda x: let(multiply32(x, HASH_MULTIPLIER), shifted))

    return F.when(n == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(4)), start, turn))


def crc32c_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (CRC32C_POLYNOMIAL if i & 1 else 0)
        out.append(i)
    return out


def crc32c(b: Column) -> Column:
    """The Castagnoli checksum; Spark's own crc32 has another polynomial."""
    steps = F.array(*(_long(x) for x in crc32c_table()))
    turn = lambda c, x: F.shiftright(c, 8).bitwiseXOR(F.element_at(steps, (c.bitwiseXOR(x).bitwiseAND(_long(0xFF)) + 1).cast("int")))
    return F.aggregate(byte_values(b), _long(U32), turn).bitwiseXOR(_long(U32))


def _rotated(x: Column, right: int) -> Column:
    return F.shiftright(x, right).bitwiseOR(F.shiftleft(x, 32 - right)).bitwiseAND(_long(U32))


def crc_mask(crc: Column) -> Column:
    return add32(_rotated(crc, 15), _long(CRC_MASK_DELTA))


def crc_unmask(masked: Column) -> Column:
    return _rotated(add32(masked, _long((1 << 32) - CRC_MASK_DELTA)), 17)


def bloom_probes(bits_per_key: int) -> int:
    return min(30, max(1, int(bits_per_key * 0.69)))


def bloom_bits(n_keys: Column, bits_per_key: int) -> Column:
    """The number of bits of a filter: 64 at least, whole bytes."""
    return F.floor((F.greatest(_long(64), n_keys * bits_per_key) + 7) / 8).cast("long") * 8


def bloom_positions(key: Column, bits: Column, k: int) -> Column:
    """The array of bits of a key, repeats included."""
    probes = F.array(*(_long(j) for j in range(k)))
    return let(hash32(key), lambda h: let(_rotated(h, 17), lambda d: F.transform(probes, lambda j: (h + j * d).bitwiseAND(_long(U32)) % bits)))


def bloom_filter(positions: Column, bits: Column, k: int) -> Column:
    """The filter's hex digits, with k as the last byte, from the array of the bits set."""
    bit = lambda p: F.call_function("shiftleft", _long(1), (p % 8).cast("int"))
    one = lambda byte: F.lpad(F.hex(F.aggregate(F.filter(positions, lambda p: F.shiftright(p, 3) == byte), _long(0), lambda a, p: a.bitwiseOR(bit(p)))), 2, "0")
    return F.lower(F.concat(F.array_join(F.transform(F.sequence(_long(0), F.floor(bits / 8) - 1), one), ""), F.lpad(F.hex(F.lit(k)), 2, "0")))


def bloom_may_match(key: Column, bloom: Column) -> Column:
    """Whether a key may be in a filter (its bytes, the last one the number of probes).

    A filter of fewer than two bytes holds nothing; one of more than 30 probes is of a kind that is not known yet, and
    may hold anything.
    """

    def probed(data: Column, k: Column) -> Column:
        bits = ((F.length(data) - 1) * 8).cast("long")
        byte = lambda p: F.ascii(F.call_function("substring", F.decode(data, "ISO-8859-1"), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))).cast("long")
        is_set = lambda p: F.call_function("shiftright", byte(p), (p % 8).cast("int")).bitwiseAND(_long(1)) == 1
        places = lambda h: let(_rotated(h, 17), lambda d: F.transform(F.sequence(_long(0), F.greatest(k, _long(1)) - 1), lambda j: (h + j * d).bitwiseAND(_long(U32)) % bits))
        return F.when(k > 30, True).when(k == 0, True).otherwise(F.forall(let(hash32(key), places), is_set))

    data = bloom.cast("binary")
    last = lambda d: F.conv(F.hex(F.call_function("substring", d, F.length(d), F.lit(1))), 16, 10).cast("long")
    return F.when(F.length(data) < 2, False).otherwise(let(data, lambda d: probed(d, last(d))))


def filter_segment(offset: Column) -> Column:
    return F.shiftright(offset, FILTER_BASE_BITS)


def varint_len(v: Column) -> Column:
    """Bytes of a varint of a number of 0 or more."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(v < _long(1 << (7 * n)), n).otherwise(out)
    return out.cast("long")


def varint(v: Column) -> Column:
    """The bytes of a varint, in hex digits."""
    n = varint_len(v)
    parts = F.array(*(F.when(F.lit(i) < n, F.lpad(F.hex((F.shiftrightunsigned(v.cast("long"), 7 * i).bitwiseAND(_long(0x7F)) + F.when(F.lit(i) < n - 1, 128).otherwise(0)).cast("long")), 2, "0")).otherwise("") for i in range(9)))
    return F.lower(F.array_join(parts, ""))


def varint_decode(b: Column, most: int = 10) -> Column:
    """(value, used) of the varint that the bytes begin with; null if they end before it does or it is over `most` bytes."""
    return let(byte_values(b), lambda values: _varint_of(values, most))


def _varint_of(values: Column, most: int) -> Column:
    """One pass: the value so far, the bytes used, and whether one without the high bit has come."""
    start = F.struct(_long(0).alias("value"), F.lit(0).alias("used"), F.lit(False).alias("whole"))

    def turn(a: Column, x: Column) -> Column:
        value = a["value"].bitwiseOR(F.call_function("shiftleft", x.bitwiseAND(_long(0x7F)), a["used"] * 7))
        return F.when(a["whole"], a).otherwise(F.struct(value.alias("value"), (a["used"] + 1).alias("used"), (x < 128).alias("whole")))

    return let(F.aggregate(F.slice(values, 1, most), start, turn), lambda a: F.when(a["whole"], F.struct(a["value"].alias("value"), a["used"].alias("used"))))


def fixed_le(v: Column, width: int) -> Column:
    """A number in little-endian hex digits, of 4 or 8 bytes."""
    digits = F.lpad(F.hex(v.cast("long")), 16, "0")
    return F.lower(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(width))))


def fixed_le_decode(b: Column) -> Column:
    return F.aggregate(F.reverse(byte_values(b)), _long(0), lambda a, x: F.shiftleft(a, 8).bitwiseOR(x))


def shared_prefix_len(a: Column, b: Column) -> Column:
    """The length of the longest common prefix, of strings."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.call_function("substring", a, i, F.lit(1)) != F.call_function("substring", b, i, F.lit(1)))
    return F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n).cast("long")


def entry_size(shared: Column, key_len: Column, value_len: Column) -> Column:
    """Bytes of a prefix-compressed block entry."""
    rest = key_len - shared
    return varint_len(shared) + varint_len(rest) + varint_len(value_len) + rest + value_len


def memtable_entry_size(key_len: Column, value_len: Column) -> Column:
    return varint_len(key_len + 8) + key_len + 8 + varint_len(value_len) + value_len


def wal_record_size(vtype: Column, key_len: Column, value_len: Column) -> Column:
    """Bytes of a record in a log payload; the payload has 12 more."""
    return 1 + varint_len(key_len) + key_len + F.when(vtype == 1, varint_len(value_len) + value_len).otherwise(0)


def batch_record_size(vtype: Column, key_len: Column, value_len: Column) -> Column:
    return key_len + F.when(vtype == 1, value_len).otherwise(0) + 8


def wal_fragments(length: Column, offset: Column) -> Column:
    """The array of (type, length) of the pieces that a record of `length` bytes becomes from `offset` of the log on.

    A block has LOG_BLOCK bytes; what is left of one goes unused if a header does not fit in it.
    """
    room = LOG_BLOCK - offset % LOG_BLOCK
    start = F.when(room < LOG_HEADER, LOG_BLOCK).otherwise(room) - LOG_HEADER
    whole = LOG_BLOCK - LOG_HEADER
    rest = F.greatest(_long(0), length - start)
    n = (1 + F.ceil(rest / whole)).cast("int")

    def piece(i: Column) -> Column:
        size = F.when(i == 0, F.least(length, start)).otherwise(F.least(_long(whole), rest - (i - 1) * whole))
        kind = F.when(n == 1, FULL).when(i == 0, FIRST).when(i == n - 1, LAST).otherwise(MIDDLE)
        return F.struct(kind.alias("kind"), size.cast("long").alias("length"))

    return F.transform(F.sequence(F.lit(0), n - 1), piece)


def block_handle(offset: Column, size: Column) -> Column:
    return F.concat(varint(offset), varint(size))


def footer(meta_offset: Column, meta_size: Column, index_offset: Column, index_size: Column) -> Column:
    """The 48 bytes at a table's end, in hex digits: two handles filled up to 40 bytes, and the magic number."""
    magic = TABLE_MAGIC.to_bytes(8, "little").hex()
    return F.concat(F.rpad(F.concat(block_handle(meta_offset, meta_size), block_handle(index_offset, index_size)), 80, "0"), F.lit(magic))


def varints_decode(b: Column, count: int) -> Column:
    """(found, used) of the `count` varints that the bytes begin with, in one pass; null if they end before, or one is over 10 bytes."""
    start = F.struct(F.array().cast("array<bigint>").alias("found"), _long(0).alias("value"), F.lit(0).alias("shift"), F.lit(0).alias("used"))

    def turn(a: Column, x: Column) -> Column:
        value, ends = a["value"].bitwiseOR(F.call_function("shiftleft", x.bitwiseAND(_long(0x7F)), a["shift"])), x < 128
        found = F.when(ends, F.concat(a["found"], F.array(value))).otherwise(a["found"])
        more = F.struct(found.alias("found"), F.when(ends, _long(0)).otherwise(value).alias("value"), F.when(ends, 0).otherwise(a["shift"] + 7).alias("shift"), (a["used"] + 1).alias("used"))
        return F.when((F.size(a["found"]) == count) | (a["shift"] > 63), a).otherwise(more)

    whole = lambda a: F.when(F.size(a["found"]) == count, F.struct(a["found"].alias("found"), a["used"].alias("used")))
    return let(F.aggregate(F.slice(byte_values(b), 1, 10 * count), start, turn), whole)


def block_handle_decode(b: Column) -> Column:
    """(offset, size, used) of the handle that the bytes begin with; null if they end before it does."""
    part = lambda x: F.when(x.isNotNull(), F.struct(x["found"][0].alias("offset"), x["found"][1].alias("size"), x["used"].alias("used")))
    return let(varints_decode(b, 2), part)


def footer_decode(b: Column) -> Column:
    """(meta_offset, meta_size, index_offset, index_size) of a table's last 48 bytes; null if they are not 48, or their magic number or a handle is wrong."""
    data, names = b.cast("binary"), ("meta_offset", "meta_size", "index_offset", "index_size")
    magic = F.lower(F.hex(F.call_function("substring", data, F.lit(41), F.lit(8)))) == TABLE_MAGIC.to_bytes(8, "little").hex()
    handles = lambda x: F.when(x.isNotNull(), F.struct(*(x["found"][i].alias(name) for i, name in enumerate(names))))
    return F.when((F.length(data) == 48) & magic, let(varints_decode(data, 4), handles))


def file_name(number: Column, extension: str) -> Column:
    return F.format_string(f"%06d.{extension}", number)


def manifest_name(number: Column) -> Column:
    return F.format_string("MANIFEST-%06d", number)


def fixed_key(s: Column, width: int = 16) -> Column:
    return F.rpad(s, width, "_")


def fixed_value(i: Column, n: int) -> Column:
    return F.rpad(F.concat(F.lit("v_"), i.cast("string"), F.lit("_")), n, "x")


#: Status names by code.
STATUS = ("OK", "NotFound", "Corruption", "Not implemented", "Invalid argument", "IO error")


def status_text(code: Column, message: Column, more: Column) -> Column:
    """"<kind>: message[: more]", or "OK"."""
    kind = F.element_at(F.array(*(F.lit(x) for x in STATUS)), code + 1)
    both = F.concat_ws(": ", kind, message, F.when(F.length(more) > 0, more))
    return F.when(code == 0, "OK").otherwise(both)
