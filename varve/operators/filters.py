"""Filters over keys: a policy that builds and asks them, and one filter for each segment of a run."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytesfn as B


class FilterPolicy(Protocol):
    """How a filter is made of keys and asked for one. A filter never denies a key that it was made of."""

    name: str

    def build(self, keys: DataFrame, group: str) -> DataFrame:
        """(group, filter binary) of rows (group, key)."""

    def may_match(self, key: Column, made: Column) -> Column:
        """Whether a key may be one that the filter was made of."""


class BloomPolicy:
    """Bloom filters by double hashing, as bits and a last byte with the number of probes. For groups of blocks or files: a filter is one row."""

    def __init__(self, bits_per_key: int = 10) -> None:
        self.name, self.bits_per_key, self.probes = "BuiltinBloomFilter", bits_per_key, B.bloom_probes(bits_per_key)

    def bits(self, keys: DataFrame, group: str) -> DataFrame:
        """(group, bits, bit): the different bits that are set, with the size of the group's filter. A group with no key but null has none set."""
        sizes = keys.groupBy(F.col(group).alias("__of")).agg(B.bloom_bits(F.count("key"), self.bits_per_key).alias("bits"))
        each = keys.join(sizes, F.col(group).eqNullSafe(F.col("__of")))
        bit = F.explode_outer(B.bloom_positions(F.col("key"), F.col("bits"), self.probes))
        return each.select(group, "bits", F.when(F.col("key").isNotNull(), F.lit(True)).alias("__own"), bit.alias("bit")).select(group, "bits", F.when(F.col("__own"), F.col("bit")).alias("bit")).distinct()

    def build(self, keys: DataFrame, group: str) -> DataFrame:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 8).cast("int"))
        octets = self.bits(keys, group).groupBy(group, "bits", F.shiftright("bit", 3).alias("at")).agg(F.bit_or(one).alias("octet"))
        found = octets.groupBy(group, "bits").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "octet")))).alias("found"))
        # the octets in order with what lies between them filled up: each knows where the one before it ended
        gap = lambda x, i: x["at"] - F.when(i == 0, 0).otherwise(F.get(F.col("found"), i - 1)["at"] + 1)
        piece = lambda x, i: F.concat(F.repeat(F.lit("00"), gap(x, i).cast("int")), F.lpad(F.hex(x["octet"]), 2, "0"))
        digits = F.rpad(F.array_join(F.transform("found", piece), ""), (F.col("bits") / 4).cast("int"), F.lit("0"))
        return found.select(group, F.unhex(F.concat(digits, F.lit(f"{self.probes:02x}"))).alias("filter"))

    def may_match(self, key: Column, made: Column) -> Column:
        return B.bloom_may_match(key, made)


def segment_filters(entries: DataFrame, policy: FilterPolicy) -> DataFrame:
    """(segment, filter) of entries (offset, key): one for each segment of offsets from the first one on, also for those without keys."""
    own = entries.select(B.filter_segment(F.col("offset")).alias("segment"), "key")
    last = own.agg(F.max("segment").alias("last"))
    none = last.where("last is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("segment"), F.lit(None).cast(entries.schema["key"].dataType).alias("key"))
    return policy.build(own.unionByName(none), "segment")


def filtered(probes: DataFrame, filters: DataFrame, policy: FilterPolicy) -> DataFrame:
    """probes (segment, key) with may_match; false where the segment has no filter."""
    own = filters.select(F.col("segment").alias("__segment"), "filter")
    asked = probes.join(own, F.col("segment") == F.col("__segment"), "left")
    return asked.withColumn("may_match", F.coalesce(policy.may_match(F.col("key"), F.col("filter")), F.lit(False))).drop("__segment", "filter")
