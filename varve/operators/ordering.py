"""Orders over whole relations without one task that sees every row.

Running sums, ranks and neighbours are made in two levels: inside ranges of the order, then over the ranges' summaries,
one row a range. The ranges come from a sample of the rows' places in the order, drawn by hash, so they hold about
as many rows each whatever the keys look like; places take in all that orders the rows, so a key with very many
versions is cut too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places that are drawn for each range.
DRAWN = 24

#: Points that pairs with spans are made from at a time.
BLOCK = 64


def _place(by: list[Column | str]) -> Column:
    """What rows are ordered by, ascending, as one value that compares."""
    return F.struct(*(c if isinstance(c, Column) else F.col(c) for c in by))


class Ranges:
    """Ranges of the order `by` that hold about as many rows of df each: as many as there are shuffle partitions, at most.

    One pass over the places with partial aggregates finds them; DRAWN places a range come to the driver.
    """

    def __init__(self, df: DataFrame, *by: Column | str, parts: int | None = None) -> None:
        self.parts = max(1, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        place = F.col("__place")
        drawn = df.select(_place(list(by)).alias("__place")).groupBy(F.pmod(F.xxhash64(place), F.lit(self.parts * DRAWN)).alias("__lot"))
        drawn = drawn.agg(F.min_by(place, F.xxhash64(F.lit(1), place)).alias("__place"))
        found = drawn.select("__place").distinct().orderBy("__place").collect()  # one row a lot
        step = max(1.0, len(found) / self.parts)
        picked = [found[int(i * step)]["__place"] for i in range(1, self.parts) if int(i * step) < len(found)]
        kinds = drawn.schema["__place"].dataType.fields
        lits = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(p, kinds, strict=True))) for p in picked]
        self.bounds, self.n = F.array(*lits), len(picked)

    def of(self, *by: Column | str) -> Column:
        """The range of a place: the number of bounds at or before it, by bisection.

        The place is in what the steps begin with, not in their function: of a session's first columns inside it Spark lost sight, and
        inferred filters of relations without them. Likely it takes them for the function's variables, which it numbers from 0 to compare.
        """
        if not self.n:
            return F.lit(0)
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(self.n.bit_length()))))
        step = lambda s, w: F.when(F.get(self.bounds, s["at"] + w - 1) <= s["place"], s["at"] + w).otherwise(s["at"])
        begin = F.struct(F.lit(0).alias("at"), _place(list(by)).alias("place"))
        return F.aggregate(steps, begin, lambda s, w: F.struct(step(s, w).alias("at"), s["place"].alias("place")), lambda s: s["at"])


def running(df: DataFrame, by: list[Column | str], amount: Column, name: str) -> DataFrame:
    """df with `name`: the sum of amount over all rows before this one, in the ascending order of `by`."""
    cols, at = df.columns, Ranges(df, *by).of(*by)
    inside = Window.partitionBy("__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__range", at).withColumn("__amount", amount).withColumn("__local", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    totals = df.select(at.alias("__of"), amount.alias("__amount")).groupBy("__of").agg(F.sum("__amount").alias("__total"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__total").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = local.join(before, F.col("__range") == F.col("__of"), "left")
    return out.select(*cols, (F.col("__local") + F.col("__before")).alias(name))


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """df, of different keys, with prev_key and next_key in key order."""
    at, inside = Ranges(df, key).of(key), Window.partitionBy("__range").orderBy(key)
    local = df.withColumn("__range", at).withColumn("__prev", F.lag(key).over(inside)).withColumn("__next", F.lead(key).over(inside))
    ends = df.groupBy(at.alias("__of")).agg(F.min(key).alias("__least"), F.max(key).alias("__most"))
    over = Window.orderBy("__of")
    ends = ends.select("__of", F.lag("__most").over(over).alias("__before"), F.lead("__least").over(over).alias("__after"))
    out = local.join(ends, F.col("__range") == F.col("__of"), "left")
    return out.select(*df.columns, F.coalesce("__prev", "__before").alias("prev_key"), F.coalesce("__next", "__after").alias("next_key"))


def last_before(df: DataFrame, by: list[Column | str], value: Column, name: str, groups: tuple[str, ...] = (), forward: bool = False) -> DataFrame:
    """df with `name`: the last value that is not null among the rows up to this one in the order, or the first from it on if forward."""
    cols = df.columns
    both = df.withColumn("__range", Ranges(df, *by).of(*by)).withColumn("__value", value)
    inside, over = Window.partitionBy(*groups, "__range").orderBy(*by), Window.partitionBy(*(f"__of_{g}" for g in groups)).orderBy("__of")
    end = (F.min_by if forward else F.max_by)("__value", F.when(F.col("__value").isNotNull(), _place(by)))
    ends = both.groupBy(*(F.col(g).alias(f"__of_{g}") for g in groups), F.col("__range").alias("__of")).agg(end.alias("__end"))
    if forward:
        near = F.first("__value", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
        far = F.first("__end", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    else:
        near = F.last("__value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        far = F.last("__end", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("__far", far).drop("__end")
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in groups), F.col("__range") == F.col("__of"))
    return both.withColumn("__near", near).join(ends, same, "left").select(*cols, F.coalesce("__near", "__far").alias(name))


def held(points: DataFrame, spans: DataFrame, at: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of a point and a span (smallest, largest) of its groups that holds it, as the structs `point` and `span`.

    In ranges of the points' order, where they meet by sorting, a span holds the points between two places. These go by
    blocks of BLOCK points, and each span is sent to the blocks that it holds points of. So no pair is made that is not returned,
    and the pairs of a block are as many as the spans, BLOCK times, at most. The blocks are dealt to all shuffle
    partitions by number, which Spark doesn't merge: their bytes are few, the pairs may be many.
    """
    ranges, spans = Ranges(points, at), spans.where("smallest <= largest")
    point, span = (F.struct(*(F.col(c) for c in df.columns)) for df in (points, spans))
    ends = F.array(*(F.struct(F.col(c).alias("key"), F.lit(turn).alias("turn")) for c, turn in (("smallest", 0), ("largest", 2))))
    spanned = spans.withColumn("__range", F.explode(F.sequence(ranges.of("smallest"), ranges.of("largest")))).withColumn("__end", F.explode(ends))
    side = lambda df, key, turn, p, s: df.select(*groups, "__range", key.alias("__key"), turn.alias("__turn"), p.alias("point"), s.alias("span"))
    no_point, no_span = (F.lit(None).cast(df.select(x.alias("x")).schema["x"].dataType) for df, x in ((points, point), (spans, span)))
    both = side(points.withColumn("__range", ranges.of(at)), F.col(at), F.lit(1), point, no_span)
    both = both.unionByName(side(spanned, F.col("__end.key"), F.col("__end.turn"), no_point, span))
    before = Window.partitionBy(*groups, "__range").orderBy("__key", "__turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("__place", F.coalesce(F.sum(F.when(F.col("__turn") == 1, 1).otherwise(0)).over(before), F.lit(0)))

    block, of_span = lambda place: F.floor(place / BLOCK).cast("long"), F.col("span").isNotNull()
    met = placed.groupBy(*groups, "__range", "span", F.when(F.col("__turn") == 1, block(F.col("__place"))).alias("__block"))
    here = F.sort_array(F.collect_list(F.when(F.col("__turn") == 1, F.struct("__place", "point")))).alias("__points")
    met = met.agg(here, F.min("__place").alias("__from"), F.max("__place").alias("__to"), (F.count("*") / 2).cast("long").alias("__copies")).where(~of_span | (F.col("__from") < F.col("__to")))
    first, last = block(F.col("__from")), block(F.col("__to") - 1)
    sent = F.sequence(F.lit(0).cast("long"), F.when(of_span, (last - first + 1) * F.col("__copies") - 1).otherwise(0))
    met = met.withColumn("__nth", F.explode(sent)).withColumn("__block", F.when(of_span, first + F.col("__nth") % (last - first + 1)).otherwise(F.col("__block")))
    met = met.drop("__nth", "__copies").repartition(ranges.parts, *groups, "__range", "__block")
    begun = Window.partitionBy(*groups, "__range", "__block").orderBy(of_span).rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("__points", F.first("__points").over(begun)).where(of_span)  # a block's points come before its spans
    skip = F.greatest(F.col("__from") - F.col("__block") * BLOCK, F.lit(0))
    these = F.slice("__points", (skip + 1).cast("int"), (F.least(F.col("__to") - F.col("__block") * BLOCK, F.lit(BLOCK)) - skip).cast("int"))
    return met.select("span", F.explode(these).alias("__point")).select("__point.point", "span")
