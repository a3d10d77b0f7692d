"""Interval joins: overlap, point, existence, nearest, reciprocal overlap.

Every join has an equi key. Inside a key an interval goes to the one or two
bins of its level, where a level's bins are at least as long as the interval;
pairs meet at the level of the longer one. The shorter one is copied only to the
levels at which its key has longer ones: which levels are in use is told by a
bit mask for each of at most 65,536 buckets of keys, a table of proven size that
is broadcast. So no interval is copied into many bins, a key without long
intervals is spread over small bins, and no pair is compared outside a bin. Where
a key has intervals as long as a large bin, they meet all that lies in it; the
adaptive skew join divides such a bin.
A pair is kept in the bin of the later of the two starts only, so it comes once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bins of each level.
LEVELS = (10, 14, 18, 22, 26, 30, 40, 62)


#: Buckets of keys for which the levels in use are told apart.
KEY_BUCKETS = 1 << 16


def _levelled(df: DataFrame, side: str, keys: Sequence[Column]) -> DataFrame:
    """`df`, which has its bounds as __<side>s and __<side>e, with its own level and the bucket of its keys; rows with a null key go."""
    own = F.lit(len(LEVELS) - 1)
    for i in reversed(range(len(LEVELS) - 1)):
        own = F.when(F.col(f"__{side}e") - F.col(f"__{side}s") < (1 << LEVELS[i]), i).otherwise(own)
    for key in keys:
        df = df.where(key.isNotNull())
    return df.withColumns({f"__{side}l": own, "__bucket": F.pmod(F.xxhash64(*keys) if keys else F.lit(0), F.lit(KEY_BUCKETS)).cast("int")})


def _in_use(df: DataFrame, side: str) -> DataFrame:
    """The levels of a side as a bit mask, by bucket of keys."""
    return F.broadcast(df.groupBy("__bucket").agg(F.bit_or(F.expr(f"shiftleft(1, __{side}l)")).alias("__mask")))


def _placed(df: DataFrame, side: str, levels: Column) -> DataFrame:
    """`df` with its bins at each of the levels."""
    df = df.select("*", F.explode(levels).alias(f"__{side}t"))
    df = df.withColumn("__bits", F.element_at(F.array(*[F.lit(b) for b in LEVELS]), F.col(f"__{side}t") + 1))
    df = df.withColumns({"__a": F.expr(f"shiftright(__{side}s, __bits)"), "__b": F.expr(f"shiftright(__{side}e, __bits)")})
    return df.withColumn(f"__{side}b", F.explode(F.expr("if(__a = __b, array(__a), array(__a, __b))"))).withColumnRenamed("__bits", f"__{side}bits").drop("__a", "__b", "__bucket", "__mask")


def _copied_up(df: DataFrame, side: str, other: DataFrame, other_side: str, least: str) -> DataFrame:
    """`df` at those levels from `least` on at which the other side has intervals of its keys."""
    levels = F.expr(f"filter(sequence(0, {len(LEVELS) - 1}), x -> x >= {least} and shiftright(__mask, x) & 1 = 1)")
    return _placed(df.join(_in_use(other, other_side), "__bucket"), side, levels)


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str], closed: bool = True) -> DataFrame:
    """Inner join of closed intervals that share a position: all columns of both sides, whose names must differ.

    With `closed=False` the right interval is open at its end. Null bounds,
    inverted intervals and null keys match nothing. Bounds are longs.
    """
    kind = lambda x: left.schema[x].dataType
    a = left.withColumns({"__ls": F.col(left_span[0]).cast("long"), "__le": F.col(left_span[1]).cast("long")}).where("__ls <= __le")
    b = right.withColumns({"__rs": F.col(right_span[0]).cast("long"), "__re": F.col(right_span[1]).cast("long") - (0 if closed else 1)}).where("__rs <= __re")
    a = _levelled(a, "l", [F.col(x) for x, _ in on])
    b = _levelled(b, "r", [F.col(y).cast(kind(x)) for x, y in on])
    same = (F.col("__lt") == F.col("__rt")) & (F.col("__lb") == F.col("__rb"))
    for x, y in on:
        same &= F.col(x) == F.col(y)
    once = F.expr("shiftright(greatest(__ls, __rs), __lbits)") == F.col("__lb")
    meet = (F.col("__ls") <= F.col("__re")) & (F.col("__rs") <= F.col("__le")) & once
    keep = [F.col(f"`{c}`") for c in (*left.columns, *right.columns)]
    # The longer one of a pair stands at its own level, so only intervals that are about as long as a bin make it full.
    longer_left = _placed(a, "l", F.array("__ll")).join(_copied_up(b, "r", a, "l", "__rl"), same & meet).select(*keep)
    longer_right = _copied_up(a, "l", b, "r", "__ll + 1").join(_placed(b, "r", F.array("__rl")), same & meet).select(*keep)
    return longer_left.unionByName(longer_right)


def point_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], point: str, right_span: tuple[str, str]) -> DataFrame:
    """Points of the left side in right-open intervals of the right side."""
    return overlap_join(left, right, on, (point, point), right_span, closed=False)


def exists_overlap(left: DataFrame, right: DataFrame, id: str, on: Sequence[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str], flag: str = "hit", where: Column | None = None) -> DataFrame:
    """`left` with a boolean `flag`: whether any interval of the right side overlaps (and `where` holds). `id` identifies left rows."""
    pairs = overlap_join(left, right, on, left_span, right_span)
    if where is not None:
        pairs = pairs.where(where)
    hits = pairs.select(F.col(id).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    return left.join(hits, F.col(id) == F.col("__id"), "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__id", "__hit")


def first_overlap(left: DataFrame, right: DataFrame, id: str, on: Sequence[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str], order: Sequence[Column], take: dict[str, Column]) -> DataFrame:
    """`left` with the columns `take` of the first overlapping interval in `order`, null if there is none."""
    pairs = overlap_join(left, right, on, left_span, right_span)
    best = pairs.groupBy(F.col(id).alias("__id")).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(n) for n, c in take.items()])).alias("__best"))
    return left.join(best, F.col(id) == F.col("__id"), "left").select(*[left[c] for c in left.columns], *[F.col(f"__best.{n}").alias(n) for n in take])


def nearest(left: DataFrame, right: DataFrame, id: str, on: Sequence[tuple[str, str]], left_at: str, right_at: str, within: int, distance: Column, order: Sequence[Column], take: dict[str, Column]) -> DataFrame:
    """`left` with the columns `take` of the nearest right row within so many positions; of equal distances the first in `order`; null if there is none."""
    wide = left.withColumns({"__from": F.col(left_at) - within, "__to": F.col(left_at) + within})
    pairs = overlap_join(wide, right, on, ("__from", "__to"), (right_at, right_at))
    best = pairs.groupBy(F.col(id).alias("__id")).agg(F.min(F.struct(distance.alias("d"), *[c.alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(n) for n, c in take.items()])).alias("__best"))
    return left.join(best, F.col(id) == F.col("__id"), "left").select(*[left[c] for c in left.columns], *[F.col(f"__best.{n}").alias(n) for n in take])


def fold_overlap(a: tuple[Column, Column], b: tuple[Column, Column], unset: Sequence[int] = (0, -1)) -> tuple[Column, Column]:
    """Intersection of a range with an accumulator that is (0, 0) or (-1, -1) while nothing constrains it; (0, 0) if they are disjoint."""
    free = F.lit(False)
    for x in unset:
        free |= (b[0] == x) & (b[1] == x)
    low, high = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    keep = lambda own, both: F.when(free, own).when(low > high, 0).otherwise(both)
    return keep(a[0], low), keep(a[1], high)


def covered(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether two closed ranges share a position, whichever way round their ends stand."""
    return (F.least(a1, a2) <= F.greatest(b1, b2)) & (F.least(b1, b2) <= F.greatest(a1, a2))
