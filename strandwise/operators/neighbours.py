"""The nearest rows by position, however far away, and the number of overlaps of spans, without pairs of rows.

A key is cut into cells of `2**20` positions, as in `carry`. Windows run inside a
cell; what lies outside of it comes from one row a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.carry import CELL_BITS, running


def _last(xs: Column, k: int) -> Column:
    return F.when(F.size(xs) > k, F.slice(xs, F.size(xs) - k + 1, k)).otherwise(xs)


def k_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, id: str, k: int, out: str = "near") -> DataFrame:
    """`left` with `out`: the `k` rows of the right side of the same `keys` that are nearest by `at`, as an array of (d, id, at) in the order of distance and id.

    There is no bound on the distance. Both sides have `keys` and `at`, a long;
    `id` identifies a right row among those of its keys. Rows with a null key or
    position take no part: left ones get an empty array, as do those without
    any right row. A position holds at most its `k` least ids, so a pile of
    rows stays small.
    """
    known = F.col(at).isNotNull()
    for key in keys:
        known &= F.col(key).isNotNull()
    spot = [*keys, "__at"]
    rows = right.where(known).select(*keys, F.col(at).cast("long").alias("__at"), F.col(id).alias("__id"))
    few = rows.withColumn("__no", F.row_number().over(Window.partitionBy(*spot).orderBy("__id"))).where(f"__no <= {k}")
    stops = few.groupBy(*spot).agg(F.struct(F.col("__at").alias("at"), F.sort_array(F.collect_list("__id")).alias("ids")).alias("__x")).withColumn("__cell", F.shiftright("__at", CELL_BITS))
    here = Window.partitionBy(*keys, "__cell").orderBy("__at")
    lists = stops.select(*spot, "__cell", F.collect_list("__x").over(here.rowsBetween(1 - k, 0)).alias("__prev"), F.collect_list("__x").over(here.rowsBetween(0, k - 1)).alias("__next"))

    cells = lists.groupBy(*keys, "__cell").agg(F.max_by("__prev", "__at").alias("p"), F.min_by("__next", "__at").alias("n"))
    along = Window.partitionBy(*keys).orderBy("__cell")
    cells = cells.withColumns({"p": _last(F.concat(F.flatten(F.collect_list("p").over(along.rowsBetween(-k, -1))), "p"), k), "n": F.slice(F.concat("n", F.flatten(F.collect_list("n").over(along.rowsBetween(1, k)))), 1, k)})

    asked = left.where(known).select(*keys, F.col(at).cast("long").alias("__at")).distinct().withColumn("__cell", F.shiftright("__at", CELL_BITS))
    marks = asked.select("*", F.lit(None).cast(lists.schema["__prev"].dataType).alias("__prev"), F.lit(None).cast(lists.schema["__next"].dataType).alias("__next"), F.lit(True).alias("__asked")).unionByName(lists.withColumn("__asked", F.lit(False)))
    marks = marks.groupBy(*spot, "__cell").agg(F.first("__prev", True).alias("__prev"), F.first("__next", True).alias("__next"), F.bool_or("__asked").alias("__asked"))
    own = marks.withColumns({"__prev": F.last("__prev", True).over(here.rowsBetween(Window.unboundedPreceding, 0)), "__next": F.first("__next", True).over(here.rowsBetween(1, Window.unboundedFollowing))}).where("__asked")
    every = asked.select(*keys, "__cell").distinct().join(cells.withColumn("__stop", F.lit(True)), [*keys, "__cell"], "full")
    far = every.select(*keys, "__cell", F.last("p", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("n", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))

    none = F.array().cast(lists.schema["__prev"].dataType)
    full = lambda c: F.coalesce(F.col(c), none)
    both = F.concat(_last(F.concat(full("__before"), full("__prev")), k), F.slice(F.concat(full("__next"), full("__after")), 1, k))
    pairs = F.flatten(F.transform(both, lambda x: F.transform(x.ids, lambda i: F.struct(F.abs(x.at - F.col("__at")).alias("d"), i.alias("id"), x.at.alias("at")))))
    found = own.join(far, [*keys, "__cell"]).select(*spot, F.slice(F.array_sort(pairs), 1, k).alias(out)).withColumnsRenamed({x: f"__k_{x}" for x in keys})
    same = F.col(at).cast("long") == F.col("__at")
    for key in keys:
        same &= F.col(key) == F.col(f"__k_{key}")
    empty = F.array().cast(found.schema[out].dataType)
    return left.join(found, same, "left").select(*[left[c] for c in left.columns], F.coalesce(out, empty).alias(out))


def overlap_counts(spans: DataFrame, intervals: DataFrame, keys: Sequence[str], span: tuple[str, str], interval: tuple[str, str], out: str = "n") -> DataFrame:
    """`spans` with `out`: how many closed intervals of the same `keys` share a position with each, without making the pairs.

    Those that begin up to the end of the span, less those that end before its
    start. Both sides have `keys`; inverted intervals and null bounds count for
    nothing, inverted or unknown spans and null keys get 0. Repeated intervals
    count each time.
    """
    ends = intervals.where(F.col(interval[0]) <= F.col(interval[1])).select(*keys, F.explode(F.array(*[F.struct(F.col(c).cast("long").alias("at"), F.lit(s).alias("s"), F.lit(e).alias("e")) for c, s, e in ((interval[0], 1, 0), (interval[1], 0, 1))])).alias("x")).select(*keys, "x.*")
    good = spans.where(F.col(span[0]) <= F.col(span[1]))
    asked = good.select(*keys, F.explode(F.array(F.col(span[0]).cast("long"), F.col(span[1]).cast("long"))).alias("at"), F.lit(0).alias("s"), F.lit(0).alias("e"))
    steps = ends.unionByName(asked).groupBy(*keys, "at").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    begun = running(steps, keys, "at", "s", "begun", "sum").select(*keys, "at", "begun")
    ended = running(steps, keys, "at", "e", "ended", "sum", inclusive=False).select(*keys, "at", "ended")

    def looked_up(df: DataFrame, values: DataFrame, at: str) -> DataFrame:
        names = {x: f"__k_{x}" for x in keys}
        same = F.col(at).cast("long") == F.col("__at")
        for key in keys:
            same &= F.col(key) == F.col(names[key])
        return df.join(values.withColumnsRenamed({**names, "at": "__at"}), same, "left").drop("__at", *names.values())

    met = looked_up(looked_up(spans, begun, span[1]), ended, span[0])
    n = F.when(F.col(span[0]) <= F.col(span[1]), F.coalesce("begun", F.lit(0)) - F.coalesce("ended", F.lit(0))).otherwise(0)
    return met.withColumn(out, F.coalesce(n, F.lit(0))).drop("begun", "ended")
