"""Per-key results of keys that hold most rows: counts, distinct items and exact quantiles.

Nothing here gathers the rows of a key. Counts and sums are pre-aggregated on
the map side; distinct items are counted over (key, item), which a hot key
spreads over all tasks; quantiles are *selected*:

* a histogram of each key is counted over the high bits of the values, which is
  mergeable, so a hot key contributes one row a bucket and map task;
* the bucket that holds each wanted rank is found from the running counts, over
  at most `2**step_bits` buckets of a key;
* the next round counts only the rows of those buckets, by the next bits, until
  a bucket is one value and the rank is resolved.

The number of rounds follows from the width of the values, not of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.carry import null_safe_join
from strandwise.runtime import checkpointed, small_side

STEP_BITS = 12


def _shifts(low: int | None, high: int | None, step: int) -> list[int]:
    """How many low bits each round leaves open, from the widest value."""
    bits = max(abs(low or 0), abs(high or 0)).bit_length() + 1
    shifts, left = [], max(0, bits - step)
    while True:
        shifts.append(left)
        if left == 0:
            return shifts
        left = max(0, left - step)


def _located(hist: DataFrame, wanted: DataFrame, k: list[str]) -> DataFrame:
    """k.., q, bucket and the rank inside the bucket, of each wanted rank (k.., q, rank)."""
    window = Window.partitionBy(*k).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("upto", F.sum("n").over(window))
    return null_safe_join(run, wanted, k).where("rank <= upto and rank > upto - n").select(*k, "q", "bucket", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))


def selected_quantiles(base: DataFrame, k: list[str], percents: Sequence[int], step_bits: int = STEP_BITS, bounds: tuple[int | None, int | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """`base` has `k` and a long `value`; `bounds`, the least and largest value, are looked up if they are not given. Returns the first histogram (k.., bucket, n, nulls in bucket null), and k.., q, value."""
    low, high = bounds or base.agg(F.min("value"), F.max("value")).first()
    shifts = _shifts(low, high, step_bits)
    shifted = lambda bits: F.shiftright("value", bits)
    first = checkpointed(base.groupBy(*k, shifted(shifts[0]).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    hist = first.where("bucket is not null")
    totals = hist.groupBy(*k).agg(F.sum("n").alias("total"))
    wanted = totals.select(*k, "total", F.explode(F.array(*[F.lit(int(q)) for q in percents])).alias("q"))
    wanted = wanted.select(*k, "q", F.greatest(F.lit(1), F.expr("(total * q + 99) div 100")).alias("rank"))
    found = checkpointed(_located(hist, wanted, k))
    for before, bits in zip(shifts, shifts[1:], strict=False):
        cells = found.select(*k, F.col("bucket").alias("cell")).distinct()
        rows = base.where("value is not null").withColumn("cell", shifted(before))
        fine = null_safe_join(rows, small_side(cells), [*k, "cell"]).groupBy(*k, "cell", shifted(bits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        found = checkpointed(_located(fine, found.withColumnRenamed("bucket", "cell"), [*k, "cell"]).drop("cell"))
    return first, found.select(*k, "q", F.col("bucket").alias("value"))


def key_profile(df: DataFrame, keys: Sequence[str], value: Column, item: Column, percents: Sequence[int] = (50, 95), step_bits: int = STEP_BITS) -> DataFrame:
    """One row a key: `n_rows`, `n_items` (distinct, null is none), `n_values`, `sum_value`, `min_value`, `max_value`, `p<q>` for each percentile.

    The q-th percentile is the smallest value that at least q % of the key's
    values do not exceed. `value` must be a whole number; null is no value, and
    a key without values has null figures. Null keys are one key. Repeated rows
    count each time. An empty table gives no rows. Other columns are ignored.
    The sum is a decimal, so it can't overflow.
    """
    k = [f"k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(f"`{x}`").alias(y) for x, y in zip(keys, k, strict=True)], value.cast("long").alias("value"), item.alias("item"))
    # Sums and extremes come from the pass that gives the width of the values, counts from the first histogram.
    sums = checkpointed(base.groupBy(*k).agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("sum_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")))
    bounds = tuple(sums.agg(F.min("min_value"), F.max("max_value")).first())
    first, quantiles = selected_quantiles(base.drop("item"), k, percents, step_bits, bounds)
    counts = first.groupBy(*k).agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"))
    points = [f"p{q}" for q in percents]
    items = base.where("item is not null").select(*k, "item").distinct().groupBy(*k).agg(F.count(F.lit(1)).alias("n_items"))
    marks = quantiles.groupBy(*k).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{q}") for q in percents])
    parts = None
    for part in (counts, sums, items, marks):
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    merged = parts.groupBy(*k).agg(*[F.max(c).alias(c) for c in ("n_rows", "n_items", "n_values", "sum_value", "min_value", "max_value", *points)])
    return merged.select(*[F.col(x).alias(y) for x, y in zip(k, keys, strict=True)], "n_rows", F.coalesce("n_items", F.lit(0)).alias("n_items"), "n_values", "sum_value", "min_value", "max_value", *points)


def heavy_keys(profile: DataFrame, group: Sequence[str], share: float) -> DataFrame:
    """The rows of a profile whose `n_rows` are more than `share` of all rows of their `group` of keys, the null key's rows included.

    `share` is compared exactly, as a whole number of millionths.
    """
    totals = profile.groupBy(*group).agg(F.sum("n_rows").alias("all_rows"))
    return null_safe_join(profile, totals, list(group)).where(F.col("n_rows").cast("decimal(19,0)") * 1_000_000 > F.col("all_rows").cast("decimal(19,0)") * round(share * 1_000_000)).drop("all_rows")
