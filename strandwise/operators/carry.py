"""Running maxima and sums along a key, without one window over a whole key.

Rows are cut into cells of `2**20` positions. A window runs inside a cell; what
comes before the cell is carried over one row a cell, and again over one row a
block of cells. A key that holds a third of all rows is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 20


def null_safe_join(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls equal each other; keeps the left names once."""
    other = right.withColumnsRenamed({n: f"__r_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition &= F.col(n).eqNullSafe(F.col(f"__r_{n}"))
    return left.join(other, condition, how).drop(*[f"__r_{n}" for n in names])


def running(df: DataFrame, keys: Sequence[str], at: str, value: str, out: str, how: str = "max", inclusive: bool = True) -> DataFrame:
    """`df` with `out`: the maximum or sum of `value` over the rows of the same keys up to (or, exclusively, before) the row's `at`.

    (`keys`, `at`) must be unique and `at` a long. Null values do not count; no
    value before gives null. Null keys are one key.
    """
    fold = {"max": F.max, "sum": F.sum}[how]
    join = (lambda a, b: F.greatest(a, b)) if how == "max" else (lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))
    df = df.withColumns({"__c0": F.shiftright(at, CELL_BITS), "__c1": F.shiftright(at, 2 * CELL_BITS)})
    cells = df.groupBy(*keys, "__c1", "__c0").agg(fold(value).alias("__v"))
    blocks = cells.groupBy(*keys, "__c1").agg(fold("__v").alias("__v"))
    past = (Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "__c1", fold("__v").over(Window.partitionBy(*keys).orderBy("__c1").rowsBetween(*past)).alias("__b"))
    cells = cells.select(*keys, "__c1", "__c0", fold("__v").over(Window.partitionBy(*keys, "__c1").orderBy("__c0").rowsBetween(*past)).alias("__a"))
    carried = null_safe_join(cells, blocks, [*keys, "__c1"]).select(*keys, "__c0", join(F.col("__a"), F.col("__b")).alias("__carry"))
    here = Window.partitionBy(*keys, "__c0").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    df = df.withColumn("__local", fold(value).over(here))
    joined = null_safe_join(df, carried, [*keys, "__c0"])
    return joined.withColumn(out, join(F.col("__local"), F.col("__carry"))).drop("__c0", "__c1", "__local", "__carry")
