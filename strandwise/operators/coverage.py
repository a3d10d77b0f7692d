"""Coverage by a sweep over starts and ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators.carry import running


def coverage(df: DataFrame, keys: Sequence[str], start: str, length: str) -> DataFrame:
    """Positions at which the coverage of a key changes: `keys`, `pos`, `depth` from there on.

    A record covers `length` positions from `start`; records with a null or with
    no length do not count. Deltas are added up before they are shuffled, so a
    position has one row however many records begin there.
    """
    spans = df.where(F.col(start).isNotNull() & (F.col(length) > 0)).select(*keys, F.col(start).cast("long").alias("s"), F.col(length).cast("long").alias("n"))
    deltas = spans.select(*keys, F.explode(F.expr("array(struct(s as pos, 1L as d), struct(s + n as pos, -1L as d))")).alias("x")).select(*keys, "x.pos", "x.d")
    steps = deltas.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    return running(steps, keys, "pos", "d", "depth", "sum").select(*keys, "pos", "depth")
