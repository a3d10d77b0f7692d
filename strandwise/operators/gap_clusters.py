"""Gap clustering: runs of positions of a key in which no step is larger than a gap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.operators.carry import null_safe_join, running


def cluster_starts(df: DataFrame, keys: Sequence[str], at: str, gap: int) -> DataFrame:
    """The distinct positions of each key with `cluster_start`, the first position of their cluster. A step of exactly `gap` stays inside."""
    spots = df.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias(at)).distinct()
    before = running(spots, keys, at, at, "__before", "max", inclusive=False)
    opened = before.withColumn("__open", F.when(F.col("__before").isNull() | (F.col(at) - F.col("__before") > gap), F.col(at)))
    return running(opened, keys, at, "__open", "cluster_start", "max").drop("__before", "__open")


def gap_clusters(df: DataFrame, keys: Sequence[str], at: str, gap: int) -> DataFrame:
    """`df`, rows without a position left out, with the `cluster_start` that identifies a row's cluster in its key."""
    starts = cluster_starts(df, keys, at, gap)
    return null_safe_join(df.where(F.col(at).isNotNull()), starts, [*keys, at])


def wildcard_clusters(df: DataFrame, keys: Sequence[str], family: str, at: str, id: str, gap: int, wildcard: str) -> DataFrame:
    """Gap clustering by (`keys`, `family`) in which rows of the `wildcard` family also join the open clusters of every other family.

    A wildcard row within `gap` of the last member of a family's open cluster
    becomes its next member; it clusters by itself too. Whether it joins depends
    on what joined before, so a key is scanned in order, holding one position a
    family; a key should be of bounded length, such as a cell of a contig. Ties in position are in the order
    of `id`. Out: `keys`, `family` (of the cluster), `cluster_no` (from 0), `id`, `at`.
    """
    named = df.where(F.col(at).isNotNull()).select(*keys, F.col(family).alias("__family"), F.col(at).cast("long").alias("__at"), F.col(id).alias("__id"))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(family, T.StringType()), T.StructField("cluster_no", T.LongType()), T.StructField(id, df.schema[id].dataType), T.StructField(at, T.LongType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here: tuple | None = None
        last: dict[str, int] = {}
        number: dict[str, int] = {}
        for batch in batches:
            rows = []
            columns = [batch[k].astype(object).where(batch[k].notna(), None).tolist() for k in keys]
            for key, name, position, row in zip(zip(*columns, strict=True), batch["__family"], batch["__at"], batch["__id"], strict=True):
                if key != here:
                    here, last, number = key, {}, {}
                joined = [f for f, p in last.items() if f != wildcard and position - p <= gap] if name == wildcard else []
                for family_ in (*joined, name):
                    if family_ not in last:
                        number[family_] = 0
                    elif position - last[family_] > gap:
                        number[family_] += 1
                    last[family_] = position
                    rows.append((*key, family_, number[family_], row, position))
            yield pd.DataFrame(rows, columns=schema.names)

    return named.repartition(*keys).sortWithinPartitions(*keys, "__at", "__id").mapInPandas(scan, schema)
