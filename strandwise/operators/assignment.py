"""Greedy assignment of paired positions to the newest open cluster that fits, along a chromosome."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.operators.gap_clusters import gap_clusters


class Assigner:
    """The open clusters of one chromosome, fed in order of start.

    A cluster has rows of one kind (mate chromosome and strands), and clusters
    stand in the order of their first starts. So a row is compared with the open
    clusters of its own kind only, and where the search ends is looked up.
    """

    def __init__(self, k: float, reach: float) -> None:
        self.k, self.reach = k, reach
        self.clusters: deque[tuple[int, tuple, list[tuple]]] = deque()
        self.firsts: list[int] = []  # of all clusters that were made
        self.by_kind: dict[tuple, deque[tuple[int, tuple, list[tuple]]]] = {}

    def add(self, row: tuple) -> int:
        """Cluster of a row (name, start, mate chromosome, strand, mate start, mate strand, size, upper, median, sd); -1 for an exact repetition.

        Clusters are asked from the newest to the oldest, their members in order
        of arrival. A member settles it: an exact repetition drops the row; equal
        mate chromosome and strands, both starts within the larger upper bound of
        the two, and (equal strands, or sizes that differ from the difference of
        the medians by at most k joint deviations) puts the row into the cluster;
        a member further away than `reach` ends the search.
        """
        start, kind = row[1], (row[2], row[3], row[5])
        # The newest cluster whose first member is out of reach ends the search; it may still take a row of its own kind.
        end = bisect_left(self.firsts, start - self.reach) - 1
        target = None
        for own in reversed(self.by_kind.get(kind, ())):
            if own[0] < end:
                break
            settled, found = self._asked(own[2], row)
            if settled:
                if not found:
                    return -1
                target = own
                break
        if target is None:
            target = (len(self.firsts), kind, [])
            self.firsts.append(start)
            self.clusters.append(target)
            self.by_kind.setdefault(kind, deque()).append(target)
        target[2].append(row)
        while start - self.clusters[0][2][-1][1] > self.reach:
            gone = self.clusters.popleft()  # nothing that comes later can reach it
            self.by_kind[gone[1]].popleft()
        return target[0]

    def _asked(self, members: list[tuple], row: tuple) -> tuple[bool, bool]:
        """Whether a member settles where the row goes, and if so, whether it is into this cluster."""
        name, start, _, strand, mstart, mstrand, size, upper, median, sd = row
        for o in members:
            if o[0] == name and o[1] == start and o[4] == mstart:
                return True, False
            far = max(o[7], upper)
            if abs(start - o[1]) <= far and abs(mstart - o[4]) <= far and (strand == mstrand or abs((size - o[6]) - (median - o[8])) <= self.k * (sd**2 + o[9] ** 2) ** 0.5):
                return True, True
            if start - o[1] > self.reach:
                break
        return False, False


def assign_clusters(df: DataFrame, stats: DataFrame, k: float, reach: float) -> DataFrame:
    """Clusters of pairs: chrom, `run`, cluster (from 0 in a run), id; -1 are exact repetitions.

    `df` has id, name, chrom, pos, strand, mate_chrom, mate_pos, mate_strand,
    isize, rg; `stats` has rg, median, sd, upper. The search never goes further
    than `reach`, so a chromosome is cut where `reach` positions have no row,
    and only the open clusters of a run are held. Rows without a position or
    statistics take no part; equal positions come in the order of the id.
    """
    rows = df.where("chrom is not null and pos is not null and mate_chrom is not null and mate_pos is not null").join(stats, "rg")
    rows = gap_clusters(rows, ["chrom"], "pos", int(reach))
    schema = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("run", T.LongType()), T.StructField("cluster", T.LongType()), T.StructField("id", T.LongType())])
    names = ["name", "pos", "mate_chrom", "strand", "mate_pos", "mate_strand", "isize", "upper", "median", "sd"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, open_ = None, None
        for batch in batches:
            got = []
            for key, row in zip(zip(batch["chrom"], batch["cluster_start"], strict=True), zip(*[batch[c].tolist() for c in names], strict=True), strict=True):
                if key != at:
                    at, open_ = key, Assigner(k, reach)
                got.append(open_.add(row))
            yield pd.DataFrame({"chrom": batch["chrom"], "run": batch["cluster_start"], "cluster": got, "id": batch["id"]})

    wanted = rows.select("chrom", "cluster_start", "id", "name", "pos", "strand", "mate_chrom", "mate_pos", "mate_strand", F.coalesce("isize", F.lit(0)).alias("isize"), "upper", "median", F.coalesce("sd", F.lit(0.0)).alias("sd"))
    return wanted.repartition("chrom", "cluster_start").sortWithinPartitions("chrom", "cluster_start", "pos", "id").mapInPandas(scan, schema)


def fold_range(acc: tuple[int, int], x: tuple[int, int]) -> tuple[int, int]:
    """The intersection of both; `x` where nothing constrains it yet, (0, 0) where they are disjoint, which begins anew."""
    if acc in ((0, 0), (-1, -1)):
        return x
    low, high = max(acc[0], x[0]), min(acc[1], x[1])
    return (low, high) if low <= high else (0, 0)


def fold_ranges(df: DataFrame, key: str, order: Sequence[str], ranges: Sequence[tuple[str, str]]) -> DataFrame:
    """`key`, the folds of each of the `ranges` in `order`, and `n`, how many rows went in.

    The fold depends on the order, so the rows of a key are read one after the
    other, of which no more than the folds are held. Rows with a null bound do
    not count; a null key is a key.
    """
    bounds = [c for r in ranges for c in r]
    schema = T.StructType([df.schema[key], *[T.StructField(c, T.LongType()) for c in bounds], T.StructField("n", T.LongType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, folds, n, started = None, [], 0, False

        def row() -> tuple:
            return (at, *[v for f in folds for v in f], n)

        for batch in batches:
            out = []
            names = batch[key].astype(object).where(batch[key].notna(), None).tolist()
            for name, *values in zip(names, *[batch[c].tolist() for c in bounds], strict=True):
                if not started or name != at:
                    if started:
                        out.append(row())
                    at, folds, n, started = name, [(0, 0)] * len(ranges), 0, True
                folds = [fold_range(f, (values[2 * i], values[2 * i + 1])) for i, f in enumerate(folds)]
                n += 1
            if out:
                yield pd.DataFrame(out, columns=schema.names)
        if started:
            yield pd.DataFrame([row()], columns=schema.names)

    whole = df.dropna(subset=bounds)
    return whole.repartition(key).sortWithinPartitions(key, *order).mapInPandas(scan, schema)
