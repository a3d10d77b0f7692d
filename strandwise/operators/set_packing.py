"""Greedy choice among clusters that share reads: the heaviest cluster takes its reads from all others, again and again.

One choice after the other would be one task. But a cluster that is better than
every cluster it shares a read with is chosen before any of these, and its
weight can't change until then, since only their choice takes reads from it. So
each round chooses all such clusters at once, which gives just the clusters of
the sequential choice. A round is a few hash joins on reads and clusters; the
best of a read is an aggregate, so a read in many clusters makes no pairs.
A long chain of clusters, each better than the next, would need a round a
cluster. So after every `ROUNDS` rounds, what is left is cut into its connected
components, and those of at most `LOCAL_ROWS` members are chosen from one after
the other, each in a task; larger ones go on in rounds. There is no last round.

`components` links clusters by shared reads, by label propagation: every cluster
takes the least label it sees through its reads, then that label's own label.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.runtime import checkpointed

ROUNDS = 6
LOCAL_ROWS = 100_000


class _Falling(str):
    """A text that sorts the other way round."""

    __slots__ = ()

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)


def choose_in_order(group: pd.DataFrame) -> pd.DataFrame:
    """The sequential choice in one component: c, r, w, same, tie -> leader, c, n, weight, first, tie."""
    held: dict[int, dict[str, float]] = {}
    of_read: dict[str, set[int]] = {}
    fixed = {}
    for c, r, w, same, tie in zip(group["c"].tolist(), group["r"], group["w"].tolist(), group["same"].tolist(), group["tie"].tolist(), strict=True):
        held.setdefault(c, {})[r] = w
        of_read.setdefault(r, set()).add(c)
        fixed[c] = same, tie

    def key(c: int) -> tuple:
        return -round(sum(held[c].values()), 10), not fixed[c][0], _Falling(min(held[c])), c

    heap = [key(c) for c in held]
    heapq.heapify(heap)
    out = []
    while heap:
        entry = heapq.heappop(heap)
        leader = entry[3]
        if not held[leader] or entry != key(leader):
            continue
        reads = dict(held[leader])
        first, touched = min(reads), set()
        for r in reads:
            touched |= of_read[r]
        out += [(leader, c, len(reads), -entry[0], first, fixed[c][1]) for c in touched if held[c].keys() == reads.keys() and key(c)[:2] == entry[:2]]
        for r in reads:
            for c in of_read[r]:
                del held[c][r]
        for c in touched:
            if held[c]:
                heapq.heappush(heap, key(c))
    return pd.DataFrame(out, columns=["leader", "c", "n", "weight", "first", "tie"])


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """`left`, `component`: the least left id that is reachable through shared right ids. Null ends link nothing."""
    edges = checkpointed(links.where(F.col(left).isNotNull()).select(F.col(left).alias("l"), F.col(right).alias("r")).distinct())
    labels = checkpointed(edges.select("l").distinct().withColumn("c", F.col("l")))
    while True:  # labels only fall, and pointer jumping halves what is left of a chain
        by_right = edges.where("r is not null").join(labels, "l").groupBy("r").agg(F.min("c").alias("c"))
        seen = edges.join(by_right, "r").groupBy("l").agg(F.min("c").alias("n"))
        stepped = labels.join(seen, "l", "left").select("l", "c", F.least("c", F.coalesce("n", "c")).alias("n"))
        # Pointer jumping: the label's own new label.
        jump = stepped.select(F.col("l").alias("p"), F.col("n").alias("q"))
        after = checkpointed(stepped.join(jump, F.col("n") == F.col("p"), "left").select("l", "c", F.least("n", F.coalesce("q", "n")).alias("n")))
        moved = not after.where("n <> c").isEmpty()
        labels = after.select("l", F.col("n").alias("c"))
        if not moved:
            return labels.select(F.col("l").alias(left), F.col("c").alias("component"))


def pack_sets(members: DataFrame, cluster: str, read: str, weight: str, chrom: str, mate_chrom: str, size: str, mismatches: str) -> DataFrame:
    """Chosen clusters: `leader`, `rank` (0, 1, ... among the equal clusters that go together), `cluster`, `n_reads`, `weight`, `first_read`.

    The order of choice is that of weight (largest first), one chromosome before
    two, larger first read name, smaller id. A cluster that no longer has a read
    of its own is not chosen. Equal clusters have just the same reads left and
    the same weight; they are ordered by mean size on one chromosome, else by
    mismatches, then by id. A member without a read name takes part in nothing;
    of repeated members the heaviest counts.
    """
    rows = members.where(F.col(cluster).isNotNull() & F.col(read).isNotNull())
    rows = rows.groupBy(F.col(cluster).alias("c"), F.col(read).alias("r")).agg(F.max(F.coalesce(weight, F.lit(0.0))).alias("w"), F.bool_and(F.coalesce(F.col(chrom) == F.col(mate_chrom), F.lit(False))).alias("same"), F.avg(F.abs(size)).alias("size"), F.sum(F.coalesce(mismatches, F.lit(0))).alias("mm"))
    rows = checkpointed(rows)
    fixed = rows.groupBy("c").agg(F.bool_and("same").alias("same"), F.avg("size").alias("size"), F.sum("mm").alias("mm"))
    fixed = checkpointed(fixed.select("c", "same", F.when(F.col("same"), F.coalesce("size", F.lit(0.0))).otherwise(F.col("mm").cast("double")).alias("tie")))
    left, chosen = rows.select("c", "r", "w"), []
    turn = 0
    while not left.isEmpty():
        turn += 1
        if turn % ROUNDS == 0:
            of = components(left, "c", "r").withColumnRenamed("c", "of_c")
            labelled = checkpointed(left.join(of, F.col("c") == F.col("of_c")).drop("of_c"))
            small = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(f"n <= {LOCAL_ROWS}").select("component")
            local = labelled.join(small, "component", "left_semi").join(fixed, "c")
            kinds = {f.name: f.dataType.simpleString() for f in left.schema}
            solved = local.groupBy("component").applyInPandas(lambda g: choose_in_order(g), f"leader {kinds['c']}, c {kinds['c']}, n long, weight double, first {kinds['r']}, tie double")
            chosen.append(checkpointed(solved))
            left = checkpointed(labelled.join(small, "component", "left_anti").select("c", "r", "w"))
            continue
        heads = left.groupBy("c").agg(F.round(F.sum("w"), 10).alias("weight"), F.min("r").alias("first"), F.count(F.lit(1)).alias("n")).join(fixed, "c")
        heads = checkpointed(heads.withColumn("key", F.struct("weight", "same", "first", (-F.col("c")).alias("no"))))
        keyed = left.join(heads.select("c", "key"), "c")
        best = keyed.groupBy("r").agg(F.max("key").alias("top"))
        # The best of all clusters that it shares a read with: nothing can change its weight before its turn.
        winners = keyed.join(best, "r").groupBy("c").agg(F.bool_and(F.col("key") == F.col("top")).alias("wins")).where("wins").select(F.col("c").alias("leader"))
        taken = checkpointed(left.join(winners, F.col("c") == F.col("leader")).select("leader", "r"))
        shared = left.join(taken, "r").groupBy("leader", "c").agg(F.count(F.lit(1)).alias("shared"))
        lead = heads.select(F.col("c").alias("leader"), F.col("n").alias("ln"), F.col("weight").alias("lw"), F.col("same").alias("ls"))
        equal = shared.join(heads, "c").join(lead, "leader").where("shared = n and n = ln and weight = lw and same = ls")
        chosen.append(checkpointed(equal.select("leader", "c", "n", "weight", "first", "tie")))
        left = checkpointed(left.join(taken.select("r"), "r", "left_anti").select("c", "r", "w"))
    every = None
    for part in chosen:
        every = part if every is None else every.unionByName(part)
    if every is None:
        every = rows.select(F.col("c").alias("leader"), "c", F.lit(0).cast("long").alias("n"), F.col("w").alias("weight"), F.col("r").alias("first"), F.lit(0.0).alias("tie"))
    rank = F.row_number().over(Window.partitionBy("leader").orderBy("tie", "c")) - 1
    return every.select("leader", rank.alias("rank"), F.col("c").alias("cluster"), F.col("n").alias("n_reads"), "weight", F.col("first").alias("first_read"))
