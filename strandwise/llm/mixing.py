"""Mixing sources to target weights by Sainte-Laguë apportionment.

The total is cut into blocks of equal size. Blocks go to sources by the highest
quotients share / 1, share / 3, share / 5, ..., and no source gets more than its
records hold when each is repeated as often as allowed. A source's blocks go to
its shards in the same way, by the size of the shards; a shard is a part of a
source, by a hash of the record, of bounded size. In each shard records stand
in an order drawn with a seed, are taken as often as its quota needs whole
passes, and the blocks of the last pass are filled from the front.

Only totals of target sources, which the table of targets bounds, reach the
driver; records move once, to their shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.runtime import checkpointed, small_side

BLOCK = 4_096
SHARD_SIZE = 1 << 24
SHARD_ROWS = 1 << 17
#: Shards, or groups of shards, that share out the blocks of one group among them.
FANOUT_BITS = 10


@dataclass
class Source:
    name: str
    share: float
    max_repeats: int
    available: int


def sainte_lague(weights: Sequence[Fraction], caps: Sequence[int], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 j + 1), at most caps[i] each; ties go to the earlier. No loop over seats."""
    got = [0] * len(weights)
    live = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    seats = min(seats, sum(caps[i] for i in live))
    # Fill up in proportion, rounded down by 1, until few seats are left: none of these can be more than the highest quotients give.
    fixed: set[int] = set()
    while True:
        open_ = [i for i in live if i not in fixed]
        left, total = seats - sum(caps[i] for i in fixed), sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total >= caps[i] + len(live)] if open_ else []
        if not over:
            break
        fixed.update(over)
    for i in fixed:
        got[i] = caps[i]
    for i in open_:
        got[i] = max(0, min(caps[i], int(left * weights[i] / total) - len(live)))
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in live if got[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def apportion(sources: Sequence[Source], block: int) -> list[int]:
    """Blocks of each source; the last block of a source that runs out may be partly filled."""
    total = sum(s.available for s in sources)
    caps = [-(-s.available * s.max_repeats // block) for s in sources]
    return sainte_lague([Fraction(s.share) if s.share > 0 else Fraction(0) for s in sources], caps, total // block)


def mix(df: DataFrame, id: str, source: Column, size: Column, targets: DataFrame, block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    `targets` has `source`, `target_share`, `max_repeats`, one row a source; of
    several spellings, given by `source` after normalisation, shares add up and
    the largest number of repeats holds. The total that is aimed at is the size
    of all records of target sources.

    Mixture: `id`, `source`, `n_tokens`, `repeats` (at least 1, never more than
    allowed). Records of other sources or with a null source are not in it; nor
    are records of size 0 or null, which can't add to any share. Repeated ids
    are records of their own.

    Report, one row a target source, also those without records:
    `available_tokens`, `target_share`, `max_repeats`, `target_tokens` (share
    of the total), `quota_tokens`, `actual_tokens`, `actual_share` (of all that
    is in the mixture; null if that is nothing), `n_records`, and `is_short`:
    even with all repeats the source holds less than its target.
    """
    spark = df.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = df.select(F.col(f"`{id}`").alias("id"), source.alias("source"), F.coalesce(size.cast("long"), F.lit(0)).alias("n_tokens")).where("n_tokens > 0 and source is not null")
    # Partial sums by source come first, so the join has one row a source of each task.
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n"))
    known = wanted.join(totals, "source", "left").orderBy("source").collect()
    sources = [Source(r.source, float(r.share or 0), int(r.repeats or 0), int(r.available or 0)) for r in known]
    blocks = apportion(sources, block)
    shards = [max(1, -(-s.available // SHARD_SIZE), -(-int(r.n or 0) // SHARD_ROWS)) for s, r in zip(sources, known, strict=True)]
    quota = [min(b * block, s.available * s.max_repeats) for b, s in zip(blocks, sources, strict=True)]
    plan = spark.createDataFrame([(s.name, s.max_repeats, b, k, s.available) for s, b, k in zip(sources, blocks, shards, strict=True)], "source string, max_repeats long, blocks long, shards long, available long")

    sharded = rows.join(small_side(plan.where("blocks > 0")), "source").withColumn("draw", F.xxhash64(F.lit(seed), "id")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), "shards"))
    held = sharded.groupBy("source", "shard", "blocks", "max_repeats", "available").agg(F.sum("n_tokens").alias("held"))
    quotas = checkpointed(shard_quotas(checkpointed(held), block, max(shards, default=1)))
    sharded = sharded.join(quotas, ["source", "shard"])
    order = Window.partitionBy("source", "shard").orderBy("draw", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    rest = F.col("quota") % F.col("held")
    taken = sharded.withColumn("before", before).withColumn("repeats", F.expr("quota div held") + F.when((F.col("before") < rest) & (2 * (rest - F.col("before")) >= F.col("n_tokens")), 1).otherwise(0))
    mixture = taken.where("repeats > 0").select(F.col("id").alias(id), "source", "n_tokens", F.col("repeats").cast("int").alias("repeats"))

    whole = sum(s.available for s in sources)
    aims = spark.createDataFrame([(s.name, s.share, s.max_repeats, s.available, s.share * whole, q, float(s.available * s.max_repeats) < s.share * whole) for s, q in zip(sources, quota, strict=True)], "source string, target_share double, max_repeats long, available_tokens long, target_tokens double, quota_tokens long, is_short boolean")
    reached = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.sum("repeats").alias("n_records"))
    report = aims.join(reached, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("actual_tokens", "n_records")})
    total = F.sum("actual_tokens").over(Window.partitionBy())  # one row a target source
    return mixture, report.withColumn("actual_share", F.try_divide("actual_tokens", total))


def shard_quotas(held: DataFrame, block: int, shards: int) -> DataFrame:
    """source, shard, held, quota: the blocks of a source among its shards, by highest quotients.

    `held` has source, shard (below `shards`), blocks, max_repeats, available,
    held. Blocks go to groups of shards first, then to the shards of each group,
    in as many steps as keep a group to 1,024 members, so no window is over more.
    """
    caps = held.withColumn("cap", F.ceil(F.col("held") * F.col("max_repeats") / F.lit(block)))
    steps = 0
    while (shards - 1) >> (FANOUT_BITS * steps):
        steps += 1
    node = lambda step: F.shiftright("shard", FANOUT_BITS * step)
    seats = caps.groupBy("source").agg(F.max("blocks").alias("seats"), F.sum("held").alias("whole")).withColumn("above", F.lit(0).cast("long"))
    for step in reversed(range(steps)):
        members = caps.groupBy("source", node(step + 1).alias("above"), node(step).alias("node")).agg(F.sum("held").alias("own"), F.sum("cap").alias("cap"))
        seats = _shared_out(members.join(seats, ["source", "above"])).select("source", F.col("node").alias("above"), "seats", F.col("own").alias("whole"))
    quota = caps.join(seats.select("source", F.col("above").alias("shard"), "seats"), ["source", "shard"]) if steps else caps.join(seats.select("source", "seats"), "source")
    return quota.select("source", "shard", "held", F.least(F.col("seats") * block, F.col("held") * F.col("max_repeats")).alias("quota"))


def _shared_out(members: DataFrame) -> DataFrame:
    """`members` (source, above, node, own, cap) with `seats`, their part of the `seats` of (source, above), which holds `whole`, by highest quotients.

    A member is sure of the seats well below its exact share and never gets those
    well above it; the few in between are ranked. How far from its share a
    member can end is what the rounding of all others and the blocks that their
    caps turn away, at most one each, can add up to.
    """
    group = Window.partitionBy("source", "above")
    exact = F.col("seats").cast("double") * F.col("own") / F.col("whole")
    reach = 4 + F.ceil(2.0 * F.count(F.lit(1)).over(group) * F.col("own") / F.col("whole"))
    sure = members.withColumn("reach", reach).withColumn("sure", F.greatest(F.lit(0), F.least("cap", F.floor(exact) - F.col("reach"))))
    sure = sure.withColumn("left", F.col("seats") - F.sum("sure").over(group))
    open_ = sure.withColumn("seat", F.explode(F.sequence(F.col("sure"), F.col("sure") + 2 * F.col("reach")))).where("seat < cap")
    ranked = open_.withColumn("rank", F.row_number().over(group.orderBy(F.desc(F.col("own") / (2 * F.col("seat") + 1)), "node"))).where("rank <= left")
    more = ranked.groupBy("source", "above", "node").agg(F.count(F.lit(1)).alias("more"))
    return sure.join(more, ["source", "above", "node"], "left").withColumn("seats", F.col("sure") + F.coalesce("more", F.lit(0)))
