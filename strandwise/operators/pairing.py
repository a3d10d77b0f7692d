"""Pairing of plus and minus clusters, and consensus positions of clipped records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.intervals import overlap_join

WILDCARD = "POLYA"


def families_compatible(plus: str, minus: str, wildcard: str = WILDCARD) -> Column:
    """Every family of the minus side is one of the plus side or the wildcard; the plus side may be the wildcard alone, but not both sides."""
    only = lambda c: F.size(F.array_except(c, F.array(F.lit(wildcard)))) == 0
    inside = F.size(F.array_except(F.array_except(minus, plus), F.array(F.lit(wildcard)))) == 0
    return (inside | only(plus)) & ~(only(plus) & only(minus))


def pair_strands(plus: DataFrame, minus: DataFrame, gap: int, read_len: int, stringent: bool = True) -> DataFrame:
    """Pairs of clusters of opposite strands of one chromosome.

    Both sides have chrom, s, e, families; the columns of the result have the
    prefixes p_ and n_. The minus cluster overlaps the plus cluster widened by
    `gap` to the right, together they are longer than two reads and ten bases,
    and they stand in order: starts and ends if `stringent`, else the start of
    the plus one before the end of the minus one.
    """
    p = plus.select(*[F.col(c).alias(f"p_{c}") for c in plus.columns]).withColumn("p_reach", F.col("p_e") + gap)
    n = minus.select(*[F.col(c).alias(f"n_{c}") for c in minus.columns])
    hits = overlap_join(p, n, [("p_chrom", "n_chrom")], ("p_s", "p_reach"), ("n_s", "n_e")).drop("p_reach")
    long_enough = F.col("n_e") - F.col("p_s") + read_len > 2 * read_len + 10
    ordered = ((F.col("p_s") <= F.col("n_s")) & (F.col("p_e") <= F.col("n_e"))) if stringent else F.col("p_s") < F.col("n_e")
    return hits.where(long_enough & ordered & families_compatible("p_families", "n_families"))


def strand_modes(votes: DataFrame, id: str, margin: int) -> DataFrame:
    """Consensus positions of both strands out of votes (`id`, strand 1 or -1, pos): `id`, `pbp`, `nbp`, `p_votes`, `n_votes`.

    The mode of a strand is its lowest position with most votes; it is tied if
    others have as many. If the plus mode is not tied and either has more votes
    than the minus mode or that is tied, the minus position is picked again:
    most votes in [p, p + margin), else in [p - margin, p), else the nearest.
    Mirrored, if the minus mode is the clear one: most votes in (n - margin, n),
    else in (n, n + margin), else the nearest. If both are tied, each strand
    takes the tied position nearest to the middle of the two lowest. Ties of
    votes or distance go to the lower position. A side without votes is null.
    """
    counts = votes.where("pos is not null and strand in (1, -1)").groupBy(id, "strand", "pos").agg(F.count(F.lit(1)).alias("n"))
    most = Window.partitionBy(id, "strand")
    counts = counts.withColumns({"top": F.max("n").over(most)})
    per = counts.groupBy(id).agg(
        *[
            x
            for s, c in (("p", 1), ("n", -1))
            for x in (
                F.min(F.when((F.col("strand") == c) & (F.col("n") == F.col("top")), F.col("pos"))).alias(f"{s}0"),
                F.max(F.when(F.col("strand") == c, F.col("top"))).alias(f"{s}_top"),
                F.count_if((F.col("strand") == c) & (F.col("n") == F.col("top"))).alias(f"{s}_ties"),
            )
        ]
    )
    c = F.col
    plus_clear = (c("p_ties") == 1) & ((c("p_top") > c("n_top")) | (c("n_ties") > 1))
    minus_clear = (c("n_ties") == 1) & ((c("n_top") > c("p_top")) | (c("p_ties") > 1))
    both = c("p0").isNotNull() & c("n0").isNotNull()
    rule = F.when(~both, "one").when(plus_clear, "plus").when(minus_clear, "minus").when((c("p_ties") > 1) & (c("n_ties") > 1), "tied").otherwise("equal")
    per = per.withColumns({"rule": rule, "middle": F.expr("cast((p0 + n0) / 2 as bigint)")}).withColumnRenamed(id, "__id")
    cand = counts.join(per, c(id) == c("__id")).drop("__id")
    fixed = F.when(c("strand") == 1, c("p0")).otherwise(c("n0"))
    anchor = F.when(c("rule") == "plus", c("p0")).when(c("rule") == "minus", c("n0"))
    off = c("pos") - anchor
    first_zone = F.when(c("rule") == "plus", (off >= 0) & (off < margin)).otherwise((off > -margin) & (off < 0))
    second_zone = F.when(c("rule") == "plus", (off >= -margin) & (off < 0)).otherwise((off > 0) & (off < margin))
    moved = ((c("rule") == "plus") & (c("strand") == -1)) | ((c("rule") == "minus") & (c("strand") == 1))
    zone = F.when(first_zone, 0).when(second_zone, 1).otherwise(2)
    # Smaller is better, in the order of the fields.
    key = (
        F.when(moved, F.struct(zone.cast("long").alias("a"), F.when(zone < 2, -c("n")).otherwise(F.abs(off)).alias("b"), c("pos").alias("pos"), c("n").alias("n")))
        .when(c("rule") == "tied", F.struct((c("n") != c("top")).cast("long").alias("a"), F.abs(c("pos") - c("middle")).alias("b"), c("pos").alias("pos"), c("n").alias("n")))
        .otherwise(F.struct((c("pos") != fixed).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), c("pos").alias("pos"), c("n").alias("n")))
    )
    best = cand.withColumn("key", key).groupBy(id).agg(F.min(F.when(c("strand") == 1, c("key"))).alias("p"), F.min(F.when(c("strand") == -1, c("key"))).alias("m"))
    return best.select(id, c("p.pos").alias("pbp"), c("m.pos").alias("nbp"), c("p.n").alias("p_votes"), c("m.n").alias("n_votes"))


def insertion_score(pram: Column, nram: Column, pacr: Column, nacr: Column) -> Column:
    """Support of both strands, capped at 20 repeat-anchored mates and 10 aligned clips a side."""
    return F.least(pram, F.lit(20)) / 20 + F.least(nram, F.lit(20)) / 20 + F.least(pacr, F.lit(10)) / 10 + F.least(nacr, F.lit(10)) / 10


def signal_to_noise(p_in: Column, n_in: Column, p_out: Column, n_out: Column) -> Column:
    return 2 * F.sqrt(p_in * n_in) - (p_out + n_out)


def confidence(acr: Column, pacr: Column, nacr: Column, acrr: Column, tsd: Column, ram: Column, oi: Column, two_sided: Column, ram_cutoff: int = 6) -> Column:
    """1 to 5, each step needs those before; 0 where a reference repeat explains it (`oi` 0)."""
    two = (acr >= 2) & (~two_sided | ((pacr >= 1) & (nacr >= 1)))
    three = two & (acrr >= 0.4)
    four = three & tsd.between(-20, 50)
    five = four & (ram >= ram_cutoff)
    return F.when(oi == 0, 0).when(five, 5).when(four, 4).when(three, 3).when(two, 2).otherwise(1)
