"""Ordered-reason classification of paired records and the filters made of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_reason(*tests: tuple[str, Column], otherwise: str = "concordant") -> Column:
    """The label of the first test that holds; a test that is null does not hold."""
    out = None
    for label, test in tests:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


#: Labels that say a pair is discordant.
DISCORDANT = ("other_chromosome", "same_strand", "wrong_sign", "large_insert")


def discordance(paired: Column, both_mapped: Column, chrom: str, pos: str, strand: str, mate_chrom: str, mate_pos: str, mate_strand: str, isize: str, median: str, sd: str, n_sd: float) -> Column:
    """One reason a pair: three that rule it out, four that make it discordant, else `concordant`."""
    c = F.col
    return first_reason(
        ("not_paired", ~paired),
        ("not_both_mapped", ~both_mapped),
        ("same_position", (c(pos) == c(mate_pos)) & (c(chrom) == c(mate_chrom))),
        ("other_chromosome", c(chrom) != c(mate_chrom)),
        ("same_strand", c(strand) == c(mate_strand)),
        ("wrong_sign", ((c(strand) < 0) & (c(isize) > 0)) | ((c(strand) > 0) & (c(isize) < 0))),
        ("large_insert", F.abs(isize) > F.ceil(c(median) + n_sd * c(sd))),
    )


def is_concordant(chrom: str, mate_chrom: str, strand: str, mate_strand: str, isize: str, upper: str) -> Column:
    """Same chromosome, facing strands, and an insert no larger than the read group's bound."""
    return (F.col(chrom) == F.col(mate_chrom)) & (F.col(strand) == 1) & (F.col(mate_strand) == -1) & (F.col(isize) <= F.col(upper))


def strand_type(strand: str, mate_strand: str) -> Column:
    """0: (+,-), 1: (+,+), 2: (-,-), 3: (-,+)."""
    s, m = F.col(strand) == 1, F.col(mate_strand) == 1
    return F.when(s & ~m, 0).when(s & m, 1).when(~s & ~m, 2).when(~s & m, 3)


def insert_size(strand: str, mate_strand: str, pos: str, mate_pos: str, mate_len: str) -> Column:
    """Insert size by orientation, for pairs on one chromosome."""
    delta = F.abs(F.col(pos) - F.col(mate_pos))
    return F.when(F.col(strand) == F.col(mate_strand), delta + 1).when(F.col(strand) == 1, delta + F.col(mate_len)).otherwise(delta - F.col(mate_len) + 2)


def blacklist_anti(df, points, chrom: str, pos: str, mate_chrom: str, mate_pos: str, offset: int = 0):
    """Rows of which neither mate stands on a listed point (`chrom`, `pos`), nor `offset` to the right of it."""
    spots = points.select(F.col("chrom").alias("__c"), F.col("pos").alias("__p")).distinct()
    for c, p in ((chrom, pos), (mate_chrom, mate_pos)):
        for shift in dict.fromkeys((0, offset)):
            df = df.join(spots, (F.col(c) == F.col("__c")) & (F.col(p) + shift == F.col("__p")), "left_anti")
    return df
