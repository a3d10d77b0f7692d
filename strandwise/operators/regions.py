"""Regions of two halves: widening, first of each cluster, merging to a fixpoint; rules over contig alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.intervals import overlap_join
from strandwise.operators.set_packing import components
from strandwise.runtime import checkpointed


def widen(df: DataFrame, bounds: list[tuple[str, str]], by: int) -> DataFrame:
    """Each (low, high) so much wider on both sides, not below 0."""
    return df.withColumns({c: x for low, high in bounds for c, x in ((low, F.greatest(F.col(low) - by, F.lit(0))), (high, F.col(high) + by))})


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("__no", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__no = 1").drop("__no")


def merge_regions(regions: DataFrame) -> DataFrame:
    """Regions (id, chrom, mate_chrom, a1, a2, b1, b2) of which both halves overlap become one, until none do.

    Out: the same columns for the union, with the least id, and `ids`, how many
    regions went into it. Regions of equal bounds are folded before they are
    compared; a merged region is the hull of each half. Linked regions are
    found as components over pairs of neighbours, round by round.
    """
    cols = ["chrom", "mate_chrom", "a1", "a2", "b1", "b2"]
    now = checkpointed(regions.where("a1 <= a2 and b1 <= b2").groupBy(*cols).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("ids")))
    while True:  # every round has fewer regions than the one before
        other = now.select(*[F.col(c).alias(f"o_{c}") for c in ["id", *cols]])
        hits = overlap_join(now, other, [("chrom", "o_chrom"), ("mate_chrom", "o_mate_chrom")], ("a1", "a2"), ("o_a1", "o_a2")).where("id < o_id and b1 <= o_b2 and o_b1 <= b2")
        # Each region is linked to the least one that it meets; that keeps the links of a pile-up as few as its regions, and the next round goes on.
        least = checkpointed(hits.groupBy(F.col("o_id").alias("x")).agg(F.min("id").alias("y")))
        if least.isEmpty():
            return now.select("id", *cols, "ids")
        links = least.select(F.col("x").alias("id"), "y").unionByName(least.select(F.col("y").alias("id"), "y"))
        group = components(links, "id", "y").select(F.col("id").alias("g_id"), "component")
        joined = now.join(group, F.col("id") == F.col("g_id"), "left").withColumn("component", F.coalesce("component", "id"))
        hull = joined.groupBy("component", "chrom", "mate_chrom").agg(F.min("a1").alias("a1"), F.max("a2").alias("a2"), F.min("b1").alias("b1"), F.max("b2").alias("b2"), F.sum("ids").alias("ids"))
        now = checkpointed(hull.withColumnRenamed("component", "id"))


def is_orphan(poly: Column, left_ref: Column, right_ref: Column, left_repeat: Column, right_repeat: Column) -> Column:
    """Whether a contig pair is an orphan by which of its four alignments exist: with a poly tail any; without, both repeats, or a repeat and a reference."""
    any_ref, any_repeat = left_ref | right_ref, left_repeat | right_repeat
    return F.when(poly, any_ref | any_repeat).otherwise((left_repeat & right_repeat) | (any_ref & any_repeat))


def is_transduction(poly: Column, orphan: Column, *aligned: Column) -> Column:
    """Not all aligned, a poly tail, and no orphan."""
    n = sum((a.cast("int") for a in aligned[1:]), aligned[0].cast("int"))
    return (n != len(aligned)) & poly & ~orphan


# What a losing split-read event becomes.
SPLIT_READ_DEMOTION = {"inssd": "tandem_dup", "inssu": "tandem_dup", "insod": "invers_f", "insou": "invers_f", "del_invers": "invers_f", "inss": "transl_inter", "inso": "transl_inter"}


def demoted_name(event: Column) -> Column:
    plain = F.when(event == "del_invers", event).otherwise(F.regexp_replace(event, "^del_", ""))
    table = F.create_map(*[F.lit(x) for pair in SPLIT_READ_DEMOTION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), event)


def insertion_orientation(first: Column, second: Column) -> Column:
    """`no` or `inv` with the side, from the strands in order of position of both ends; null if they say nothing."""
    both = second.isin("--", "++")
    return (
        F.when((first == "+-") & (second == "-+"), "1 no")
        .when((first == "-+") & (second == "+-"), "2 no")
        .when((first == "+-") & both, "1 inv")
        .when(first.isin("--", "++") & (second == "+-"), "2 inv")
    )
