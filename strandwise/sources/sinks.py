"""Writers of the text formats of the domain; every one writes in parallel, one file a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import count_n, reverse_complement


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None, two_places: Sequence[str] = (), missing: str = "", header: bool = True) -> None:
    """Tab-separated, nulls as `missing`; the columns in `two_places` with two digits after the point; arrays joined by commas."""
    out = df.select(*(columns or df.columns))
    kinds = dict(out.dtypes)
    text = {c: F.format_string("%.2f", F.col(c).cast("double")) if c in two_places else F.array_join(c, ",") if kinds[c].startswith("array") else F.col(c).cast("string") for c in out.columns}
    out.select(*[F.when(F.col(c).isNull(), missing).otherwise(x).alias(c) for c, x in text.items()]).write.csv(path, sep="\t", header=header, quote="", emptyValue="", nullValue="")


def pair_fastq_lines(pairs: DataFrame, most_n: int) -> DataFrame:
    """name, seq1, qual1, reverse1, seq2, qual2, reverse2 -> two texts a pair; pairs with more than `most_n` N in both together go; reverse reads are turned back, bases and qualities."""
    kept = pairs.where(count_n("seq1") + count_n("seq2") <= most_n)

    def record(i: int):
        back = F.col(f"reverse{i}")
        return F.concat_ws("\n", F.concat(F.lit("@"), "name", F.lit(f"/{i}")), F.when(back, reverse_complement(f"seq{i}")).otherwise(F.col(f"seq{i}")), F.lit("+"), F.when(back, F.reverse(f"qual{i}")).otherwise(F.col(f"qual{i}")))

    return kept.select(record(1).alias("first"), record(2).alias("second"))


def discord_bed(discord: DataFrame, window: int = 1_000) -> DataFrame:
    """Windows around both ends of discordant clusters with support of 3 or more, no unplaced contigs, one position or more than 10,000 apart."""
    far = (F.col("chrom") != F.col("mchrom")) | (F.abs(F.col("mpos") - F.col("pos")) > 10_000) | (F.col("mpos") == F.col("pos"))
    rows = discord.where((F.col("support") >= 3) & ~F.col("chrom").startswith("GL") & ~F.col("mchrom").startswith("GL") & far)
    sign = lambda c: F.when(F.col(c) == 1, "+").otherwise("-")
    around = lambda c: (F.greatest(F.col(c) - window, F.lit(0)), F.col(c) + window)
    (a, b), (d, e) = around("pos"), around("mpos")
    return rows.select(F.col("chrom").alias("chrom1"), a.alias("start1"), b.alias("end1"), F.col("mchrom").alias("chrom2"), d.alias("start2"), e.alias("end2"), "pid", "sid", sign("strand").alias("strand1"), sign("mstrand").alias("strand2"))


def event_lines(events: DataFrame) -> DataFrame:
    """One text an event: type, ids as `pid/partner`, chromosome, start, end and size; events with an unknown bound go."""
    kept = events.where("start is not null and `end` is not null and start <> 0 and `end` <> 0")
    return kept.select(F.concat_ws("\t", "event", F.concat_ws("/", "pid", "partner"), "chrom", "start", "end", (F.col("end") - F.col("start")).cast("string")).alias("line"))


def variant_lines(variants: DataFrame) -> DataFrame:
    """One text an event with the columns of its type: a translocation both points, a single event its range and size, an inversion of two clusters both ranges, an insertion both ranges and what is inserted. Events with a bound of 0 go."""
    kept = variants.where("start <> 0 and `end` <> 0 and coalesce(mate_start, 1) <> 0 and coalesce(mate_end, 1) <> 0")
    line = lambda *columns: F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])
    both = ["event", "ids", "chrom", "start", "end", "size", "mate_chrom", "mate_start", "mate_end"]
    form = F.when(F.col("event") == "transl_inter", line("event", "pid", "chrom", "start", "mate_chrom", "end")).when(F.col("partner").isNull(), line(*both[:1], "pid", *both[2:6])).when(F.col("rule") == "invers", line(*both)).otherwise(line(*both, "inserted"))
    return kept.withColumn("ids", F.concat_ws("/", "pid", "partner")).select(form.alias("line"))
