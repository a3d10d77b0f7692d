"""Pieces of the stretches of a file that belong to one reference (p4), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.llm.splitting import split_items
from strandwise.plans.tables import table

LIMIT, OVERLAP = 262_144, 4_096
KEYS = ["file_id", "ref_id"]


def stretches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The stretches (file_id, ref_id, start, stop) and the records in them."""
    rows = table(spark, folder, "block_boundaries").where("ref_id is not null and file_offset is not null and not (read_name <=> 'last')").select(*KEYS, "file_offset", "read_name")
    starts = rows.groupBy(*KEYS).agg(F.min("file_offset").alias("start"))
    files = table(spark, folder, "bam_files").select("file_id", "n_bytes")
    along = Window.partitionBy("file_id").orderBy("start", "ref_id")  # as many rows a file as it has references
    whole = starts.join(files, "file_id", "left").withColumn("stop", F.coalesce(F.lead("start").over(along), "n_bytes"))
    return whole.select(*KEYS, "start", "stop"), rows


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    items, records = stretches(spark, folder)
    return split_items(items, records, KEYS, "start", "stop", "file_offset", "read_name", LIMIT, OVERLAP)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches that had to be split."""
    return p4_pieces(spark, folder).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEYS)


def p4_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each stretch add up to: its first and last position, whether all pieces fit, and whether each begins at most the overlap before the end of the one before, and none after it."""
    pieces = p4_pieces(spark, folder)
    along = Window.partitionBy(*KEYS).orderBy("piece_start", "piece_end")  # a row in 262,144 bytes of a stretch
    pieces = pieces.withColumn("before", F.lag("piece_end").over(along))
    joined = F.col("before").isNull() | ((F.col("piece_start") <= F.col("before")) & (F.col("before") - F.col("piece_start") <= OVERLAP) & (F.col("before") < F.col("piece_end")))
    return pieces.groupBy(*KEYS).agg(F.min("piece_start").alias("first"), F.max("piece_end").alias("last"), F.bool_and(F.col("piece_end") - F.col("piece_start") <= LIMIT).alias("fits"), F.bool_and(joined).alias("joined"))


_WHOLE = """
with starts as (
  select file_id, ref_id, min(file_offset) as start from block_boundaries
  where ref_id is not null and file_offset is not null and read_name is distinct from 'last' group by file_id, ref_id
), whole as (
  select file_id, ref_id, start, coalesce(lead(start) over (partition by file_id order by start, ref_id), n_bytes) as stop from starts left join bam_files using (file_id)
)"""

SQL = {
    "p4_stretches": _WHOLE + " select file_id, ref_id, start as first, stop as last, true as fits, true as joined from whole where stop > start",
    "p4_found": _WHOLE + " select file_id, ref_id from whole where stop - start > 262144",
}

QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_stretches": p4_stretches}
