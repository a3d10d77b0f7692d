"""Continuous periods and gaps of annotated entities (p1), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.names import norm_contig, norm_name
from strandwise.operators.dyadic import continuous_periods, period_gaps
from strandwise.plans.tables import table

KEYS = ["table_name", "contig", "entity"]


def annotation_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of both annotation tables that count: entity and contig known, both coordinates at least 1."""

    def part(name: str, contig: str, entity: str, a: str, b: str) -> DataFrame:
        rows = table(spark, folder, name).where((F.col(a) >= 1) & (F.col(b) >= 1))
        return rows.select(F.lit(name).alias("table_name"), norm_contig(contig).alias("contig"), norm_name(entity).alias("entity"), F.col(a).alias("a"), F.col(b).alias("b"))

    return part("rmasker", "chromosome", "repeat_name", "start_pos", "end_pos").unionByName(part("genes", "chrom", "gene_name", "s", "e")).where("contig is not null and entity is not null")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return period_gaps(annotation_intervals(spark, folder), KEYS, "a", "b")


def p1_periods(spark: SparkSession, folder: str) -> DataFrame:
    return continuous_periods(annotation_intervals(spark, folder), KEYS, "a", "b")


_SPANS = """
with rows_ as (
  select 'rmasker' as table_name, regexp_replace(trim(chromosome), '^[cC][hH][rR]', '') as contig, upper(trim(repeat_name)) as entity, start_pos as a, end_pos as b from rmasker
  union all
  select 'genes', regexp_replace(trim(chrom), '^[cC][hH][rR]', ''), upper(trim(gene_name)), s, e from genes
), spans as (
  select table_name, contig, entity, least(a, b) as lo, greatest(a, b) as hi from rows_
  where a >= 1 and b >= 1 and contig is not null and entity is not null
), reach as (
  select *, max(hi) over (partition by table_name, contig, entity order by lo, hi desc rows between unbounded preceding and 1 preceding) as before from spans
)"""

SQL = {
    "p1_found": _SPANS + " select distinct table_name, contig, entity, before + 1 as gap_start, lo - 1 as gap_end from reach where lo > before + 1",
    "p1_periods": _SPANS
    + """, opened as (
  select *, sum(case when before is null or lo > before + 1 then 1 else 0 end) over (partition by table_name, contig, entity order by lo, hi desc rows unbounded preceding) as period from reach
) select table_name, contig, entity, min(lo) as period_start, max(hi) as period_end from opened group by table_name, contig, entity, period""",
}

QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods}
