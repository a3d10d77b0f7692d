"""Per-contig results of the tables in which a few contigs hold most rows (p2), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.names import norm_contig
from strandwise.functions.values import size_or_null
from strandwise.operators.hotkeys import heavy_keys, key_profile
from strandwise.plans.tables import table

PERCENTS = (5, 50, 95, 99)
HEAVY_SHARE = 0.05


def _contig_rows(spark: SparkSession, folder: str) -> DataFrame:
    def part(name: str, contig: str, read: str, size: str) -> DataFrame:
        return table(spark, folder, name).select(F.lit(name).alias("table_name"), norm_contig(contig).alias("contig"), F.col(read).alias("read"), size_or_null(size).alias("size"))

    return part("alt_map", "ref_id", "read_name", "insert_size").unionByName(part("clusters", "seqid", "readname", "isize"))


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return key_profile(_contig_rows(spark, folder), ["table_name", "contig"], F.col("size"), F.col("read"), PERCENTS)


def p2_contigs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct reads and sizes of every contig; null contigs are one row a table."""
    return _profile(spark, folder).withColumn("sum_value", F.col("sum_value").cast("long"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(_profile(spark, folder), ["table_name"], HEAVY_SHARE).where("contig is not null").select("table_name", "contig")


_ROWS = """
with rows_ as (
  select 'alt_map' as table_name, regexp_replace(trim(ref_id), '^[cC][hH][rR]', '') as contig, read_name as read, case when insert_size in (0, -1, 9223372036854775807) then null else abs(insert_size) end as size from alt_map
  union all
  select 'clusters', regexp_replace(trim(seqid), '^[cC][hH][rR]', ''), readname, case when isize in (0, -1, 9223372036854775807) then null else abs(isize) end from clusters
)"""

SQL = {
    "p2_found": _ROWS
    + """, n as (select table_name, contig, count(*) as n from rows_ group by table_name, contig)
select table_name, contig from (select *, sum(n) over (partition by table_name) as all_rows from n) where contig is not null and n * 100 > all_rows * 5""",
    "p2_contigs": _ROWS
    + """, ranked as (
  select *, row_number() over (partition by table_name, contig order by size nulls last) as r, count(size) over (partition by table_name, contig) as n from rows_
) select table_name, contig, count(*) as n_rows, count(distinct read) as n_items, count(size) as n_values, cast(sum(size) as bigint) as sum_value, min(size) as min_value, max(size) as max_value, """
    + ", ".join(f"max(case when r = greatest(1, (n * {q} + 99) // 100) then size end) as p{q}" for q in PERCENTS)
    + " from ranked group by table_name, contig",
}

QUERIES = {"p2_found": p2_found, "p2_contigs": p2_contigs}
