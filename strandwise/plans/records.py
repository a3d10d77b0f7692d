"""The paired records that most queries begin with: `alt_map` with canonical names and nulls for what is unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.names import norm_contig, norm_name
from strandwise.functions.values import known_or_null
from strandwise.plans.tables import table


def _size(column: str):
    return F.when(F.col(column).isin(0, -1, 9223372036854775807), None).otherwise(F.col(column))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "alt_map")
    return rows.select(
        F.col("alt_id").alias("id"),
        F.col("read_name").alias("name"),
        norm_contig("ref_id").alias("chrom"),
        F.col("read_start").alias("pos"),
        F.col("read_strand").alias("strand"),
        norm_contig("mate_ref_id").alias("mate_chrom"),
        F.col("mate_start").alias("mate_pos"),
        F.col("mate_strand").alias("mate_strand"),
        _size("insert_size").alias("isize"),
        known_or_null("nm").alias("nm"),
        known_or_null("mate_nm").alias("mate_nm"),
        norm_name("read_group").alias("rg"),
        known_or_null("aln_len").alias("len"),
        known_or_null("mate_aln_len").alias("mate_len"),
        "weight",
    )


PAIRS_SQL = """pairs as (
  select alt_id as id, read_name as name, regexp_replace(trim(ref_id), '^[cC][hH][rR]', '') as chrom, read_start as pos, read_strand as strand,
    regexp_replace(trim(mate_ref_id), '^[cC][hH][rR]', '') as mate_chrom, mate_start as mate_pos, mate_strand,
    case when insert_size in (0, -1, 9223372036854775807) then null else insert_size end as isize,
    nullif(nm, -1) as nm, nullif(mate_nm, -1) as mate_nm, upper(trim(read_group)) as rg, nullif(aln_len, -1) as len, nullif(mate_aln_len, -1) as mate_len, weight
  from alt_map
)"""


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster members with canonical names."""
    rows = table(spark, folder, "clusters")
    return rows.select("pid", "sid", "cluster_id", "weight", F.col("mismatches").alias("nm"), F.col("readname").alias("name"), norm_name("rg").alias("rg"), norm_contig("seqid").alias("chrom"), "strand", F.col("start_pos").alias("pos"), known_or_null("len").alias("len"), norm_contig("mseqid").alias("mate_chrom"), F.col("mstrand").alias("mate_strand"), F.col("mstart").alias("mate_pos"), known_or_null("mlen").alias("mate_len"), _size("isize").alias("isize"))


MEMBERS_SQL = """members as (
  select pid, sid, cluster_id, weight, mismatches as nm, readname as name, upper(trim(rg)) as rg, regexp_replace(trim(seqid), '^[cC][hH][rR]', '') as chrom, strand, start_pos as pos,
    nullif(len, -1) as len, regexp_replace(trim(mseqid), '^[cC][hH][rR]', '') as mate_chrom, mstrand as mate_strand, mstart as mate_pos, nullif(mlen, -1) as mate_len,
    case when isize in (0, -1, 9223372036854775807) then null else isize end as isize
  from clusters
)"""


def repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Repeat annotation with ends in order and both at least 1; unknown classes are null."""
    rows = table(spark, folder, "rmasker").where("start_pos >= 1 and end_pos >= 1")
    kind = F.upper(F.trim("repeat_class"))
    return rows.select(norm_contig("chromosome").alias("chrom"), F.least("start_pos", "end_pos").alias("s"), F.greatest("start_pos", "end_pos").alias("e"), norm_name("repeat_name").alias("rname"), F.when(kind.isin("NA", "-", ""), None).otherwise(kind).alias("rclass"))


REPEATS_SQL = """reps as (
  select regexp_replace(trim(chromosome), '^[cC][hH][rR]', '') as chrom, least(start_pos, end_pos) as s, greatest(start_pos, end_pos) as e, upper(trim(repeat_name)) as rname,
    case when upper(trim(repeat_class)) in ('NA', '-', '') then null else upper(trim(repeat_class)) end as rclass
  from rmasker where start_pos >= 1 and end_pos >= 1
)"""


def gene_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "genes").where("s >= 1 and e >= 1")
    return rows.select(norm_contig("chrom").alias("gchrom"), F.least("s", "e").alias("gs"), F.greatest("s", "e").alias("ge"), norm_name("gene_name").alias("gname"), F.coalesce("gene_type", F.lit("NA")).alias("gtype"), F.trim("strand").alias("gstrand"))


GENES_SQL = """gene_spans as (
  select regexp_replace(trim(chrom), '^[cC][hH][rR]', '') as gchrom, least(s, e) as gs, greatest(s, e) as ge, upper(trim(gene_name)) as gname, coalesce(gene_type, 'NA') as gtype, trim(strand) as gstrand
  from genes where s >= 1 and e >= 1
)"""


#: The largest insert size that statistics take in, as a library's fragments are not longer.
MAX_ISIZE = 10_000


def group_stats(rows: DataFrame, most: int = MAX_ISIZE) -> DataFrame:
    """Median and sample standard deviation of the absolute insert sizes of each read group, as a stat table of as many rows as there are read groups. Sizes above `most` do not count."""
    return rows.where(f"isize is not null and rg is not null and abs(isize) <= {most}").groupBy("rg").agg(F.percentile(F.abs("isize"), 0.5).alias("median"), F.stddev_samp(F.abs("isize")).alias("sd"), F.count(F.lit(1)).alias("n"))


STATS_SQL = f"""stats as (
  select rg, quantile_cont(abs(isize), 0.5) as median, stddev_samp(abs(isize)) as sd, count(*) as n from pairs where isize is not null and rg is not null and abs(isize) <= {MAX_ISIZE} group by rg
)"""
