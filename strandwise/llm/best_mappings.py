"""The best alternative mappings of every read (p5), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.values import known_or_null
from strandwise.llm.top_n import distinct_by_digest, top_n
from strandwise.plans.tables import table

BEST = 3
ORDER = [("known_nm", "asc"), ("known_len", "desc"), ("alt_id", "asc")]


def distinct_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """read_name, alt_id, nm, aln_len and the two measures with null for unknown; copies of a row are one mapping."""
    rows = table(spark, folder, "alt_map")
    kept = ["read_name", "nm", "aln_len"]
    rest = [c for c in rows.columns if c not in ("alt_id", "loaded_at", *kept)]
    items = distinct_by_digest(rows.where("read_name is not null"), kept, rest, "alt_id")
    return items.select("read_name", "alt_id", "nm", "aln_len", known_or_null("nm").alias("known_nm"), known_or_null("aln_len").alias("known_len"))


def p5_best(spark: SparkSession, folder: str) -> DataFrame:
    return top_n(distinct_mappings(spark, folder), ["read_name"], ORDER, BEST).select("read_name", "alt_id", "nm", "aln_len", "rank_no")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_n(distinct_mappings(spark, folder), ["read_name"], ORDER, BEST, only_larger=True).select("read_name", "alt_id")


_RANKED = """
with items as (
  select min(alt_id) as alt_id, read_name, nm, aln_len from alt_map where read_name is not null
  group by read_name, ref_id, read_start, read_strand, mate_ref_id, mate_start, mate_strand, insert_size, nm, mate_nm, read_group, aln_len, mate_aln_len, weight, mapped_at
), ranked as (
  select *, row_number() over (partition by read_name order by nullif(nm, -1) asc nulls last, nullif(aln_len, -1) desc nulls last, alt_id) as rank_no, count(*) over (partition by read_name) as n from items
)"""

SQL = {
    "p5_best": _RANKED + " select read_name, alt_id, nm, aln_len, cast(rank_no as integer) as rank_no from ranked where rank_no <= 3",
    "p5_found": _RANKED + " select read_name, alt_id from ranked where rank_no <= 3 and n > 3",
}

QUERIES = {"p5_found": p5_found, "p5_best": p5_best}
