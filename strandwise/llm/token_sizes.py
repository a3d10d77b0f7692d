"""Documents assigned to containers (p6) and mixed to target shares (p7), by their size in tokens, and the SQL.

The tokenizer is the public byte vocabulary of ByT5: a token a UTF-8 byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.names import norm_source
from strandwise.llm.mixing import BLOCK, SHARD_SIZE, mix
from strandwise.llm.packing import container_report, pack
from strandwise.plans.tables import table
from strandwise.runtime import checkpointed

CAPACITY = 4_096
SEED = 20_250


def byte_tokens(text: str) -> Column:
    """One token for each UTF-8 byte, no special tokens; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", byte_tokens("text"), CAPACITY)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that had to be divided: those with a second piece."""
    return p6_packed(spark, folder).where("piece_no = 1").select("doc_id")


def p6_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document its tokens in all containers, its pieces, and whether none of its containers is over the capacity."""
    packed = checkpointed(p6_packed(spark, folder))
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return packed.join(used, "container_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("pieces"), F.bool_and(F.col("used") <= CAPACITY).alias("fits"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return container_report(p6_packed(spark, folder), CAPACITY)


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets").withColumn("source", norm_source("source"))
    return mix(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id", norm_source("source"), byte_tokens("text"), targets, seed=SEED)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p7_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens that the apportionment gives each source, and whether the mixture holds as many to within a block and half a record of each shard."""
    mixture, report = _mixed(spark, folder)
    longest = mixture.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    shards = F.ceil(F.col("available_tokens") / SHARD_SIZE) + F.lit(1)
    near = F.abs(F.col("actual_tokens") - F.col("quota_tokens")) <= shards * (BLOCK + F.coalesce("longest", F.lit(0)))
    return report.join(longest, "source", "left").select("source", "available_tokens", "quota_tokens", near.alias("near"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sources that can't reach their share however often their records are repeated."""
    # What the mixture holds comes first; the exact comparison follows, as rounding to blocks leaves others below their target too.
    return p7_report(spark, folder).where("actual_tokens < target_tokens").where("is_short").select("source")


_SOURCES = """
with docs as (
  select regexp_replace(lower(trim(source)), '[ _-]+', '_', 'g') as source, coalesce(strlen(text), 0) as n from documents
), a as (
  select m.source, m.target_share, m.max_repeats, coalesce(sum(d.n), 0)::bigint as a from (select regexp_replace(lower(trim(source)), '[ _-]+', '_', 'g') as source, target_share, max_repeats from mix_targets) m left join docs d using (source) group by all
)"""

SQL = {
    "p6_documents": "select doc_id, coalesce(strlen(text), 0) as n_tokens, greatest(1, (coalesce(strlen(text), 0) + 4095) // 4096) as pieces, true as fits from documents",
    "p7_quotas": _SOURCES
    + """, seats as (
  select source, share / (2 * j + 1) as quotient, j from (select source, target_share as share, unnest(range(0, (a * max_repeats + 4095) // 4096)) as j from a where target_share > 0)
), won as (
  select source, count(*) as blocks from (select source, row_number() over (order by quotient desc, source) as r from seats) where r <= (select sum(a) // 4096 from a) group by source
) select source, a as available_tokens, cast(least(coalesce(blocks, 0) * 4096, a * max_repeats) as bigint) as quota_tokens, true as near from a left join won using (source)""",
    "p6_found": "select doc_id from documents where strlen(text) > 4096",
    "p7_found": _SOURCES + " select source from (select *, sum(a) over () as t from a) where cast(a * max_repeats as double) < target_share * t",
}

QUERIES = {"p6_found": p6_found, "p6_packed": p6_packed, "p6_documents": p6_documents, "p6_containers": p6_containers, "p7_found": p7_found, "p7_mixture": p7_mixture, "p7_report": p7_report, "p7_quotas": p7_quotas}
