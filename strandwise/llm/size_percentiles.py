"""Percentiles of insert sizes by read group (p3), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.names import norm_name
from strandwise.functions.values import size_or_null
from strandwise.llm.quantile_digest import ERROR, MANTISSA, build_digest, digest_percentiles, merge_digests
from strandwise.operators.hotkeys import selected_quantiles
from strandwise.plans.tables import table
from strandwise.runtime import checkpointed, small_side

KEYS = ["table_name", "read_group"]
FAR_TAIL = 3


def group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, read_group, size, loaded: the sizes that count."""

    def part(name: str, group: str, size: str) -> DataFrame:
        return table(spark, folder, name).select(F.lit(name).alias("table_name"), norm_name(group).alias("read_group"), size_or_null(size).alias("size"), F.to_date("loaded_at").alias("loaded"))

    return part("alt_map", "read_group", "insert_size").unionByName(part("clusters", "rg", "isize")).where("read_group is not null and size is not null")


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of the percentiles of each read group, out of one digest a load day, merged."""
    daily = build_digest(group_sizes(spark, folder), [*KEYS, "loaded"], F.col("size"))
    return digest_percentiles(merge_digests(daily, keys=KEYS), KEYS, (5, 25, 50, 75, 95, 99))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Read groups whose 95th percentile is more than 3 times the median.

    The digest decides every group whose bounds leave no doubt; of the others,
    if any, the two percentiles are selected exactly.
    """
    sizes = group_sizes(spark, folder).drop("loaded")
    bounds = digest_percentiles(build_digest(sizes, KEYS, F.col("size")), KEYS, (50, 95)).groupBy(*KEYS)
    at = lambda q, c: F.max(F.when(F.col("q") == q, F.col(c)).cast("decimal(20,0)"))
    bounds = bounds.agg(*[at(q, c).alias(f"{c}{q}") for q in (50, 95) for c in ("lower", "upper")])
    judged = checkpointed(bounds.select(*KEYS, F.when(F.col("lower95") > FAR_TAIL * F.col("upper50"), True).when(F.col("upper95") <= FAR_TAIL * F.col("lower50"), False).alias("far")))
    open_ = judged.where("far is null").select(*KEYS)
    sure = judged.where("far").select(*KEYS)
    if open_.isEmpty():
        return sure
    rest = sizes.join(small_side(open_), KEYS).select(F.col("table_name").alias("k0"), F.col("read_group").alias("k1"), F.col("size").alias("value"))
    exact = selected_quantiles(rest, ["k0", "k1"], (50, 95))[1].groupBy("k0", "k1")
    exact = exact.agg(*[F.max(F.when(F.col("q") == q, F.col("value")).cast("decimal(20,0)")).alias(f"p{q}") for q in (50, 95)])
    return sure.unionByName(exact.where(F.col("p95") > FAR_TAIL * F.col("p50")).select(F.col("k0").alias("table_name"), F.col("k1").alias("read_group")))


def p3_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the bounds of `p3_percentiles` hold: the values below the lower one are fewer than the rank, those up to the upper one are not; and whether no more ranks than the error allows lie strictly between them."""
    bounds = checkpointed(p3_percentiles(spark, folder))
    sizes = group_sizes(spark, folder).groupBy(*KEYS, "size").agg(F.count(F.lit(1)).alias("w"))  # equal sizes are added up before they meet the bounds
    met = sizes.join(small_side(bounds), KEYS)
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("w"))), F.lit(0))
    per = met.groupBy(*KEYS, "q", "n", "lower", "upper").agg(count(F.col("size") < F.col("lower")).alias("below"), count(F.col("size") <= F.col("upper")).alias("upto"), count((F.col("size") > F.col("lower")) & (F.col("size") < F.col("upper"))).alias("between"))
    rank = F.greatest(F.lit(1), F.expr("(n * q + 99) div 100"))
    # One quantization step has twelve significant bits; what lies inside of it is no error of rank.
    step = F.col("upper") - F.col("lower") <= F.shiftright(F.col("upper"), MANTISSA - 1)
    return per.select(*KEYS, "q", "n", ((F.col("below") < rank) & (rank <= F.col("upto"))).alias("holds"), (step | (F.col("between") <= F.ceil(2 * ERROR * F.col("n")))).alias("narrow"))


SQL = {
    "p3_bounds": """
with rows_ as (
  select 'alt_map' as table_name, upper(trim(read_group)) as read_group, insert_size as v from alt_map
  union all select 'clusters', upper(trim(rg)), isize from clusters
) select table_name, read_group, cast(q as integer) as q, count(*) as n, true as holds, true as narrow
from rows_, (values (5), (25), (50), (75), (95), (99)) as t(q) where read_group is not null and v is not null and v not in (0, -1, 9223372036854775807) group by table_name, read_group, q""",
    "p3_found": """
with rows_ as (
  select 'alt_map' as table_name, upper(trim(read_group)) as read_group, insert_size as v from alt_map
  union all select 'clusters', upper(trim(rg)), isize from clusters
), sizes as (
  select table_name, read_group, abs(v) as v from rows_ where read_group is not null and v is not null and v not in (0, -1, 9223372036854775807)
), ranked as (
  select *, row_number() over (partition by table_name, read_group order by v) as r, count(*) over (partition by table_name, read_group) as n from sizes
), marks as (
  select table_name, read_group, max(case when r = greatest(1, (n * 50 + 99) // 100) then v end) as p50, max(case when r = greatest(1, (n * 95 + 99) // 100) then v end) as p95
  from ranked group by table_name, read_group
) select table_name, read_group from marks where p95 > 3 * p50""",
}

QUERIES = {"p3_found": p3_found, "p3_percentiles": p3_percentiles, "p3_bounds": p3_bounds}
