"""Structural events out of discordant clusters, their selection, demotion and mechanism, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.operators.assignment import assign_clusters, fold_ranges
from strandwise.operators.events import demote, intra_events, single_event, smallest
from strandwise.operators.set_packing import components, pack_sets
from strandwise.plans.records import MAX_ISIZE, MEMBERS_SQL, group_stats, members, pairs
from strandwise.runtime import checkpointed

READ_LEN = 100
LARGEST = 1_000_000_000


def clusters(spark: SparkSession, folder: str, support: int = 1) -> DataFrame:
    """One row a primary cluster and pair of chromosomes: ends of its starts and mate starts, strand type, support, mismatches of all members."""
    rows = members(spark, folder).where("chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null and strand in (1, -1) and mate_strand in (1, -1)")
    kind = F.when(F.col("strand") == 1, F.when(F.col("mate_strand") == 1, 1).otherwise(0)).otherwise(F.when(F.col("mate_strand") == 1, 3).otherwise(2))
    rows = rows.withColumn("t", kind)
    return rows.groupBy("pid", "chrom", "mate_chrom", "t").agg(F.min("pos").alias("s1"), F.max("pos").alias("s2"), F.min("mate_pos").alias("m1"), F.max("mate_pos").alias("m2"), F.count_distinct("name").alias("support"), F.sum(F.coalesce("nm", F.lit(0))).alias("mm")).where(F.col("support") >= support)


CLUSTERS_SQL = """typed as (select *, case when strand = 1 then case when mate_strand = 1 then 1 else 0 end else case when mate_strand = 1 then 3 else 2 end end as t from members
  where chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null and strand in (1, -1) and mate_strand in (1, -1))
, cl as (select pid, chrom, mate_chrom, t, min(pos) as s1, max(pos) as s2, min(mate_pos) as m1, max(mate_pos) as m2, count(distinct name) as support, cast(sum(coalesce(nm, 0)) as bigint) as mm from typed group by all)"""


def a8_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of clusters with at least 2 supporting reads."""
    return clusters(spark, folder, 2)


def a8_breakpoint_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The ranges of both breakpoints of each cluster, as folds of its members' ranges in the order of position, mate position, name and range; a disjoint range restarts a fold, and clusters of which a range is none go."""
    rows = members(spark, folder).where("chrom is not null and pos is not null and mate_pos is not null and len is not null and mate_len is not null and rg is not null and strand in (1, -1) and mate_strand in (1, -1)")
    stats = group_stats(members(spark, folder)).select("rg", F.ceil(F.col("median") + 3 * F.coalesce("sd", F.lit(0.0))).cast("long").alias("isu"))
    c = F.col

    def bounds(strand: str, pos: str, own: str, other: str):
        end = c(pos) + c(own)
        return F.when(c(strand) == 1, end - 10).otherwise(end - c("isu") + c(other)).cast("long"), F.when(c(strand) == 1, c(pos) + c("isu") - c(other)).otherwise(c(pos) + 10).cast("long")

    (a0, b0), (a1, b1) = bounds("strand", "pos", "len", "mate_len"), bounds("mate_strand", "mate_pos", "mate_len", "len")
    ranges = rows.join(stats, "rg").select("cluster_id", "pos", "mate_pos", "name", a0.alias("a0"), b0.alias("b0"), a1.alias("a1"), b1.alias("b1"))
    folded = fold_ranges(ranges, "cluster_id", ["pos", "mate_pos", "name", "a0", "b0", "a1", "b1"], [("a0", "b0"), ("a1", "b1")])
    return folded.where("not (a0 = 0 and b0 = 0) and not (a1 = 0 and b1 = 0)")


def e8_singles(spark: SparkSession, folder: str) -> DataFrame:
    """What each cluster says alone."""
    return singles(spark, folder).drop("mm")


def singles(spark: SparkSession, folder: str) -> DataFrame:
    """The events of clusters alone, with the mismatches of the cluster."""
    return clusters(spark, folder).withColumn("x", single_event()).where(f"x is not null and coalesce(x.size, 0) < {LARGEST}").select("pid", "chrom", "mate_chrom", "x.event", "x.start", "x.end", "x.size", "mm")


def intra(spark: SparkSession, folder: str) -> DataFrame:
    one = clusters(spark, folder).where("chrom = mate_chrom").drop("mate_chrom", "support", "mm")
    return intra_events(one, READ_LEN, LARGEST)


def e1_intra(spark: SparkSession, folder: str) -> DataFrame:
    """Every composite event on one chromosome."""
    return intra(spark, folder).drop("distance")


def smallest_intra(spark: SparkSession, folder: str) -> DataFrame:
    """The event of each anchor, with its bounds."""
    return smallest(intra(spark, folder))


def o7_smallest(spark: SparkSession, folder: str) -> DataFrame:
    """The event of each anchor, out of its three smallest."""
    return smallest(intra(spark, folder)).select("pid", "partner", "event", "deleted", "inserted")


def e13_demoted(spark: SparkSession, folder: str) -> DataFrame:
    """Smallest event of each cluster; what is left of the others."""
    return demote(checkpointed(smallest(intra(spark, folder))))


def a17_votes(spark: SparkSession, folder: str) -> DataFrame:
    """For each cluster the most frequent start (of equal ones the one nearest to 0), mate start (the one furthest from 0) and distance of the two (the one nearest to 0), and a second start more than 2 away with at least 2 votes."""
    rows = members(spark, folder).where("pos is not null and mate_pos is not null").withColumn("apart", F.col("mate_pos") - F.col("pos"))
    counts = lambda c: rows.groupBy("pid", c).agg(F.count(F.lit(1)).alias("n"))
    # The first of a cluster is an aggregate, which tasks begin before anything is moved; no window is over the positions of a cluster.
    first = lambda c, order: counts(c).groupBy("pid").agg(F.min(F.struct((-F.col("n")).alias("k"), order.alias("o"), F.col(c).alias("at"))).alias("b"))
    s = first("pos", F.abs("pos")).select("pid", F.col("b.at").alias("start_first"), (-F.col("b.k")).alias("n"))
    others = counts("pos").withColumnRenamed("n", "votes").join(s.drop("n"), "pid").where("abs(start_first - pos) > 2")
    second = others.groupBy("pid").agg(F.min(F.struct((-F.col("votes")).alias("k"), F.abs("pos").alias("o"), F.col("pos").alias("at"))).alias("b")).select("pid", F.when(F.col("b.k") <= -2, F.col("b.at")).alias("second"))
    m = first("mate_pos", -F.abs("mate_pos")).select("pid", F.col("b.at").alias("mate_first"))
    d = first("apart", F.abs("apart")).select("pid", F.col("b.at").alias("apart_first"))
    return s.join(m, "pid").join(d, "pid").join(second, "pid", "left")


def a22_chosen(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy choice of clusters by weight, each read used once."""
    return pack_sets(members(spark, folder), "cluster_id", "name", "weight", "chrom", "mate_chrom", "isize", "nm")


def a22_components(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters linked by shared reads, each group with its size."""
    return components(members(spark, folder), "cluster_id", "name").groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def w2_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """Newest open cluster that fits, for records of the plus strand."""
    rows = pairs(spark, folder).where("name is not null and len > 0")
    stats = group_stats(pairs(spark, folder)).withColumn("upper", F.col("median") + 3 * F.coalesce("sd", F.lit(0.0))).select("rg", "median", "sd", "upper")
    return assign_clusters(rows, stats, 3.0, 1_000)



INTRA_SQL = f"""with {MEMBERS_SQL}, {CLUSTERS_SQL}, one as (select * from cl where chrom = mate_chrom)
, pr as (select i.pid, k.pid as partner, i.chrom, i.t, i.s1 as is1, i.s2 as is2, i.m1 as im1, i.m2 as im2, k.s1 as ks1, k.s2 as ks2, k.m1 as km1, k.m2 as km2 from one i join one k on i.chrom = k.chrom and i.pid <> k.pid and ((i.t = 3 and k.t = 0) or (i.t = 1 and k.t = 2)))
, named as (
  select pid, partner, chrom, 'inssd' as rule, case when is1 - ks2 - 1 >= {READ_LEN} then 'del_inssd' else 'inssd' end as event, ks2 as start, is1 as "end", km1 as mate_start, im2 as mate_end, is1 - ks2 - 1 as deleted, im2 - km1 + 1 as inserted, km1 - is1 as distance from pr
  where t = 3 and ks1 < is1 and is1 <= greatest(ks2, km1) and least(ks2, km1) <= is2 and km1 <= greatest(is1, im2) and least(is1, im2) <= km2 and is1 <> ks2
  union all select pid, partner, chrom, 'inssu', case when km1 - im2 - 1 >= {READ_LEN} then 'del_inssu' else 'inssu' end, im2, km1, is1, ks2, km1 - im2 - 1, ks2 - is1 + 1, im2 - ks2 from pr
  where t = 3 and im2 < km2 and ks1 <= greatest(is1, im2) and least(is1, im2) <= ks2 and im1 <= greatest(ks2, km1) and least(ks2, km1) <= im2
  union all select pid, partner, chrom, 'invers', case when is2 - 10 <= ks1 + 10 and ks1 - {READ_LEN} <= is2 + {READ_LEN} and im2 - 10 <= km1 + 10 and km1 - {READ_LEN} <= im2 + {READ_LEN} then 'invers' else 'del_invers' end, is2, ks1, im2, km1, ks1 - is2 - 1, im2 - ks1, km1 - im2 from pr
  where t = 1 and is1 < ks1 and is2 < ks2 and im1 < km1 and im2 < km2 and ks1 <= greatest(is2, im2) and least(is2, im2) <= ks2 and im1 <= greatest(ks1, km1) and least(ks1, km1) <= im2
  union all select pid, partner, chrom, 'insod', case when ks1 - is2 - 1 >= {READ_LEN} then 'del_insod' else 'insod' end, is2, ks1, km1, im2, ks1 - is2 - 1, im2 - km1 + 1, km1 - ks1 from pr
  where t = 1 and is1 < ks1 and ks1 <= greatest(is2, im2) and least(is2, im2) <= ks2 and km1 <= greatest(is2, im2) and least(is2, im2) <= km2
  union all select pid, partner, chrom, 'insou', case when km1 - im2 - 1 >= {READ_LEN} then 'del_insou' else 'insou' end, im2, km1, ks1, is2, km1 - im2 - 1, is2 - ks1 + 1, im2 - is2 from pr
  where t = 1 and im2 < km2 and is1 <= greatest(ks1, km1) and least(ks1, km1) <= is2 and im1 <= greatest(ks1, km1) and least(ks1, km1) <= im2
), ev as (select * from named where abs(deleted) < {LARGEST} and abs(inserted) < {LARGEST})"""
_SMALL = f"""{INTRA_SQL}, r as (select *, row_number() over (partition by pid order by abs(deleted) + abs(inserted), rule, partner) as no from ev)
, t as (select *, bool_or(no = 1 and rule in ('insod', 'insou') and abs(deleted) < 20 and abs(inserted) < 20 and abs(distance) > 20) over (partition by pid) as small, min(case when rule = 'invers' then no end) over (partition by pid) as other from r where no <= 3)
, top as (select * from t where no = case when small and other is not null then other else 1 end)"""

SQL = {
    "a8_summaries": f"with {MEMBERS_SQL}, {CLUSTERS_SQL} select * from cl where support >= 2",
    "e8_singles": f"""with {MEMBERS_SQL}, {CLUSTERS_SQL}, x as (select *, case when chrom <> mate_chrom then 'transl_inter' when t = 0 and m1 - s2 - 1 > 0 then 'del' when t = 1 then 'invers_f' when t = 2 then 'invers_r' when t = 3 then 'tandem_dup' end as event from cl)
, y as (select pid, chrom, mate_chrom, event, case event when 'transl_inter' then case when t in (0, 1) then s2 else s1 end when 'del' then s2 when 'invers_f' then s2 else s1 end as start,
  case event when 'transl_inter' then case when t in (1, 3) then m2 else m1 end when 'del' then m1 when 'invers_r' then m1 else m2 end as "end",
  case event when 'del' then m1 - s2 - 1 when 'invers_f' then m2 - s2 when 'invers_r' then m1 - s1 when 'tandem_dup' then m1 - s1 end as size from x where event is not null)
select * from y where coalesce(size, 0) < {LARGEST}""",
    "e1_intra": f"{INTRA_SQL} select * exclude (distance) from ev",
    "o7_smallest": f"{_SMALL} select pid, partner, event, deleted, inserted from top",
    "a8_breakpoint_fold": f"""with recursive {MEMBERS_SQL}, st as (select rg, cast(ceil(quantile_cont(abs(isize), 0.5) + 3 * coalesce(stddev_samp(abs(isize)), 0)) as bigint) as isu from members where isize is not null and rg is not null and abs(isize) <= {MAX_ISIZE} group by rg)
, rg_ as (select cluster_id, pos, mate_pos, name, case when strand = 1 then pos + len - 10 else pos + len - isu + mate_len end as a0, case when strand = 1 then pos + isu - mate_len else pos + 10 end as b0,
    case when mate_strand = 1 then mate_pos + mate_len - 10 else mate_pos + mate_len - isu + len end as a1, case when mate_strand = 1 then mate_pos + isu - len else mate_pos + 10 end as b1
  from members join st using (rg) where chrom is not null and pos is not null and mate_pos is not null and len is not null and mate_len is not null and strand in (1, -1) and mate_strand in (1, -1))
, no_ as materialized (select *, row_number() over (partition by cluster_id order by pos, mate_pos, name nulls first, a0, b0, a1, b1) as no, count(*) over (partition by cluster_id) as n from rg_)
, f as (select cluster_id, no, n, a0, b0, a1, b1 from no_ where no = 1
  union all select x.cluster_id, x.no, x.n,
    case when (f.a0 = 0 and f.b0 = 0) or (f.a0 = -1 and f.b0 = -1) then x.a0 when greatest(x.a0, f.a0) > least(x.b0, f.b0) then 0 else greatest(x.a0, f.a0) end, case when (f.a0 = 0 and f.b0 = 0) or (f.a0 = -1 and f.b0 = -1) then x.b0 when greatest(x.a0, f.a0) > least(x.b0, f.b0) then 0 else least(x.b0, f.b0) end,
    case when (f.a1 = 0 and f.b1 = 0) or (f.a1 = -1 and f.b1 = -1) then x.a1 when greatest(x.a1, f.a1) > least(x.b1, f.b1) then 0 else greatest(x.a1, f.a1) end, case when (f.a1 = 0 and f.b1 = 0) or (f.a1 = -1 and f.b1 = -1) then x.b1 when greatest(x.a1, f.a1) > least(x.b1, f.b1) then 0 else least(x.b1, f.b1) end
  from f join no_ x on x.cluster_id = f.cluster_id and x.no = f.no + 1)
select cluster_id, a0, b0, a1, b1, n from f where no = n and not (a0 = 0 and b0 = 0) and not (a1 = 0 and b1 = 0)""",
    "a22_components": f"""with recursive {MEMBERS_SQL}, ed as materialized (select distinct cluster_id as c, name as r from members where cluster_id is not null and name is not null), nodes as (select distinct cluster_id as c from members where cluster_id is not null)
, lab(c, l) using key (c) as (select c, c as l from nodes union (select ed.c, min(m.l) from (select ed.r, min(x.l) as l from lab x join ed on ed.c = x.c group by ed.r) m join ed on ed.r = m.r join recurring.lab y on y.c = ed.c where m.l < y.l group by ed.c))
select component, count(*) as n from (select c, min(l) as component from lab group by c) group by component""",
    "a17_votes": f"""with {MEMBERS_SQL}, m as (select pid, pos, mate_pos, mate_pos - pos as apart from members where pos is not null and mate_pos is not null)
, a as (select pid, pos, count(*) as n from m group by all), b as (select pid, mate_pos, count(*) as n from m group by all), d as (select pid, apart, count(*) as n from m group by all)
, ra as (select *, row_number() over (partition by pid order by n desc, abs(pos), pos) as no from a), rb as (select *, row_number() over (partition by pid order by n desc, abs(mate_pos) desc, mate_pos) as no from b), rd as (select *, row_number() over (partition by pid order by n desc, abs(apart), apart) as no from d)
, f as (select pid, pos as start_first, n from ra where no = 1), s as (select ra.pid, ra.pos, ra.n, row_number() over (partition by ra.pid order by ra.no) as k from ra join f using (pid) where abs(f.start_first - ra.pos) > 2)
select f.pid, start_first, f.n, mate_pos as mate_first, apart as apart_first, case when s.n >= 2 then s.pos end as second from f join rb on rb.pid = f.pid and rb.no = 1 join rd on rd.pid = f.pid and rd.no = 1 left join s on s.pid = f.pid and s.k = 1""",
    "e13_demoted": f"""{_SMALL}, e as (select *, (abs(deleted) + abs(inserted), rule, pid, partner) as key from top)
, claims as (select pid as c, key from e union all select partner, key from e), best as (select c, min(key) as best from claims group by c)
, held as (select e.*, e.key = a.best as w1, e.key = b.best as w2 from e join best a on a.c = e.pid join best b on b.c = e.partner)
select pid, partner, event, start, "end", 'kept' as state from held where w1 and w2
union all select pid, partner, case when rule in ('inssd', 'inssu') then case when w2 then 'del' else 'tandem_dup' end else case when w2 then 'invers_r' else 'invers_f' end end,
  case rule when 'inssd' then case when w2 then start else "end" end when 'inssu' then case when w2 then mate_end else mate_start end when 'insod' then case when w2 then "end" else start end when 'insou' then case when w2 then mate_start else mate_end end else case when w2 then "end" else start end end,
  case rule when 'inssd' then case when w2 then mate_start else mate_end end when 'inssu' then case when w2 then "end" else start end when 'insod' then case when w2 then mate_start else mate_end end when 'insou' then case when w2 then "end" else start end else case when w2 then mate_end else mate_start end end, 'demoted' from held where w1 <> w2""",
}

QUERIES = {f.__name__: f for f in (a8_summaries, a8_breakpoint_fold, e8_singles, e1_intra, o7_smallest, e13_demoted, a17_votes, a22_chosen, a22_components, w2_assigned)}
