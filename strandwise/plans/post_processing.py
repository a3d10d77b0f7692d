"""Contig rules, regions, selections by id and the formats built of clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.operators.intervals import overlap_join
from strandwise.operators.regions import demoted_name, first_of, insertion_orientation, is_orphan, is_transduction, merge_regions, widen
from strandwise.plans.events_queries import SQL as EVENT_SQL
from strandwise.plans.events_queries import e8_singles, smallest_intra
from strandwise.plans.records import MEMBERS_SQL, PAIRS_SQL, members, pairs
from strandwise.runtime import checkpointed
from strandwise.sources.sinks import discord_bed, event_lines

DELTA = 110


def f24_complete(spark: SparkSession, folder: str) -> DataFrame:
    """members with weight and mismatches on both sides and all names known."""
    rows = members(spark, folder)
    return rows.where("weight <> 0 and nm <> 0 and length(name) > 0 and length(rg) > 0 and length(chrom) > 0 and length(mate_chrom) > 0").select("cluster_id", "name", "pos", "mate_pos")


def f26_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans, transductions and the rest; known lengths, sizes and mismatches stand for the four alignments, no mismatch for a poly tail."""
    rows = members(spark, folder).where("chrom is not null and pos is not null and name is not null and nm is not null")
    known = [F.col("len").isNotNull(), F.col("mate_len").isNotNull(), F.col("isize").isNotNull(), F.col("nm") >= 2]
    poly = F.col("nm") == 0
    orphan = is_orphan(poly, *known)
    rows = rows.withColumns({"orphan": orphan, "trans": is_transduction(poly, orphan, *known)})
    kind = F.when(F.col("orphan"), "orphan").when(F.col("trans"), "transduction").otherwise("post")
    return rows.groupBy("chrom", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("reads"))


def a18_longest(spark: SparkSession, folder: str) -> DataFrame:
    """The longest record of each chromosome, the first of equal ones."""
    rows = pairs(spark, folder).where("chrom is not null and len is not null")
    return rows.groupBy("chrom").agg(F.min_by("id", F.struct(-F.col("len"), F.col("id"))).alias("id"), F.max("len").alias("len"))


def a20_furthest(spark: SparkSession, folder: str) -> DataFrame:
    """The largest position of each cluster and secondary cluster at both ends."""
    return members(spark, folder).groupBy("pid", "sid").agg(F.max("pos").alias("pos"), F.max("mate_pos").alias("mate_pos"))


def a21_rescued(spark: SparkSession, folder: str) -> DataFrame:
    """Reads in more than one unordered pair of chromosomes, and whether their orientations are half as many as their members."""
    rows = members(spark, folder).where("name is not null and chrom is not null and mate_chrom is not null")
    pair = F.struct(F.least("chrom", "mate_chrom"), F.greatest("chrom", "mate_chrom"))
    per = rows.groupBy("name").agg(F.count_distinct(pair).alias("pairs"), F.count_distinct(F.struct("chrom", "mate_chrom", "strand", "mate_strand")).alias("ways"), F.count(F.lit(1)).alias("n"))
    return per.where("pairs > 1").select("name", "pairs", (2 * F.col("ways") == F.col("n")).alias("rescued"))


def j21_orientation(spark: SparkSession, folder: str) -> DataFrame:
    """The insertion orientation of each primary cluster and its first secondary one, in order of position at both ends."""
    rows = members(spark, folder).where("pos is not null and mate_pos is not null and strand in (1, -1) and mate_strand in (1, -1)")
    per = rows.groupBy("pid", "sid").agg(F.max("pos").alias("p"), F.max("mate_pos").alias("m"), F.max("strand").alias("s"), F.max("mate_strand").alias("t"))
    a, b = per.where("sid = 0"), per.where("sid = 1").select("pid", F.col("p").alias("p2"), F.col("m").alias("m2"), F.col("s").alias("s2"), F.col("t").alias("t2"))
    sign = lambda c: F.when(F.col(c) == 1, "+").otherwise("-")
    order = lambda x, y, s, t: F.when(F.col(x) < F.col(y), F.concat(sign(s), sign(t))).otherwise(F.concat(sign(t), sign(s)))
    both = a.join(b, "pid").select("pid", order("p", "p2", "s", "s2").alias("first"), order("m", "m2", "t", "t2").alias("second"))
    return both.select("pid", "first", "second", insertion_orientation(F.col("first"), F.col("second")).alias("orientation"))


def j22_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Members of clusters that have an event alone, of at least 100 bases, numbered in their cluster."""
    chosen = e8_singles(spark, folder).where("event = 'del'").select("pid").distinct()
    rows = members(spark, folder).where("len >= 100 and name is not null").join(chosen, "pid", "left_semi")
    per = rows.groupBy("pid", "name").agg(F.min("pos").alias("pos"))
    return per.withColumn("no", F.row_number().over(Window.partitionBy("pid").orderBy("pos", "name")))


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = members(spark, folder).where("chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null")
    per = rows.groupBy("pid", "sid", "chrom", F.col("mate_chrom").alias("mchrom")).agg(F.count_distinct("name").alias("support"), F.min("pos").alias("pos"), F.min("mate_pos").alias("mpos"), F.max("strand").alias("strand"), F.max("mate_strand").alias("mstrand"))
    return discord_bed(per)


def k8_discord_bed(spark: SparkSession, folder: str) -> DataFrame:
    """Windows around both ends of supported clusters."""
    return _windows(spark, folder)


def j16_both_ends(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters of another name whose windows a cluster's windows overlap at both ends, either way round, whatever their strands; windows are open at their end."""
    w = checkpointed(_windows(spark, folder))
    name = F.concat_ws("~", "pid", "sid")
    a = w.select(name.alias("name"), "chrom1", "start1", (F.col("end1") - 1).alias("last1"), "chrom2", "start2", (F.col("end2") - 1).alias("last2"))
    ways = a.unionByName(a.selectExpr("name", "chrom2 as chrom1", "start2 as start1", "last2 as last1", "chrom1 as chrom2", "start1 as start2", "last1 as last2"))
    b = a.select(*[F.col(c).alias(f"o_{c}") for c in a.columns])
    hits = overlap_join(ways, b, [("chrom1", "o_chrom1"), ("chrom2", "o_chrom2")], ("start1", "last1"), ("o_start1", "o_last1")).where("name <> o_name and start2 <= o_last2 and o_start2 <= last2")
    return hits.groupBy("name").agg(F.count_distinct("o_name").alias("n"), F.min("o_name").alias("first"))


def k4_event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """K4: one text for each event that an anchor settles for."""
    return event_lines(smallest_intra(spark, folder))


def e15_split_demotion(spark: SparkSession, folder: str) -> DataFrame:
    """How many of each event there are, and what it becomes when it loses."""
    return smallest_intra(spark, folder).groupBy("event").agg(F.count(F.lit(1)).alias("n")).withColumn("becomes", demoted_name(F.col("event")))


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    rows = members(spark, folder).where("chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null and len is not null and mate_len is not null")
    per = rows.groupBy("cluster_id", "chrom", "mate_chrom").agg(F.min("pos").alias("a1"), F.max(F.col("pos") + F.col("len")).alias("a2"), F.min("mate_pos").alias("b1"), F.max(F.col("mate_pos") + F.col("mate_len")).alias("b2"))
    return first_of(widen(per, [("a1", "a2"), ("b1", "b2")], DELTA), "cluster_id", "chrom", "mate_chrom", "a1", "b1")


_REGIONS = f"""per as (select cluster_id, chrom, mate_chrom, greatest(min(pos) - {DELTA}, 0) as a1, max(pos + len) + {DELTA} as a2, greatest(min(mate_pos) - {DELTA}, 0) as b1, max(mate_pos + mate_len) + {DELTA} as b2 from members
  where chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null and len is not null and mate_len is not null group by cluster_id, chrom, mate_chrom)
, regions as (select * exclude (r) from (select *, row_number() over (partition by cluster_id order by chrom, mate_chrom, a1, b1) as r from per) where r = 1)"""


def r3_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The widened region of each cluster, the first one if it has several."""
    return _regions(spark, folder)


def w9_merged_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions that overlap at both halves, merged until none do."""
    return merge_regions(_regions(spark, folder).withColumnRenamed("cluster_id", "id"))


def r1_read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Reads with records on both strands, on one only (orphans), or without a place, by read group."""
    rows = pairs(spark, folder).where("name is not null")
    per = rows.groupBy("name").agg(F.count_if(F.col("strand") == 1).alias("p"), F.count_if(F.col("strand") == -1).alias("m"), F.min("rg").alias("rg"), F.count_if(F.col("chrom").isNull() | F.col("mate_chrom").isNull()).alias("lost"))
    kind = F.when(F.col("lost") > 0, "unplaced").when((F.col("p") > 0) & (F.col("m") > 0), "paired").otherwise("orphan")
    return per.groupBy("rg", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def r7_other_mates(spark: SparkSession, folder: str) -> DataFrame:
    """Of the records of a member's read those that stand elsewhere than the member."""
    m = members(spark, folder).where("name is not null and pos is not null").select("cluster_id", "name", F.col("pos").alias("at")).distinct()
    rows = pairs(spark, folder).where("name is not null and pos is not null").groupBy("name", "pos").agg(F.min("id").alias("id"))
    # One row a read in place of a row for each of its positions: how many there are, and the two positions with the least ids, of which one at most is the member's.
    least = rows.groupBy("name").agg(F.count(F.lit(1)).alias("all"), F.min(F.struct("id", "pos")).alias("one"))
    second = rows.join(least.select("name", F.col("one.pos").alias("pos")), ["name", "pos"], "left_anti").groupBy("name").agg(F.min("id").alias("two"))
    own = m.join(rows.select("name", F.col("pos").alias("at"), F.lit(1).alias("here")), ["name", "at"], "left")
    met = own.join(least.join(second, "name", "left"), "name")
    others = F.col("all") - F.coalesce("here", F.lit(0))
    first = F.when(F.col("one.pos") != F.col("at"), F.col("one.id")).otherwise(F.col("two"))
    return met.where(others > 0).groupBy("cluster_id").agg(F.sum(others).alias("n"), F.min(first).alias("first"))


_BED = f"""with {MEMBERS_SQL}, p as (select pid, sid, chrom, mate_chrom, count(distinct name) as support, min(pos) as pos, min(mate_pos) as mpos, max(strand) as strand, max(mate_strand) as mstrand from members where chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null group by pid, sid, chrom, mate_chrom)
, bed as (select chrom as chrom1, greatest(pos - 1000, 0) as start1, pos + 1000 as end1, mate_chrom as chrom2, greatest(mpos - 1000, 0) as start2, mpos + 1000 as end2, pid, sid, case when strand = 1 then '+' else '-' end as strand1, case when mstrand = 1 then '+' else '-' end as strand2
  from p where support >= 3 and not starts_with(chrom, 'GL') and not starts_with(mate_chrom, 'GL') and (chrom <> mate_chrom or abs(mpos - pos) > 10000 or mpos = pos))"""
_SMALL = EVENT_SQL["o7_smallest"].rsplit("select", 1)[0]

SQL = {
    "f24_complete": f"with {MEMBERS_SQL} select cluster_id, name, pos, mate_pos from members where weight <> 0 and nm <> 0 and length(name) > 0 and length(rg) > 0 and length(chrom) > 0 and length(mate_chrom) > 0",
    "f26_orphans": f"""with {MEMBERS_SQL}, k as (select *, len is not null as a, mate_len is not null as b, isize is not null as c, nm >= 2 as d, nm = 0 as poly from members where chrom is not null and pos is not null and name is not null and nm is not null)
, o as (select *, case when poly then a or b or c or d else (c and d) or ((a or b) and (c or d)) end as orphan, a::int + b::int + c::int + d::int as n from k)
select chrom, case when orphan then 'orphan' when n <> 4 and poly then 'transduction' else 'post' end as kind, count(*) as n, count(distinct name) as reads from o group by 1, 2""",
    "a18_longest": f"with {PAIRS_SQL} select chrom, id, len from (select chrom, id, len, row_number() over (partition by chrom order by len desc, id) as r from pairs where chrom is not null and len is not null) where r = 1",
    "a20_furthest": f"with {MEMBERS_SQL} select pid, sid, max(pos) as pos, max(mate_pos) as mate_pos from members group by pid, sid",
    "a21_rescued": f"""with {MEMBERS_SQL}, p as (select name, count(distinct (least(chrom, mate_chrom), greatest(chrom, mate_chrom))) as pairs, count(distinct (chrom, mate_chrom, strand, mate_strand)) as ways, count(*) as n from members where name is not null and chrom is not null and mate_chrom is not null group by name)
select name, pairs, 2 * ways = n as rescued from p where pairs > 1""",
    "j21_orientation": f"""with {MEMBERS_SQL}, per as (select pid, sid, max(pos) as p, max(mate_pos) as m, case when max(strand) = 1 then '+' else '-' end as s, case when max(mate_strand) = 1 then '+' else '-' end as t from members where pos is not null and mate_pos is not null and strand in (1, -1) and mate_strand in (1, -1) group by pid, sid)
, b as (select a.pid, case when a.p < c.p then a.s || c.s else c.s || a.s end as first, case when a.m < c.m then a.t || c.t else c.t || a.t end as second from per a join per c on a.pid = c.pid and a.sid = 0 and c.sid = 1)
select *, case when first = '+-' and second = '-+' then '1 no' when first = '-+' and second = '+-' then '2 no' when first = '+-' and second in ('--', '++') then '1 inv' when first in ('--', '++') and second = '+-' then '2 inv' end as orientation from b""",
    "j22_selected": EVENT_SQL["e8_singles"].replace("select * from y where", ", sv as (select * from y where")
    + """), per as (select pid, name, min(pos) as pos from members where len >= 100 and name is not null and pid in (select pid from sv where event = 'del') group by pid, name)
select pid, name, pos, cast(row_number() over (partition by pid order by pos nulls first, name) as int) as no from per""",
    "k8_discord_bed": _BED + " select * from bed",
    "j16_both_ends": _BED + """, n as (select pid || '~' || sid as name, * from bed), w as (select name, chrom1, start1, end1, chrom2, start2, end2 from n union all select name, chrom2, start2, end2, chrom1, start1, end1 from n)
select w.name, count(distinct o.name) as n, min(o.name) as first from w join n o on w.name <> o.name and w.chrom1 = o.chrom1 and w.chrom2 = o.chrom2 and w.start1 < o.end1 and o.start1 < w.end1 and w.start2 < o.end2 and o.start2 < w.end2 group by w.name""",
    "k4_event_lines": _SMALL + """select event || chr(9) || pid || '/' || partner || chr(9) || chrom || chr(9) || start || chr(9) || "end" || chr(9) || ("end" - start) as line from top where start <> 0 and "end" <> 0""",
    "e15_split_demotion": _SMALL + "select event, count(*) as n, case when event = 'del_invers' then 'invers_f' when replace(event, 'del_', '') in ('inssd', 'inssu') then 'tandem_dup' when replace(event, 'del_', '') in ('insod', 'insou') then 'invers_f' else event end as becomes from top group by event",
    "r3_regions": f"with {MEMBERS_SQL}, {_REGIONS} select * from regions",
    "r1_read_pairs": f"""with {PAIRS_SQL}, p as (select name, count(*) filter (strand = 1) as p, count(*) filter (strand = -1) as m, min(rg) as rg, count(*) filter (chrom is null or mate_chrom is null) as lost from pairs where name is not null group by name)
select rg, case when lost > 0 then 'unplaced' when p > 0 and m > 0 then 'paired' else 'orphan' end as kind, count(*) as n from p group by 1, 2""",
    "r7_other_mates": f"""with {MEMBERS_SQL}, {PAIRS_SQL}, m as (select distinct cluster_id, name, pos as here from members where name is not null and pos is not null), r as (select name, pos, min(id) as id from pairs where name is not null and pos is not null group by name, pos)
select cluster_id, count(*) as n, min(id) as first from m join r using (name) where pos <> here group by cluster_id""",
}

QUERIES = {f.__name__: f for f in (f24_complete, f26_orphans, a18_longest, a20_furthest, a21_rescued, j21_orientation, j22_selected, k8_discord_bed, j16_both_ends, k4_event_lines, e15_split_demotion, r3_regions, w9_merged_regions, r1_read_pairs, r7_other_mates)}
