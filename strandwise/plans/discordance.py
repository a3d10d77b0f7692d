"""Discordant pairs, blacklists, duplicates and the statistics of read groups, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.operators.carry import running
from strandwise.operators.classify import DISCORDANT, blacklist_anti, discordance, insert_size, is_concordant, strand_type
from strandwise.operators.coverage import coverage
from strandwise.plans.records import MEMBERS_SQL, PAIRS_SQL, STATS_SQL, group_stats, members, pairs

N_SD = 3.0
DEPTH = 2
PILE = 5


def _reasoned(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs(spark, folder)
    rows = rows.join(group_stats(rows).select("rg", "median", "sd"), "rg", "left")
    mapped = F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("mate_chrom").isNotNull() & F.col("mate_pos").isNotNull()
    return rows.withColumn("reason", discordance(F.col("name").isNotNull(), mapped, "chrom", "pos", "strand", "mate_chrom", "mate_pos", "mate_strand", "isize", "median", "sd", N_SD))


_REASON_SQL = (
    PAIRS_SQL
    + ", "
    + STATS_SQL
    + """, reasoned as (
  select p.*, s.median, s.sd, case
    when not (name is not null) then 'not_paired'
    when not (chrom is not null and pos is not null and mate_chrom is not null and mate_pos is not null) then 'not_both_mapped'
    when pos = mate_pos and chrom = mate_chrom then 'same_position'
    when chrom <> mate_chrom then 'other_chromosome'
    when strand = mate_strand then 'same_strand'
    when (strand < 0 and isize > 0) or (strand > 0 and isize < 0) then 'wrong_sign'
    when abs(isize) > ceil(median + 3.0 * sd) then 'large_insert'
    else 'concordant' end as reason
  from pairs p left join stats s using (rg)
)"""
)


def f1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs each reason settles; the sum is the number of rows."""
    return _reasoned(spark, folder).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _blacklist(rows: DataFrame) -> DataFrame:
    """Positions on which so many records begin."""
    return rows.where("chrom is not null and pos is not null").groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PILE).select("chrom", "pos")


def f4_discordant(spark: SparkSession, folder: str) -> DataFrame:
    """Discordant by reason or by name, no mate on the blacklist, of a read group with statistics."""
    rows = _reasoned(spark, folder)
    memo = rows.where(F.col("reason").isin("other_chromosome", "same_strand") & (F.col("nm") >= 3) & F.col("name").isNotNull()).select("name").distinct()
    # Only records that the reason alone leaves open are looked up by name.
    known, by_reason = rows.where("median is not null"), F.col("reason").isin(*DISCORDANT)
    kept = known.where(by_reason).unionByName(known.where(~by_reason).join(memo, "name", "left_semi").select(*known.columns))
    return blacklist_anti(kept, _blacklist(pairs(spark, folder)), "chrom", "pos", "mate_chrom", "mate_pos").select("id", "name", "chrom", "pos", "reason")


def f7_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Where records of known length cover a position at least so often, as half-open ranges."""
    steps = coverage(pairs(spark, folder).where("chrom is not null and nm is not null"), ["chrom"], "pos", "len")
    # The end of a range is where the depth changes next; a lead inside cells, carried as a running minimum from the right, is the mirror image of a running maximum.
    mirrored = steps.withColumns({"at": -F.col("pos"), "neg": -F.col("pos")})
    ended = running(mirrored, ["chrom"], "at", "neg", "next", "max", inclusive=False)
    return ended.where(F.col("depth") >= DEPTH).select("chrom", F.col("pos").alias("start"), (-F.col("next")).alias("stop"), "depth")


def f15_point_blacklist(spark: SparkSession, folder: str) -> DataFrame:
    """Mates of few mismatches, neither on a listed point nor 40 right of one."""
    rows = pairs(spark, folder).where("nm <= 4 and mate_nm <= 4")
    return blacklist_anti(rows, _blacklist(pairs(spark, folder)), "chrom", "pos", "mate_chrom", "mate_pos", 40).select("id")


def f16_not_concordant(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs left after the concordant ones go, with the size that their orientation gives."""
    rows = pairs(spark, folder)
    bounds = group_stats(rows).select("rg", F.ceil(F.col("median") + N_SD * F.col("sd")).alias("upper"))
    rows = rows.join(bounds, "rg")
    size = F.when(F.col("chrom") == F.col("mate_chrom"), insert_size("strand", "mate_strand", "pos", "mate_pos", "mate_len"))
    rows = rows.withColumn("oriented", size)
    keep = ~F.coalesce(is_concordant("chrom", "mate_chrom", "strand", "mate_strand", "oriented", "upper"), F.lit(False))
    return rows.where(keep).select("id", "oriented", strand_type("strand", "mate_strand").alias("kind"))


def f17_multiplicity(spark: SparkSession, folder: str) -> DataFrame:
    """Reads with at most 20 mappings, and the weight 1 / (mappings + 1)."""
    rows = pairs(spark, folder).where("name is not null")
    counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n <= 20")
    return counts.select("name", "n", (F.lit(1.0) / (F.col("n") + 1)).alias("weight"))


def a1_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """A1: length, count, fraction."""
    counts = pairs(spark, folder).where("len is not null").groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a length


def a2_basic(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a file in one row."""
    rows = pairs(spark, folder)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("chrom").isNull() | F.col("pos").isNull()).alias("unmapped"), F.count_if(F.col("nm").isNull()).alias("unknown"), F.max("len").alias("max_len"), F.min("len").alias("min_len"))


def a2_characters(spark: SparkSession, folder: str) -> DataFrame:
    """A2: histogram of the characters of a text column, as of qualities."""
    chars = pairs(spark, folder).where("name is not null").select(F.explode(F.split("name", "")).alias("c")).where("c <> ''")
    return chars.groupBy(F.ascii("c").alias("code")).agg(F.count(F.lit(1)).alias("n"))


# Quality encodings and the codes that they use; the second table is that of the insertion pipeline, where all end at 126.
ENCODINGS = (("sanger", 33, 73), ("solexa", 59, 104), ("illumina13", 64, 104), ("illumina15", 66, 104))
WIDE_ENCODINGS = (("sanger", 33, 126), ("solexa", 59, 126), ("illumina13", 64, 126), ("illumina15", 66, 126))


def a3_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """A3: of the encodings whose range holds all codes, the one whose ends are nearest; of equal ones, and if none holds them, the first; by both tables of ranges. The codes of a read group and length are its lengths and mismatches, moved into the range of characters."""
    codes = pairs(spark, folder).where("rg is not null and nm is not null and len > 0").select("rg", F.expr("len div 10").alias("tens"), (F.col("nm") + 33 + F.expr("len div 10") * 3).alias("code"))
    seen = codes.groupBy("rg", "tens").agg(F.min("code").alias("low"), F.max("code").alias("high"))
    out = seen
    for name, table in (("encoding", ENCODINGS), ("wide", WIDE_ENCODINGS)):
        fits = F.array(*[F.when((F.col("low") >= a) & (F.col("high") <= b), F.struct((F.abs(F.col("low") - a) + F.abs(F.col("high") - b)).alias("d"), F.lit(i).alias("ord"), F.lit(e).alias("e"))) for i, (e, a, b) in enumerate(table)])
        out = out.withColumn(name, F.coalesce(F.array_min(F.filter(fits, lambda x: x.isNotNull())).getField("e"), F.lit(table[0][0])))
    return out


def a4_insert_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, median and sample deviation of the first 1,000 positive sizes of each read group."""
    rows = pairs(spark, folder).where("isize > 0 and isize <= 10000 and rg is not null")
    first = rows.withColumn("no", F.row_number().over(Window.partitionBy("rg").orderBy("id"))).where("no <= 1000")
    return first.groupBy("rg").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("isize"), 6).alias("mean"), F.percentile("isize", 0.5).alias("median"), F.round(F.stddev_samp("isize"), 6).alias("sd"))


def a6_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and population deviation of the mismatches of each chromosome."""
    return pairs(spark, folder).where("nm is not null").groupBy("chrom").agg(F.round(F.avg("nm"), 9).alias("mean"), F.round(F.stddev_pop("nm"), 9).alias("sd"))


def a9_support(spark: SparkSession, folder: str) -> DataFrame:
    """Supporting reads of a cluster after the suffix of a part of a read is gone, and those of full length; secondary clusters of a primary one overwrite in the order of their ids."""
    rows = members(spark, folder).where("name is not null")
    stem = F.regexp_replace("name", "(mu1|mu2|sc)$", "")
    per = rows.groupBy("pid", "sid").agg(F.count_distinct(stem).alias("support"), F.count_distinct(F.when(F.col("len") >= 50, F.col("name"))).alias("full"))
    return per.groupBy("pid").agg(F.max_by("support", "sid").alias("support"), F.max_by("full", "sid").alias("full")).where("support >= 2 and full >= 1")


def w3_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Of pairs at the same two ends the first; ends in canonical order, with their strands as signs."""
    rows = pairs(spark, folder).where("chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null")
    a, b = F.struct(F.col("chrom").alias("c"), (F.col("pos") * F.col("strand")).alias("p")), F.struct(F.col("mate_chrom").alias("c"), (F.col("mate_pos") * F.col("mate_strand")).alias("p"))
    ends = rows.select("id", F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    return ends.groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "copies")


def w4_best_of_same(spark: SparkSession, folder: str) -> DataFrame:
    """Of records at one signed position the one with fewest mismatches, then the longest, then the first."""
    rows = pairs(spark, folder).where("chrom is not null and pos is not null")
    best = F.min_by("id", F.struct(F.col("nm").isNull(), "nm", -F.coalesce("len", F.lit(-1)), "id"))
    return rows.groupBy("chrom", (F.col("pos") * F.col("strand")).alias("signed")).agg(best.alias("id"))


def w6_first_of_name(spark: SparkSession, folder: str) -> DataFrame:
    """The first member of each read in a cluster, whatever part of the read it is."""
    stem = F.regexp_replace("name", "(mu1|mu2|sc)$", "")
    rows = members(spark, folder).where("name is not null")
    return rows.groupBy("cluster_id", stem.alias("stem")).agg(F.min(F.struct("pos", "mate_pos")).alias("f")).select("cluster_id", "stem", "f.pos", "f.mate_pos")


def j1_mates(spark: SparkSession, folder: str) -> DataFrame:
    """The longest record of each read on either strand, and the pairs of the two."""
    rows = pairs(spark, folder).where("name is not null")
    best = lambda s: rows.where(f"strand = {s}").groupBy("name").agg(F.min(F.struct((-F.coalesce("len", F.lit(-1))).alias("l"), "id")).alias("b")).select("name", F.col("b.id").alias("id"))
    return best(1).withColumnRenamed("id", "plus_id").join(best(-1).withColumnRenamed("id", "minus_id"), "name")


SQL = {
    "f1_reasons": "with " + _REASON_SQL + " select reason, count(*) as n from reasoned group by reason",
    "f4_discordant": "with "
    + _REASON_SQL
    + """, memo as (select distinct name from reasoned where reason in ('other_chromosome', 'same_strand') and nm >= 3)
, black as (select chrom, pos from pairs where chrom is not null and pos is not null group by chrom, pos having count(*) >= 5)
select id, name, chrom, pos, reason from reasoned r where median is not null
  and (reason in ('other_chromosome', 'same_strand', 'wrong_sign', 'large_insert') or exists (select 1 from memo m where m.name = r.name))
  and not exists (select 1 from black b where b.chrom = r.chrom and b.pos = r.pos) and not exists (select 1 from black b where b.chrom = r.mate_chrom and b.pos = r.mate_pos)""",
    "f7_coverage": "with "
    + PAIRS_SQL
    + """, d as (select chrom, pos, 1 as d from pairs where chrom is not null and nm is not null and pos is not null and len > 0
  union all select chrom, pos + len, -1 from pairs where chrom is not null and nm is not null and pos is not null and len > 0)
, steps as (select chrom, pos, sum(d) as d from d group by chrom, pos)
, runs as (select chrom, pos as start, lead(pos) over (partition by chrom order by pos) as stop, cast(sum(d) over (partition by chrom order by pos) as bigint) as depth from steps)
select * from runs where depth >= 2""",
    "f15_point_blacklist": "with "
    + PAIRS_SQL
    + """, black as (select chrom, pos from pairs where chrom is not null and pos is not null group by chrom, pos having count(*) >= 5)
select id from pairs p where nm <= 4 and mate_nm <= 4
  and not exists (select 1 from black b where b.chrom = p.chrom and b.pos = p.pos) and not exists (select 1 from black b where b.chrom = p.chrom and b.pos = p.pos + 40)
  and not exists (select 1 from black b where b.chrom = p.mate_chrom and b.pos = p.mate_pos) and not exists (select 1 from black b where b.chrom = p.mate_chrom and b.pos = p.mate_pos + 40)""",
    "f16_not_concordant": "with "
    + PAIRS_SQL
    + ", "
    + STATS_SQL
    + """, o as (select p.*, ceil(median + 3.0 * sd) as upper, case when chrom = mate_chrom then case when strand = mate_strand then abs(pos - mate_pos) + 1 when strand = 1 then abs(pos - mate_pos) + mate_len else abs(pos - mate_pos) - mate_len + 2 end end as oriented
  from pairs p join stats using (rg))
select id, oriented, case when strand = 1 and mate_strand <> 1 then 0 when strand = 1 and mate_strand = 1 then 1 when strand <> 1 and mate_strand <> 1 then 2 when strand <> 1 and mate_strand = 1 then 3 end as kind
from o where not coalesce(chrom = mate_chrom and strand = 1 and mate_strand = -1 and oriented <= upper, false)""",
    "f17_multiplicity": "select read_name as name, count(*) as n, 1.0::double / (count(*) + 1) as weight from alt_map where read_name is not null group by read_name having count(*) <= 20",
    "a1_lengths": "with " + PAIRS_SQL + " select len, count(*) as n, count(*)::double / sum(count(*)) over () as fraction from pairs where len is not null group by len",
    "a2_basic": "with " + PAIRS_SQL + " select count(*) as total, count(*) filter (chrom is null or pos is null) as unmapped, count(*) filter (nm is null) as unknown, max(len) as max_len, min(len) as min_len from pairs",
    "a2_characters": "select ascii(c) as code, count(*) as n from (select unnest(string_split(read_name, '')) as c from alt_map where read_name is not null) where c <> '' group by 1",
    "a3_encoding": "with "
    + PAIRS_SQL
    + """, seen as (select rg, len // 10 as tens, min(nm + 33 + len // 10 * 3) as low, max(nm + 33 + len // 10 * 3) as high from pairs where rg is not null and nm is not null and len > 0 group by all)
, dim(ord, name, a, b, c) as (values (0, 'sanger', 33, 73, 126), (1, 'solexa', 59, 104, 126), (2, 'illumina13', 64, 104, 126), (3, 'illumina15', 66, 104, 126))
select rg, tens, low, high, coalesce((select name from dim where a <= low and high <= b order by abs(low - a) + abs(b - high), ord limit 1), 'sanger') as encoding, coalesce((select name from dim where a <= low and high <= c order by abs(low - a) + abs(c - high), ord limit 1), 'sanger') as wide from seen""",
    "a4_insert_stats": "with "
    + PAIRS_SQL
    + """, f as (select *, row_number() over (partition by rg order by id) as no from pairs where isize > 0 and isize <= 10000 and rg is not null)
select rg, count(*) as n, round(avg(isize), 6) as mean, quantile_cont(isize, 0.5) as median, round(stddev_samp(isize), 6) as sd from f where no <= 1000 group by rg""",
    "a6_moments": "with " + PAIRS_SQL + " select chrom, round(avg(nm), 9) as mean, round(stddev_pop(nm), 9) as sd from pairs where nm is not null group by chrom",
    "a9_support": "with "
    + MEMBERS_SQL
    + """, per as (select pid, sid, count(distinct regexp_replace(name, '(mu1|mu2|sc)$', '')) as support, count(distinct case when len >= 50 then name end) as "full" from members where name is not null group by pid, sid)
, l as (select *, row_number() over (partition by pid order by sid desc) as r from per)
select pid, support, "full" from l where r = 1 and support >= 2 and "full" >= 1""",
    "w3_duplicates": "with "
    + PAIRS_SQL
    + """, e as (select id, chrom as c1, pos * strand as p1, mate_chrom as c2, mate_pos * mate_strand as p2 from pairs where chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null)
, o as (select id, case when (c1, p1) <= (c2, p2) then c1 else c2 end as xc, case when (c1, p1) <= (c2, p2) then p1 else p2 end as xp, case when (c1, p1) <= (c2, p2) then c2 else c1 end as yc, case when (c1, p1) <= (c2, p2) then p2 else p1 end as yp from e)
select min(id) as id, count(*) as copies from o group by xc, xp, yc, yp""",
    "w4_best_of_same": "with "
    + PAIRS_SQL
    + """, r as (select chrom, pos * strand as signed, id, row_number() over (partition by chrom, pos * strand order by nm nulls last, coalesce(len, -1) desc, id) as r from pairs where chrom is not null and pos is not null)
select chrom, signed, id from r where r = 1""",
    "w6_first_of_name": "with "
    + MEMBERS_SQL
    + """, r as (select cluster_id, regexp_replace(name, '(mu1|mu2|sc)$', '') as stem, pos, mate_pos, row_number() over (partition by cluster_id, regexp_replace(name, '(mu1|mu2|sc)$', '') order by pos nulls first, mate_pos nulls first) as r from members where name is not null)
select cluster_id, stem, pos, mate_pos from r where r = 1""",
    "j1_mates": "with "
    + PAIRS_SQL
    + """, r as (select name, strand, id, row_number() over (partition by name, strand order by coalesce(len, -1) desc, id) as r from pairs where name is not null)
select a.name, a.id as plus_id, b.id as minus_id from r a join r b on a.name = b.name and a.strand = 1 and b.strand = -1 and a.r = 1 and b.r = 1""",
}

QUERIES = {f.__name__: f for f in (f1_reasons, f4_discordant, f7_coverage, f15_point_blacklist, f16_not_concordant, f17_multiplicity, a1_lengths, a2_basic, a2_characters, a3_encoding, a4_insert_stats, a6_moments, a9_support, w3_duplicates, w4_best_of_same, w6_first_of_name, j1_mates)}
