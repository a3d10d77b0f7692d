"""Interval, point, existence, nearest and ratio joins of records, genes and repeats, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators.intervals import exists_overlap, first_overlap, nearest, overlap_join, point_join
from strandwise.plans.records import GENES_SQL, MEMBERS_SQL, PAIRS_SQL, REPEATS_SQL, gene_spans, members, pairs, repeats

MARGIN = 500
JITTER = 2
NEAR = 100
RATIO = 0.8
LARGEST_ELEMENT = 100_000


def _genes(spark: SparkSession, folder: str) -> DataFrame:
    """One row a distinct annotated segment, so that its columns identify it."""
    return gene_spans(spark, folder).drop("gstrand").where("gchrom is not null and gname is not null").distinct()


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated repeats as segments, each distinct one once."""
    return repeats(spark, folder).where("chrom is not null and rname is not null").select(F.col("chrom").alias("gchrom"), F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("rname").alias("gname"), F.coalesce("rclass", F.lit("NA")).alias("gtype")).distinct()


#: A segment meets the other segments, not its like.
OTHER = "not (gs = s and ge = e)"
_G2 = "g as (select distinct chrom as gchrom, s as gs, e as ge, rname as gname, coalesce(rclass, 'NA') as gtype from reps where chrom is not null and rname is not null)"
_G = "g as (select distinct * exclude (gstrand) from gene_spans where gchrom is not null and gname is not null)"


def j5_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Closed overlap; for each segment how many repeats it meets and over how many positions."""
    pairs_ = overlap_join(_segments(spark, folder), repeats(spark, folder), [("gchrom", "chrom")], ("gs", "ge"), ("s", "e")).where(OTHER)
    shared = F.least("ge", "e") - F.greatest("gs", "s") + 1
    return pairs_.groupBy("gchrom", "gs", "ge", "gname", "gtype").agg(F.count(F.lit(1)).alias("n"), F.sum(shared).alias("shared"))


def j6_point(spark: SparkSession, folder: str) -> DataFrame:
    """Records that begin inside a right-open segment."""
    hits = point_join(pairs(spark, folder).select("id", "chrom", "pos"), _genes(spark, folder), [("chrom", "gchrom")], "pos", ("gs", "ge"))
    return hits.groupBy("gchrom", "gs", "ge", "gname", "gtype").agg(F.count(F.lit(1)).alias("n"))


def s8_region_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The records that a set of regions touches, each region with its number of records and of distinct reads."""
    rows = pairs(spark, folder).where("len > 0").select("name", "chrom", "pos", (F.col("pos") + F.col("len") - 1).alias("stop"))
    hits = overlap_join(_genes(spark, folder), rows, [("gchrom", "chrom")], ("gs", "ge"), ("pos", "stop"))
    return hits.groupBy("gchrom", "gname").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("reads"))


def j10_near_repeat(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a repeat of the member's own kind, bound to its mismatches, lies within 500 positions of either end (0: it does)."""
    rows = members(spark, folder).where("chrom is not null and pos is not null and mate_pos is not null and chrom = mate_chrom and nm is not null")
    rows = rows.select("cluster_id", "chrom", F.when(F.col("nm") % 2 == 1, "LINE").otherwise("SINE").alias("kind"), F.least("pos", "mate_pos").alias("a"), F.greatest("pos", "mate_pos").alias("b")).distinct()
    rows = rows.withColumn("id", F.struct("cluster_id", "chrom", "kind", "a", "b"))
    known = repeats(spark, folder).where("rclass is not null").withColumnRenamed("chrom", "rchrom")
    for end in ("a", "b"):
        rows = rows.withColumns({"lo": F.col(end) - MARGIN, "hi": F.col(end) + MARGIN})
        rows = exists_overlap(rows, known, "id", [("chrom", "rchrom"), ("kind", "rclass")], ("lo", "hi"), ("s", "e"), f"at_{end}")
    return rows.select("cluster_id", "chrom", "kind", "a", "b", F.when(F.col("at_a") | F.col("at_b"), 0).otherwise(1).alias("oi"))


def j11_first_gene(spark: SparkSession, folder: str) -> DataFrame:
    """Name and type of the first segment within 2 positions of a record, by start, end and name; `-` if there is none."""
    rows = members(spark, folder).where("chrom is not null and pos is not null").select("chrom", "pos").distinct()
    rows = rows.withColumns({"id": F.struct("chrom", "pos"), "lo": F.col("pos") - JITTER, "hi": F.col("pos") + JITTER})
    order = [F.col("gs"), F.col("ge"), F.col("gname"), F.col("gtype")]
    first = first_overlap(rows, _genes(spark, folder), "id", [("chrom", "gchrom")], ("lo", "hi"), ("gs", "ge"), order, {"gene": F.concat_ws("_", "gname", "gtype")})
    return first.select("chrom", "pos", F.coalesce("gene", F.lit("-")).alias("gene"))


def j14_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Sure positions of either table (no mismatch is unsure) against those of the other, of one chromosome, strand and kind within 100 positions: the one nearest at both ends together, of equal ones the first; the comparison runs both ways."""
    kind = F.when(F.col("nm") % 2 == 1, "LINE").otherwise("SINE")
    sure = "chrom is not null and pos is not null and mate_pos is not null and strand is not null and nm is not null"
    one = members(spark, folder).where(sure).select("chrom", "strand", kind.alias("kind"), "pos", "mate_pos").distinct()
    two = pairs(spark, folder).where(sure).select("chrom", "strand", kind.alias("kind"), "pos", "mate_pos").distinct()

    def way(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.withColumn("key", F.struct("chrom", "strand", "kind", "pos", "mate_pos"))
        right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
        distance = F.abs(F.col("r_pos") - F.col("pos")) + F.abs(F.col("r_mate_pos") - F.col("mate_pos"))
        order = [F.col("r_pos"), F.col("r_mate_pos")]
        near = nearest(left, right, "key", [("chrom", "r_chrom"), ("strand", "r_strand"), ("kind", "r_kind")], "pos", "r_pos", NEAR, distance, order, {"near_pos": F.col("r_pos"), "near_mate_pos": F.col("r_mate_pos"), "distance": distance})
        return near.select(F.lit(name).alias("side"), "chrom", "strand", "kind", "pos", "mate_pos", "near_pos", "near_mate_pos", "distance")

    return way("clusters", one, two).unionByName(way("alt_map", two, one))


def j15_one_end(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which exactly one end begins in a segment of the opposite strand."""
    rows = pairs(spark, folder).where("pos is not null and mate_pos is not null").select("id", "chrom", "pos", "mate_chrom", "mate_pos", *[F.when(F.col(c) == 1, "-").when(F.col(c) == -1, "+").alias(f"facing_{c}") for c in ("strand", "mate_strand")])
    g = gene_spans(spark, folder).where("gchrom is not null and gname is not null and gstrand is not null").select("gchrom", "gstrand", "gs", "ge").distinct()
    one = exists_overlap(rows, g, "id", [("chrom", "gchrom"), ("facing_strand", "gstrand")], ("pos", "pos"), ("gs", "ge"), "at_start")
    two = exists_overlap(one, g, "id", [("mate_chrom", "gchrom"), ("facing_mate_strand", "gstrand")], ("mate_pos", "mate_pos"), ("gs", "ge"), "at_mate")
    return two.where("at_start <> at_mate").select("id", "at_start")


def j17_element(spark: SparkSession, folder: str) -> DataFrame:
    """The first repeat that a segment and it cover each other of by 0.8; else `complex` if all its parts of repeats add up to that."""
    g = _segments(spark, folder).where(F.col("ge") - F.col("gs") <= LARGEST_ELEMENT)
    r = repeats(spark, folder).where("rname is not null and rclass in ('LINE', 'SINE', 'LTR', 'DNA')")
    shared = F.least("ge", "e") - F.greatest("gs", "s") + 1
    own, other = F.col("ge") - F.col("gs") + 1, F.col("e") - F.col("s") + 1
    hits = overlap_join(g, r, [("gchrom", "chrom")], ("gs", "ge"), ("s", "e")).where(OTHER).withColumns({"shared": shared, "both": (shared >= RATIO * own) & (shared >= RATIO * other)})
    per = hits.groupBy("gchrom", "gs", "ge", "gname", "gtype").agg(F.min(F.when(F.col("both"), F.struct("s", "e", "rname"))).alias("first"), F.sum("shared").alias("total"))
    found = F.when(F.col("first").isNotNull(), F.col("first.rname")).when(F.col("total") >= RATIO * own, "complex")
    return per.withColumn("element", found).where("element is not null").select("gchrom", "gs", "ge", "gname", "gtype", "element")


def j18_simple_repeat(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of which a simple repeat covers 0.8."""
    g = _segments(spark, folder)
    r = repeats(spark, folder).where("rclass in ('SIMPLE_REPEAT', 'SATELLITE', 'LOW_COMPLEXITY')")
    shared = F.least("ge", "e") - F.greatest("gs", "s") + 1
    hits = overlap_join(g, r, [("gchrom", "chrom")], ("gs", "ge"), ("s", "e")).where(OTHER).where(shared >= RATIO * (F.col("ge") - F.col("gs") + 1))
    return hits.select("gchrom", "gs", "ge", "gname", "gtype").distinct()


def j19_breakpoint_kind(spark: SparkSession, folder: str) -> DataFrame:
    """SR, TE or nothing for both ends of each cluster member, as `BP:x_y`; simple repeats are asked first."""
    rows = members(spark, folder).where("chrom is not null and pos is not null and mate_pos is not null").select("chrom", "pos", "mate_chrom", "mate_pos").distinct().withColumn("id", F.struct("chrom", "pos", "mate_chrom", "mate_pos"))
    r = repeats(spark, folder).withColumnRenamed("chrom", "rchrom")
    simple, mobile = r.where("rclass in ('SIMPLE_REPEAT', 'SATELLITE', 'LOW_COMPLEXITY')"), r.where("rclass in ('LINE', 'SINE', 'LTR', 'DNA')")
    for flag, side, c, p in (("sr1", simple, "chrom", "pos"), ("te1", mobile, "chrom", "pos"), ("sr2", simple, "mate_chrom", "mate_pos"), ("te2", mobile, "mate_chrom", "mate_pos")):
        rows = exists_overlap(rows, side, "id", [(c, "rchrom")], (p, p), ("s", "e"), flag)
    part = lambda i: F.when(F.col(f"sr{i}"), "SR").when(F.col(f"te{i}"), "TE").otherwise("")
    return rows.select("chrom", "pos", "mate_chrom", "mate_pos", F.concat(F.lit("BP:"), part(1), F.lit("_"), part(2)).alias("kind"))



_GR = f"with {REPEATS_SQL}, {_G2}"
_KEY = "gchrom, gs, ge, gname, gtype"
_ON = "g.gchrom = r.chrom and r.s <= g.ge and g.gs <= r.e and not (g.gs = r.s and g.ge = r.e)"

SQL = {
    "j5_overlap": f"{_GR} select {_KEY}, count(*) as n, cast(sum(least(ge, e) - greatest(gs, s) + 1) as bigint) as shared from g join reps r on {_ON} group by {_KEY}",
    "j6_point": f"with {GENES_SQL}, {_G}, {PAIRS_SQL} select {_KEY}, count(*) as n from g join pairs p on p.chrom = g.gchrom and g.gs <= p.pos and g.ge > p.pos group by {_KEY}",
    "s8_region_scan": f"with {GENES_SQL}, {_G}, {PAIRS_SQL} select gchrom, gname, count(*) as n, count(distinct name) as reads from g join pairs p on p.chrom = g.gchrom and p.len > 0 and p.pos <= g.ge and p.pos + p.len - 1 >= g.gs group by gchrom, gname",
    "j10_near_repeat": f"""with {MEMBERS_SQL}, {REPEATS_SQL}, m as (select distinct cluster_id, chrom, case when nm % 2 = 1 then 'LINE' else 'SINE' end as kind, least(pos, mate_pos) as a, greatest(pos, mate_pos) as b from members where chrom is not null and pos is not null and mate_pos is not null and chrom = mate_chrom and nm is not null)
select *, case when exists (select 1 from reps r where r.rclass = m.kind and r.chrom = m.chrom and ((r.s <= m.a + 500 and r.e >= m.a - 500) or (r.s <= m.b + 500 and r.e >= m.b - 500))) then 0 else 1 end as oi from m""",
    "j11_first_gene": f"""with {MEMBERS_SQL}, {GENES_SQL}, {_G}, m as (select distinct chrom, pos from members where chrom is not null and pos is not null)
, x as (select m.chrom, m.pos, gname || '_' || gtype as gene, row_number() over (partition by m.chrom, m.pos order by gs, ge, gname, gtype) as r from m left join g on g.gchrom = m.chrom and g.gs <= m.pos + 2 and g.ge >= m.pos - 2)
select chrom, pos, coalesce(gene, '-') as gene from x where r = 1""",
    "j14_nearest": f"""with {MEMBERS_SQL}, {PAIRS_SQL}, a as (select distinct 'clusters' as side, chrom, strand, case when nm % 2 = 1 then 'LINE' else 'SINE' end as kind, pos, mate_pos from members where chrom is not null and pos is not null and mate_pos is not null and strand is not null and nm is not null
  union all select distinct 'alt_map', chrom, strand, case when nm % 2 = 1 then 'LINE' else 'SINE' end, pos, mate_pos from pairs where chrom is not null and pos is not null and mate_pos is not null and strand is not null and nm is not null)
, x as (select a.*, b.pos as near_pos, b.mate_pos as near_mate_pos, abs(b.pos - a.pos) + abs(b.mate_pos - a.mate_pos) as distance from a left join a b on a.side <> b.side and a.chrom = b.chrom and a.strand = b.strand and a.kind = b.kind and b.pos between a.pos - 100 and a.pos + 100)
, y as (select *, row_number() over (partition by side, chrom, strand, kind, pos, mate_pos order by distance, near_pos, near_mate_pos) as r from x)
select side, chrom, strand, kind, pos, mate_pos, near_pos, near_mate_pos, distance from y where r = 1""",
    "j15_one_end": f"""with {PAIRS_SQL}, {GENES_SQL}, a as (select distinct p.id from pairs p join gene_spans g on g.gname is not null and p.chrom = g.gchrom and p.pos between g.gs and g.ge and ((p.strand = 1 and g.gstrand = '-') or (p.strand = -1 and g.gstrand = '+'))), b as (select distinct p.id from pairs p join gene_spans g on g.gname is not null and p.mate_chrom = g.gchrom and p.mate_pos between g.gs and g.ge and ((p.mate_strand = 1 and g.gstrand = '-') or (p.mate_strand = -1 and g.gstrand = '+')))
select p.id, a.id is not null as at_start from pairs p left join a on a.id = p.id left join b on b.id = p.id where p.pos is not null and p.mate_pos is not null and (a.id is not null) <> (b.id is not null)""",
    "j17_element": f"""{_GR}, h as (select {_KEY}, s, e, rname, least(ge, e) - greatest(gs, s) + 1 as shared, ge - gs + 1 as own, e - s + 1 as other from g join reps r on {_ON} and r.rname is not null and r.rclass in ('LINE', 'SINE', 'LTR', 'DNA') where ge - gs <= 100000)
, f as (select {_KEY}, own, arg_min(rname, (s, e, rname)) filter (shared >= 0.8::double * own and shared >= 0.8::double * other) as first, sum(shared) as total from h group by {_KEY}, own)
select {_KEY}, coalesce(first, 'complex') as element from f where first is not null or total >= 0.8::double * own""",
    "j18_simple_repeat": f"{_GR} select distinct {_KEY} from g join reps r on {_ON} where r.rclass in ('SIMPLE_REPEAT', 'SATELLITE', 'LOW_COMPLEXITY') and least(ge, e) - greatest(gs, s) + 1 >= 0.8::double * (ge - gs + 1)",
    "j19_breakpoint_kind": f"""with {MEMBERS_SQL}, {REPEATS_SQL}, m as (select distinct chrom, pos, mate_chrom, mate_pos from members where chrom is not null and pos is not null and mate_pos is not null)
, sr as (select * from reps where rclass in ('SIMPLE_REPEAT', 'SATELLITE', 'LOW_COMPLEXITY')), te as (select * from reps where rclass in ('LINE', 'SINE', 'LTR', 'DNA'))
select *, 'BP:' || case when exists (select 1 from sr where sr.chrom = m.chrom and m.pos between sr.s and sr.e) then 'SR' when exists (select 1 from te where te.chrom = m.chrom and m.pos between te.s and te.e) then 'TE' else '' end
  || '_' || case when exists (select 1 from sr where sr.chrom = m.mate_chrom and m.mate_pos between sr.s and sr.e) then 'SR' when exists (select 1 from te where te.chrom = m.mate_chrom and m.mate_pos between te.s and te.e) then 'TE' else '' end as kind from m""",
}

QUERIES = {f.__name__: f for f in (j5_overlap, j6_point, s8_region_scan, j10_near_repeat, j11_first_gene, j14_nearest, j15_one_end, j17_element, j18_simple_repeat, j19_breakpoint_kind)}
