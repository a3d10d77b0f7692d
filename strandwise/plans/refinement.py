"""Bounds after local alignment, flows of contigs, the order and the text forms of events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.operators.events import refined
from strandwise.operators.regions import is_orphan, is_transduction
from strandwise.plans.events_queries import CLUSTERS_SQL, READ_LEN, singles
from strandwise.plans.records import MEMBERS_SQL, PAIRS_SQL, members, pairs
from strandwise.plans.variants import _VARIANTS, _variants
from strandwise.sources.sinks import variant_lines


def _breakpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Single events with the breakpoints of a local alignment, for which numbers of the cluster stand: 0 is none."""
    rows = singles(spark, folder).where("event in ('del', 'tandem_dup', 'invers_f', 'invers_r') and start <= `end`")
    return rows.withColumns({"bp0": F.when(F.col("mm") % 3 == 0, 0).otherwise(F.col("mm") % 90 + 60), "bp1": F.when(F.col("pid") % 4 == 0, 0).otherwise(F.col("pid") % 70 + 330), "between": F.col("mm") % 40 - 20})


def e16_refined(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds by the breakpoints in the two windows around the called ones, called ones where there is none; a deletion with bases between becomes `del_ins`; the homology, 1000 if it is unknown."""
    return refined(_breakpoints(spark, folder), READ_LEN).select("pid", "chrom", "event", "start", "end", "size", "inserted", "homology")


def f21_known_homology(spark: SparkSession, folder: str) -> DataFrame:
    """how many refined events of each kind are left without those of unknown homology."""
    return e16_refined(spark, folder).where("not (homology <=> 1000)").groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.max("homology").alias("most"))


_REFINED = f"""with {MEMBERS_SQL}, {CLUSTERS_SQL}, b as (select pid, chrom, case when t = 0 then 'del' when t = 1 then 'invers_f' when t = 2 then 'invers_r' else 'tandem_dup' end as event, case when t < 2 then s2 else s1 end as s, case when t in (1, 3) then m2 else m1 end as e, mm from cl where chrom = mate_chrom and (t <> 0 or m1 - s2 > 1))
, c as (select *, case when mm % 3 = 0 then 0 else mm % 90 + 60 end as bp0, case when pid % 4 = 0 then 0 else pid % 70 + 330 end as bp1, mm % 40 - 20 as g from b where s <= e)
, d as (select *, case when bp0 = 0 then s else s - 100 + bp0 - 1 end as l, case when bp1 = 0 then e when s + 100 >= e - 100 then s - 100 + bp1 - 1 else e - 100 + bp1 - 300 - 2 end as r, case when bp0 = 0 then -1000 else g end as g2 from c)
, refined as (select pid, chrom, case when event = 'del' and g2 > 0 then 'del_ins' else event end as event, l as start, r as "end", case when event = 'del' then r - l - 1 else r - l end as size, case when event = 'del' and g2 > 0 then g2 end as inserted, case when event = 'del' and g2 > 0 then null else -g2 end as homology from d where case when event = 'del' then r - l - 1 else r - l end > 0)"""


def e21_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Contigs of each cluster by flow: orphans; transductions; short transductions, which align well to the reference and just so well to a repeat that is none of the excluded; the rest. What an earlier flow took is not in a later one. Mismatches, lengths and sizes stand for the alignments."""
    rows = members(spark, folder).where("name is not null and nm is not null and pos is not null")
    known = [F.col("len").isNotNull(), F.col("mate_len").isNotNull(), F.col("isize").isNotNull(), F.col("nm") >= 2]
    poly = F.col("nm") == 0
    orphan = is_orphan(poly, *known)
    well = (F.lit(60) - 5 * F.col("nm") >= 25) & (F.when(F.col("nm") % 2 == 1, 37).otherwise(20) == 37) & (F.coalesce("rg", F.lit("")) != "RICKSHA")
    complete = (F.col("weight") != 0) & known[0] & known[1]
    flow = F.when(orphan, "orphan").when(is_transduction(poly, orphan, *known), "transduction").when(complete & well, "short").otherwise("post")
    return rows.groupBy("pid", flow.alias("flow")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("reads"))


def o6_event_order(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the order of kind, chromosome, clusters and bounds; the place is that in their kind and chromosome."""
    order = ["pid", F.coalesce("partner", F.lit(-1)), "start", "end", F.coalesce("mate_start", F.lit(-1)), F.coalesce("mate_end", F.lit(-1)), "mate_chrom", "size"]
    place = F.row_number().over(Window.partitionBy("event", "chrom").orderBy(*order))
    return _variants(spark, folder).select("event", "chrom", "pid", "partner", "start", "end", place.alias("place"))


def k4_variant_lines(spark: SparkSession, folder: str) -> DataFrame:
    """K4: one text an event, with the columns of its type; events with a bound of 0 go."""
    return variant_lines(_variants(spark, folder))


def r3_names(spark: SparkSession, folder: str) -> DataFrame:
    """The name of each cluster's region, both halves with the orientation: 0 for opposite strands, 1 for equal ones; and which bound weighs for each half by the strand type."""
    rows = members(spark, folder).where("chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null and len is not null and mate_len is not null and strand in (1, -1) and mate_strand in (1, -1)")
    per = rows.groupBy("pid", "sid", "chrom", "mate_chrom", "strand", "mate_strand").agg(F.min("pos").alias("a1"), F.max(F.col("pos") + F.col("len")).alias("a2"), F.min("mate_pos").alias("b1"), F.max(F.col("mate_pos") + F.col("mate_len")).alias("b2"))
    wide = {c: F.greatest(F.col(c) - 110, F.lit(0)) if c[1] == "1" else F.col(c) + 110 for c in ("a1", "a2", "b1", "b2")}
    same = F.col("strand") == F.col("mate_strand")
    name = F.concat_ws("~", "chrom", wide["a1"], wide["a2"], "mate_chrom", wide["b1"], wide["b2"], F.when(same, 1).otherwise(0))
    weight = lambda strand, low, high: F.when(F.col(strand) == 1, high).otherwise(low)
    first = F.min(F.struct("chrom", "mate_chrom", name.alias("name"), weight("strand", 1, 2).alias("w1"), weight("mate_strand", 3, 4).alias("w2"))).alias("x")
    return per.groupBy("pid", "sid").agg(first).select("pid", "sid", "x.name", "x.w1", "x.w2")


def f4_blacklisted(spark: SparkSession, folder: str) -> DataFrame:
    """Records left without those of blacklisted read groups and without duplicates at the same two ends, by read group. Groups whose number of records is a multiple of three stand for the list."""
    rows = pairs(spark, folder).where("rg is not null and chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null")
    listed = rows.groupBy("rg").agg(F.count(F.lit(1)).alias("n")).where("n % 3 = 0").select("rg")
    kept = rows.join(listed, "rg", "left_anti")
    first = kept.groupBy("rg", "chrom", "pos", "strand", "mate_chrom", "mate_pos", "mate_strand").agg(F.min("id").alias("id"))
    return first.groupBy("rg").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def x23_reordered(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of a record with its mate's place and with other places, each with the lesser end first, ends by chromosome and position. Two other places come out of the position."""
    rows = pairs(spark, folder).where("chrom is not null and pos is not null and mate_chrom is not null and mate_pos is not null and strand is not null and mate_strand is not null")
    end = lambda c, p, s: F.struct(F.col(c).alias("chrom"), p.alias("pos"), s.alias("strand"))
    own = F.array(*[end("chrom", F.col("pos") + k, F.col("strand") * w) for k, w in ((0, 1), (1000, -1), (-70, 1))])
    each = rows.select("id", F.explode(own).alias("a"), end("mate_chrom", F.col("mate_pos"), F.col("mate_strand")).alias("b"))
    return each.select("id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).select("id", F.col("x.chrom").alias("chrom"), F.col("x.pos").alias("pos"), F.col("x.strand").alias("strand"), F.col("y.chrom").alias("mate_chrom"), F.col("y.pos").alias("mate_pos"), F.col("y.strand").alias("mate_strand"))


def _line(*parts: str) -> str:
    return "concat_ws(chr(9), " + ", ".join(parts) + ")"


SQL = {
    "e16_refined": f"{_REFINED} select * from refined",
    "f21_known_homology": f"{_REFINED} select event, count(*) as n, max(homology) as most from refined where homology is distinct from 1000 group by event",
    "e21_flows": f"""with {MEMBERS_SQL}, k as (select *, len is not null as a, mate_len is not null as b, isize is not null as c, nm >= 2 as d, nm = 0 as poly from members where name is not null and nm is not null and pos is not null)
, o as (select *, case when poly then a or b or c or d else (c and d) or ((a or b) and (c or d)) end as orphan from k)
select pid, case when orphan then 'orphan' when poly and not (a and b and c and d) then 'transduction' when weight <> 0 and a and b and nm <= 7 and nm % 2 = 1 and coalesce(rg, '') <> 'RICKSHA' then 'short' else 'post' end as flow, count(*) as n, count(distinct name) as reads from o group by 1, 2""",
    "o6_event_order": f"""{_VARIANTS} select event, chrom, pid, partner, start, "end", cast(row_number() over (partition by event, chrom order by pid, coalesce(partner, -1), start, "end", coalesce(mate_start, -1), coalesce(mate_end, -1), mate_chrom, size) as int) as place from v""",
    "k4_variant_lines": f"""{_VARIANTS} select case when event = 'transl_inter' then {_line('event', 'pid', 'chrom', 'start', 'mate_chrom', '"end"')} when partner is null then {_line('event', 'pid', 'chrom', 'start', '"end"', 'size')}
  when rule = 'invers' then {_line('event', "pid || '/' || partner", 'chrom', 'start', '"end"', 'size', 'mate_chrom', 'mate_start', 'mate_end')} else {_line('event', "pid || '/' || partner", 'chrom', 'start', '"end"', 'size', 'mate_chrom', 'mate_start', 'mate_end', 'inserted')} end as line
from v where start <> 0 and "end" <> 0 and coalesce(mate_start, 1) <> 0 and coalesce(mate_end, 1) <> 0""",
    "r3_names": f"""with {MEMBERS_SQL}, p as (select pid, sid, chrom, mate_chrom, strand, mate_strand, greatest(min(pos) - 110, 0) as a1, max(pos + len) + 110 as a2, greatest(min(mate_pos) - 110, 0) as b1, max(mate_pos + mate_len) + 110 as b2 from members
  where chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null and len is not null and mate_len is not null and strand in (1, -1) and mate_strand in (1, -1) group by all)
, n as (select pid, sid, chrom, mate_chrom, concat_ws('~', chrom, a1, a2, mate_chrom, b1, b2, case when strand = mate_strand then 1 else 0 end) as name, case when strand = 1 then 2 else 1 end as w1, case when mate_strand = 1 then 4 else 3 end as w2 from p)
select pid, sid, name, w1, w2 from (select *, row_number() over (partition by pid, sid order by chrom, mate_chrom, name, w1, w2) as r from n) where r = 1""",
    "f4_blacklisted": f"""with {PAIRS_SQL}, g as (select * from pairs where rg is not null and chrom is not null and mate_chrom is not null and pos is not null and mate_pos is not null), bad as (select rg from g group by rg having count(*) % 3 = 0)
, f as (select rg, min(id) as id from g where rg not in (select rg from bad) group by rg, chrom, pos, strand, mate_chrom, mate_pos, mate_strand) select rg, count(*) as n, min(id) as first from f group by rg""",
    "x23_reordered": f"""with {PAIRS_SQL}, e as (select id, chrom as c, pos + k as p, strand * w as s, mate_chrom as mc, mate_pos as mp, mate_strand as ms from pairs, (values (0, 1), (1000, -1), (-70, 1)) as o(k, w) where chrom is not null and pos is not null and mate_chrom is not null and mate_pos is not null and strand is not null and mate_strand is not null), o as (select *, (c, p, s) <= (mc, mp, ms) as fine from e)
select id, case when fine then c else mc end as chrom, case when fine then p else mp end as pos, case when fine then s else ms end as strand, case when fine then mc else c end as mate_chrom, case when fine then mp else p end as mate_pos, case when fine then ms else s end as mate_strand from o""",
}

QUERIES = {f.__name__: f for f in (e16_refined, f21_known_homology, e21_flows, o6_event_order, k4_variant_lines, r3_names, f4_blacklisted, x23_reordered)}
