"""Structural variants as one table: events between chromosomes, demotion, mechanism, overlaps with other calls, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.operators.events import mechanism
from strandwise.operators.intervals import exists_overlap, overlap_join
from strandwise.operators.neighbours import k_nearest, overlap_counts
from strandwise.operators.regions import demoted_name
from strandwise.plans.events_queries import CLUSTERS_SQL, INTRA_SQL, LARGEST, READ_LEN, clusters, intra, singles
from strandwise.plans.records import MEMBERS_SQL, REPEATS_SQL, repeats
from strandwise.runtime import checkpointed

LARGEST_ELEMENT = 100_000
RATIO = 0.8
CUTOFF = 3
SIZE_TOLERANCE = 10
RANKED = 4


def _partners(c: DataFrame) -> DataFrame:
    """Of each anchor (type 0 or 1) the first cluster, in the ranking by start and then in that by mate start, that is among the nearest 4 of both; of the type that faces the anchor's, of other primary clusters on the same two chromosomes, at any distance."""
    keys = ["chrom", "mate_chrom", "need"]
    anchors = c.where("t in (0, 1)").withColumn("need", 3 - F.col("t"))
    others = c.where("t in (2, 3)").select("chrom", "mate_chrom", F.col("t").alias("need"), F.col("pid").alias("partner"), "s1", "m1")
    # A primary cluster has one row a type, so one more than asked for makes up for its own.
    near = k_nearest(k_nearest(anchors, others, keys, "s1", "partner", RANKED + 1, "by_start"), others, keys, "m1", "partner", RANKED + 1, "by_mate")
    ids = lambda x: F.slice(F.transform(F.filter(x, lambda n: n.id != F.col("pid")), lambda n: n.id), 1, RANKED)
    near = near.withColumns({"by_start": ids("by_start"), "by_mate": ids("by_mate")})
    near = near.withColumn("partner", F.get(F.array_intersect("by_start", "by_mate"), F.lit(0))).where("partner is not null")
    return near.withColumns({"r1": F.array_position("by_start", F.col("partner")), "r2": F.array_position("by_mate", F.col("partner"))}).drop("by_start", "by_mate")


def _facing(spark: SparkSession, folder: str) -> DataFrame:
    return checkpointed(clusters(spark, folder).where("chrom <> mate_chrom").drop("support", "mm"))


def j9_two_rankings(spark: SparkSession, folder: str) -> DataFrame:
    """The partner of each cluster between two chromosomes, with its ranks by start and by mate start."""
    return _partners(_facing(spark, folder)).select("pid", "chrom", "mate_chrom", "t", "partner", "r1", "r2")


def _inter(spark: SparkSession, folder: str) -> DataFrame:
    c = _facing(spark, folder)
    i = _partners(c).where("chrom < mate_chrom")
    k = c.select(F.col("pid").alias("partner"), "chrom", "mate_chrom", F.col("t").alias("need"), *[F.col(x).alias(f"k_{x}") for x in ("s1", "s2", "m1", "m2")])
    both = i.join(k, ["partner", "chrom", "mate_chrom", "need"])
    sides = F.expr("""case
      when t = 1 and m2 > k_m1 then named_struct('name', 'inso', 'side', 'A', 'c1', chrom, 'start', s2, 'end', k_s1, 'c2', mate_chrom, 'mate_start', k_m1, 'mate_end', m2, 'deleted', k_s1 - s2 - 1, 'inserted', m2 - k_m1 + 1)
      when t = 1 and s2 > k_s1 then named_struct('name', 'inso', 'side', 'B', 'c1', mate_chrom, 'start', m2, 'end', k_m1, 'c2', chrom, 'mate_start', k_s1, 'mate_end', s2, 'deleted', k_m1 - m2 - 1, 'inserted', s2 - k_s1 + 1)
      when t = 0 and k_m2 > m1 then named_struct('name', 'inss', 'side', 'A', 'c1', chrom, 'start', s2, 'end', k_s1, 'c2', mate_chrom, 'mate_start', m1, 'mate_end', k_m2, 'deleted', k_s1 - s2 - 1, 'inserted', k_m2 - m1 + 1)
      when t = 0 and s2 > k_s1 then named_struct('name', 'inss', 'side', 'B', 'c1', mate_chrom, 'start', k_m2, 'end', m1, 'c2', chrom, 'mate_start', k_s1, 'mate_end', s2, 'deleted', m1 - k_m2 - 1, 'inserted', s2 - k_s1 + 1) end""")
    x = F.col("x")
    event = F.when(x.deleted < READ_LEN, x["name"]).otherwise(F.concat(F.lit("del_"), x["name"]))
    found = both.withColumn("x", sides).where(f"x is not null and x.deleted < {LARGEST} and x.inserted < {LARGEST}")
    return found.select("pid", "partner", event.alias("event"), "x.side", x.c1.alias("chrom"), "x.start", "x.end", x.c2.alias("mate_chrom"), "x.mate_start", "x.mate_end", "x.deleted", "x.inserted")


def e6_inter(spark: SparkSession, folder: str) -> DataFrame:
    """Insertions between chromosomes, of each anchor and its partner, with the coordinates of both branches."""
    return _inter(spark, folder)


def e14_inter_demoted(spark: SparkSession, folder: str) -> DataFrame:
    """Of insertions that share a cluster the smallest is kept; the others become translocations of the anchor, in the order of the two chromosomes."""
    events = checkpointed(_inter(spark, folder).withColumn("key", F.struct((F.abs("deleted") + F.abs("inserted")).alias("size"), "pid", "partner")))
    claims = events.select(F.col("pid").alias("c"), "key").unionByName(events.select(F.col("partner").alias("c"), "key")).groupBy("c").agg(F.min("key").alias("best"))
    held = events.join(claims.withColumnsRenamed({"c": "pid", "best": "b1"}), "pid").join(claims.withColumnsRenamed({"c": "partner", "best": "b2"}), "partner")
    kept = (F.col("key") == F.col("b1")) & (F.col("key") == F.col("b2"))
    turned = F.col("chrom") > F.col("mate_chrom")
    swap = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    lost = held.where(~kept).select("pid", F.lit(None).cast("long").alias("partner"), F.lit("transl_inter").alias("event"), swap("chrom", "mate_chrom").alias("chrom"), swap("start", "mate_end").alias("start"), swap("mate_chrom", "chrom").alias("mate_chrom"), swap("mate_start", "start").alias("mate_start"), F.lit(1).alias("strand"), F.when(F.col("event").endswith("inss"), -1).otherwise(1).alias("mate_strand"))
    return held.where(kept).select("pid", "partner", "event", "chrom", "start", "mate_chrom", "mate_start", F.lit(None).cast("int").alias("strand"), F.lit(None).cast("int").alias("mate_strand")).unionByName(lost)


def _variants(spark: SparkSession, folder: str) -> DataFrame:
    """Single events and composite events on one chromosome: pid, partner (null for one cluster), rule, event, chrom, start, end, mate_chrom, mate_start, mate_end, size, inserted, homology."""
    none = F.lit(None).cast("long")
    one = singles(spark, folder).select("pid", none.alias("partner"), F.lit("").alias("rule"), "event", "chrom", "start", "end", "mate_chrom", none.alias("mate_start"), none.alias("mate_end"), "size", none.alias("inserted"), F.col("mm").alias("homology"))
    two = intra(spark, folder).select("pid", "partner", "rule", "event", "chrom", "start", "end", F.col("chrom").alias("mate_chrom"), "mate_start", "mate_end", F.col("deleted").alias("size"), "inserted", none.alias("homology"))
    return checkpointed(one.unionByName(two))


_VARIANTS = f"""{INTRA_SQL}, sg as (select pid, chrom, mate_chrom, t, mm, case when chrom <> mate_chrom then 'transl_inter' when t = 0 and m1 - s2 > 1 then 'del' when t = 1 then 'invers_f' when t = 2 then 'invers_r' when t = 3 then 'tandem_dup' end as event,
  case when chrom <> mate_chrom then case when t < 2 then s2 else s1 end when t < 2 then s2 else s1 end as a, case when chrom <> mate_chrom then case when t in (1, 3) then m2 else m1 end when t in (1, 3) then m2 else m1 end as b,
  case when chrom <> mate_chrom then null when t = 0 then m1 - s2 - 1 when t = 1 then m2 - s2 else m1 - s1 end as size from cl)
, v as (select pid, null::bigint as partner, '' as rule, event, chrom, a as start, b as "end", mate_chrom, null::bigint as mate_start, null::bigint as mate_end, size, null::bigint as inserted, mm as homology from sg where event is not null and coalesce(size, 0) < {LARGEST}
  union all select pid, partner, rule, event, chrom, start, "end", chrom, mate_start, mate_end, deleted, inserted, null from ev)"""


def a24_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster keeps its smallest event; a composite event that loses one of its clusters becomes what is left, an event that loses all goes. Events equal in all but their clusters are one."""
    events = _variants(spark, folder).where("event <> 'transl_inter'")
    events = events.withColumn("key", F.struct((F.abs("size") + F.abs(F.coalesce("inserted", F.lit(0)))).alias("size"), "event", "start", "end", "pid", F.coalesce("partner", F.lit(-1)).alias("partner"), "mate_start", "mate_end"))
    best = events.select(F.col("pid").alias("c"), "key").unionByName(events.where("partner is not null").select(F.col("partner").alias("c"), "key")).groupBy("c").agg(F.min("key").alias("best"))
    held = events.join(best.withColumnsRenamed({"c": "pid", "best": "b1"}), "pid").join(best.select(F.col("c").alias("partner"), F.col("best").alias("b2")), "partner", "left")
    lost = (F.col("key") != F.col("b1")).cast("int") + F.coalesce((F.col("key") != F.col("b2")).cast("int"), F.lit(0))
    held = held.withColumn("lost", lost).where("lost = 0 or (partner is not null and lost = 1)")
    plain = F.when(F.col("rule") == "invers", F.lit("invers")).otherwise(F.col("rule"))
    left = F.expr("case rule when 'inssd' then struct(end as a, mate_end as b) when 'inssu' then struct(mate_start as a, start as b) when 'insou' then struct(mate_end as a, start as b) else struct(start as a, mate_end as b) end")
    # The plain inversion has no row in the table of what is left: it stays what it is.
    down = (F.col("lost") == 1) & (demoted_name(F.when(F.col("event") == "del_invers", F.col("event")).otherwise(plain)) != F.col("event"))
    out = held.select(F.when(down, demoted_name(F.when(F.col("event") == "del_invers", F.col("event")).otherwise(plain))).otherwise(F.col("event")).alias("event"), "chrom", F.when(down, left.a).otherwise(F.col("start")).alias("start"), F.when(down, left.b).otherwise(F.col("end")).alias("end"), F.when(down, F.col("end") - F.col("start")).otherwise(F.col("size")).alias("size"), F.when(~down, F.col("mate_start")).alias("mate_start"), F.when(~down, F.col("mate_end")).alias("mate_end"))
    return out.groupBy("event", "chrom", "start", "end", "size", "mate_start", "mate_end").agg(F.count(F.lit(1)).alias("n"))


def _explained(spans: DataFrame, reps: DataFrame) -> DataFrame:
    """Chrom, lo, hi with `element` (the first mobile element that it and the span cover each other of by 0.8, else `complex` if its parts add up to that) and `simple` (a simple repeat covers 0.8)."""
    r = reps.withColumnsRenamed({"chrom": "rchrom", "e": "re", "s": "rs"})
    rows = spans.where(f"hi - lo <= {LARGEST_ELEMENT}").distinct().withColumn("id", F.struct("chrom", "lo", "hi"))
    shared = F.least("hi", "re") - F.greatest("lo", "rs") + 1
    own, other = RATIO * (F.col("hi") - F.col("lo") + 1), RATIO * (F.col("re") - F.col("rs") + 1)
    simple = exists_overlap(rows, r.where("rclass in ('SIMPLE_REPEAT', 'SATELLITE', 'LOW_COMPLEXITY')"), "id", [("chrom", "rchrom")], ("lo", "hi"), ("rs", "re"), "simple", shared >= own)
    hits = overlap_join(rows, r.where("rclass in ('LINE', 'SINE', 'LTR', 'DNA') and rname is not null"), [("chrom", "rchrom")], ("lo", "hi"), ("rs", "re"))
    hits = hits.withColumns({"shared": shared, "own": own, "both": (shared >= own) & (shared >= other)})
    per = hits.groupBy(F.col("id").alias("key")).agg(F.min(F.when(F.col("both"), F.struct("rs", "re", "rname"))).alias("first"), F.sum("shared").alias("total"), F.max("own").alias("own"))
    per = per.select("key", F.when(F.col("first").isNotNull(), F.col("first.rname")).when(F.col("total") >= F.col("own"), "complex").alias("element"))
    return simple.join(per, F.col("id") == F.col("key"), "left").select("chrom", "lo", "hi", "element", "simple")


def e17_mechanism(spark: SparkSession, folder: str) -> DataFrame:
    """The mechanism of each event, single or composite, by the repeats at its deleted and its inserted range and its homology, for which the mismatches of the cluster stand.

    Ranges of more than 100,000 positions and events between chromosomes are not
    explained by repeats.
    """
    v = _variants(spark, folder)
    span = lambda a, b: (F.least(a, b), F.greatest(a, b))
    v = v.withColumns(dict(zip(("lo", "hi", "mlo", "mhi"), (*span("start", "end"), *span("mate_start", "mate_end")), strict=True)))
    inside = v.where("event <> 'transl_inter'")
    spans = inside.select("chrom", "lo", "hi").unionByName(inside.where("mlo is not null").select("chrom", F.col("mlo").alias("lo"), F.col("mhi").alias("hi")))
    known = checkpointed(_explained(spans, repeats(spark, folder)))
    d = known.withColumnsRenamed({"chrom": "d_chrom", "lo": "d_lo", "hi": "d_hi", "element": "d_element", "simple": "d_simple"})
    i = known.withColumnsRenamed({"chrom": "i_chrom", "lo": "i_lo", "hi": "i_hi", "element": "i_element", "simple": "i_simple"})
    at = lambda p, lo, hi: (F.col("event") != "transl_inter") & (F.col("chrom") == F.col(f"{p}_chrom")) & (F.col(lo) == F.col(f"{p}_lo")) & (F.col(hi) == F.col(f"{p}_hi"))
    met = v.join(d, at("d", "lo", "hi"), "left").join(i, at("i", "mlo", "mhi"), "left")
    return met.select("pid", "partner", "event", "start", "end", F.col("d_element").alias("element"), F.col("i_element").alias("inserted_element"), F.expr(mechanism("event", "homology", "inserted", "d_element", "i_element", "coalesce(d_simple, false)", "coalesce(i_simple, false)")).alias("mechanism"))


def e18_annotation(spark: SparkSession, folder: str) -> DataFrame:
    """What stands at both ends of an event, and at both ends of what it inserts, as `BP:x_y` or `BP:x_y_z_w`: SR in a simple repeat, else TE in a mobile element, else nothing."""
    v = _variants(spark, folder)
    ends = [("chrom", "start"), ("mate_chrom", "end"), ("mate_chrom", "mate_start"), ("mate_chrom", "mate_end")]
    points = None
    for c, p in ends:
        part = v.where(F.col(p).isNotNull()).select(F.col(c).alias("pchrom"), F.col(p).alias("at"))
        points = part if points is None else points.unionByName(part)
    points = points.distinct().withColumn("id", F.struct("pchrom", "at"))
    r = repeats(spark, folder).withColumnsRenamed({"chrom": "rchrom", "s": "rs", "e": "re"})
    points = exists_overlap(points, r.where("rclass in ('SIMPLE_REPEAT', 'SATELLITE', 'LOW_COMPLEXITY')"), "id", [("pchrom", "rchrom")], ("at", "at"), ("rs", "re"), "sr")
    points = exists_overlap(points, r.where("rclass in ('LINE', 'SINE', 'LTR', 'DNA')"), "id", [("pchrom", "rchrom")], ("at", "at"), ("rs", "re"), "te")
    named = checkpointed(points.select("pchrom", "at", F.when(F.col("sr"), "SR").when(F.col("te"), "TE").otherwise("").alias("part")))
    for i, (c, p) in enumerate(ends):
        side = named.withColumnsRenamed({"pchrom": f"c{i}", "at": f"at{i}", "part": f"part{i}"})
        v = v.join(side, (F.col(c) == F.col(f"c{i}")) & (F.col(p) == F.col(f"at{i}")), "left").drop(f"c{i}", f"at{i}")
    kind = F.concat(F.lit("BP:"), F.concat_ws("_", *[f"part{i}" for i in range(4)]))
    return v.select("pid", "partner", "rule", "event", "chrom", "mate_chrom", "start", "end", kind.alias("kind"))


_SPAN_EVENTS = "('del', 'del_ins', 'invers', 'invers_f', 'invers_r', 'tandem_dup')"


def _windows(v: DataFrame) -> DataFrame:
    """The windows at which a variant is compared: its range; both points of a translocation; both ranges of an insertion or an inversion with a deletion."""
    point = lambda c, at: F.struct(F.col(c).alias("wchrom"), F.col(at).alias("lo"), F.col(at).alias("hi"))
    span = lambda c, a, b: F.struct(F.col(c).alias("wchrom"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    one = F.array(span("chrom", "start", "end"))
    both = F.when(F.col("event") == "transl_inter", F.array(point("chrom", "start"), point("mate_chrom", "end"))).when(F.expr(f"event in {_SPAN_EVENTS}"), one).otherwise(F.array(span("chrom", "start", "end"), span("mate_chrom", "mate_start", "mate_end")))
    return v.select("*", F.explode(both).alias("w")).select("*", "w.*").drop("w")


_WINDOWS = f"""w as (select *, chrom as wchrom, least(start, "end") as lo, greatest(start, "end") as hi from v where event in {_SPAN_EVENTS}
  union all select *, chrom, start, start from v where event = 'transl_inter' union all select *, mate_chrom, "end", "end" from v where event = 'transl_inter'
  union all select *, chrom, least(start, "end"), greatest(start, "end") from v where event not in {_SPAN_EVENTS} and event <> 'transl_inter'
  union all select *, mate_chrom, least(mate_start, mate_end), greatest(mate_start, mate_end) from v where event not in {_SPAN_EVENTS} and event <> 'transl_inter')"""


def j12_copy_number(spark: SparkSession, folder: str) -> DataFrame:
    """Variants with the annotated ranges that their windows meet, if these are at most 3. Variants that meet more are told by counts, so no pairs are made of them. A variant on a chromosome without any range has none."""
    v = _variants(spark, folder)
    ranges = repeats(spark, folder).where("rname is not null and chrom is not null").select(F.col("chrom").alias("wchrom"), "s", "e", "rname").distinct()
    id_ = F.struct("pid", "partner", "rule", "event", "chrom", "mate_chrom", "start", "end", "mate_start", "mate_end")
    w = _windows(v).withColumn("sv", id_)
    covered = w.join(ranges.select("wchrom").distinct().withColumn("there", F.lit(True)), "wchrom", "left")
    counted = checkpointed(overlap_counts(covered, ranges, ["wchrom"], ("lo", "hi"), ("s", "e"), "n"))
    few = counted.groupBy("sv").agg(F.max("n").alias("most"), F.bool_and(F.coalesce("there", F.lit(False))).alias("all")).where(f"`all` and most between 1 and {CUTOFF}").select(F.col("sv").alias("few_sv"))
    asked = counted.where("n > 0").join(few, F.col("sv").eqNullSafe(F.col("few_sv")), "left_semi").select("sv", "wchrom", "lo", "hi")
    hits = overlap_join(asked, ranges.withColumnRenamed("wchrom", "rchrom"), [("wchrom", "rchrom")], ("lo", "hi"), ("s", "e")).select("sv", "rchrom", "s", "e", "rname").distinct()
    per = hits.groupBy("sv").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("rname")).alias("names")).where(f"n <= {CUTOFF}")  # 6 at most
    return per.select("sv.pid", "sv.partner", "sv.rule", "sv.event", "sv.start", "sv.end", "n", F.array_join("names", "/").alias("names"))


def j13_cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Variants of one cohort (even clusters) against those of another (odd ones, in groups): S with group and cluster for each of an equal type, and of a size less than 10 different but for translocations, that shares a position; D if there is none."""
    w = _windows(_variants(spark, folder)).withColumn("sized", F.col("event") != "transl_inter")
    # Equal sizes meet in buckets of 10, so that ranges that overlap by their length alone make no pairs.
    bucket = F.expr(f"size div {SIZE_TOLERANCE}")
    mine = w.where("pid % 2 = 0").withColumn("bucket", F.explode(F.when(F.col("sized"), F.array(bucket - 1, bucket, bucket + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    other = w.where("pid % 2 = 1").select(F.col("wchrom").alias("o_chrom"), F.col("event").alias("o_event"), F.when(F.col("sized"), bucket).otherwise(0).cast("long").alias("o_bucket"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), F.col("size").alias("o_size"), F.col("pid").alias("other"), F.col("partner").alias("other_partner"))
    hits = overlap_join(mine, other, [("wchrom", "o_chrom"), ("event", "o_event"), ("bucket", "o_bucket")], ("lo", "hi"), ("o_lo", "o_hi")).where(f"not sized or abs(size - o_size) < {SIZE_TOLERANCE}")
    id_ = ["pid", "partner", "rule", "event", "start", "end"]
    hits = hits.select(*id_, "other", "other_partner").distinct()
    mine = w.where("pid % 2 = 0").select(*id_).distinct()
    found = hits.select(*id_).distinct()
    same = F.lit(True)
    for c in id_:
        same &= F.col(c).eqNullSafe(F.col(f"h_{c}"))
    alone = mine.join(found.withColumnsRenamed({c: f"h_{c}" for c in id_}), same, "left_anti")
    none = F.lit(None).cast("long")
    return hits.select(F.lit("S").alias("label"), *id_, (F.col("other") % 4).alias("group_id"), "other", "other_partner").unionByName(alone.select(F.lit("D").alias("label"), *id_, none.alias("group_id"), none.alias("other"), none.alias("other_partner")))


_INTER = f"""with {MEMBERS_SQL}, {CLUSTERS_SQL}, c as (select * from cl where chrom <> mate_chrom)
, x as (select i.pid, i.chrom, i.mate_chrom, i.t, k.pid as partner, row_number() over (partition by i.pid, i.chrom, i.mate_chrom, i.t order by abs(i.s1 - k.s1), k.pid) as r1, row_number() over (partition by i.pid, i.chrom, i.mate_chrom, i.t order by abs(i.m1 - k.m1), k.pid) as r2
  from c i join c k on i.t in (0, 1) and k.t = 3 - i.t and i.chrom = k.chrom and i.mate_chrom = k.mate_chrom and i.pid <> k.pid)
, y as (select *, row_number() over (partition by pid, chrom, mate_chrom, t order by r1) as no from x where r1 <= 4 and r2 <= 4), j9 as (select * from y where no = 1)
, b as (select j9.pid, j9.partner, j9.chrom as ci, j9.mate_chrom as cm, j9.t, i.s2, i.m1, i.m2, k.s1 as ks1, k.m1 as km1, k.m2 as km2 from j9 join c i on i.pid = j9.pid and i.chrom = j9.chrom and i.mate_chrom = j9.mate_chrom and i.t = j9.t
  join c k on k.pid = j9.partner and k.chrom = j9.chrom and k.mate_chrom = j9.mate_chrom and k.t = 3 - j9.t where j9.chrom < j9.mate_chrom)
, e as (select pid, partner, 'inso' as name, 'A' as side, ci as chrom, s2 as start, ks1 as "end", cm as mate_chrom, km1 as mate_start, m2 as mate_end, ks1 - s2 - 1 as deleted, m2 - km1 + 1 as inserted from b where t = 1 and m2 > km1
  union all select pid, partner, 'inso', 'B', cm, m2, km1, ci, ks1, s2, km1 - m2 - 1, s2 - ks1 + 1 from b where t = 1 and not m2 > km1 and s2 > ks1
  union all select pid, partner, 'inss', 'A', ci, s2, ks1, cm, m1, km2, ks1 - s2 - 1, km2 - m1 + 1 from b where t = 0 and km2 > m1
  union all select pid, partner, 'inss', 'B', cm, km2, m1, ci, ks1, s2, m1 - km2 - 1, s2 - ks1 + 1 from b where t = 0 and not km2 > m1 and s2 > ks1)
, inter as (select pid, partner, case when deleted >= 100 then 'del_' else '' end || name as event, side, chrom, start, "end", mate_chrom, mate_start, mate_end, deleted, inserted from e where deleted < {LARGEST} and inserted < {LARGEST})"""

_SIZED = "abs(v.size) + abs(coalesce(v.inserted, 0))"

SQL = {
    "j9_two_rankings": f"{_INTER} select pid, chrom, mate_chrom, t, partner, r1, r2 from j9",
    "e6_inter": f"{_INTER} select * from inter",
    "e14_inter_demoted": f"""{_INTER}, k as (select *, (abs(deleted) + abs(inserted), pid, partner) as key from inter), best as (select c, min(key) as best from (select pid as c, key from k union all select partner, key from k) group by c)
, h as (select k.*, k.key = x.best and k.key = y.best as kept from k join best x on x.c = k.pid join best y on y.c = k.partner)
select pid, partner, event, chrom, start, mate_chrom, mate_start, null::int as strand, null::int as mate_strand from h where kept
union all select pid, null, 'transl_inter', least(chrom, mate_chrom), case when chrom > mate_chrom then mate_end else start end, greatest(chrom, mate_chrom), case when chrom > mate_chrom then start else mate_start end, 1, case when event in ('inss', 'del_inss') then -1 else 1 end from h where not kept""",
    "a24_filtered": f"""{_VARIANTS}, k as (select v.*, ({_SIZED}, event, start, "end", pid, coalesce(partner, -1), mate_start, mate_end) as key from v where event <> 'transl_inter'), best as (select c, min(key) as best from (select pid as c, key from k union all select partner, key from k where partner is not null) group by c)
, h as (select k.*, (k.key <> x.best)::int + coalesce((k.key <> y.best)::int, 0) as lost from k join best x on x.c = k.pid left join best y on y.c = k.partner)
, l as (select *, lost = 1 and (rule in ('inssd', 'inssu', 'insod', 'insou') or event = 'del_invers') as down from h where lost = 0 or (partner is not null and lost = 1))
select case when not down then event when rule in ('inssd', 'inssu') then 'tandem_dup' else 'invers_f' end as event, chrom,
  case when not down then start when rule = 'inssd' then "end" when rule = 'inssu' then mate_start when rule = 'insou' then mate_end else start end as start,
  case when not down then "end" when rule in ('inssu', 'insou') then start else mate_end end as "end", case when down then "end" - start else size end as size, case when not down then mate_start end as mate_start, case when not down then mate_end end as mate_end, count(*) as n
from l group by 1, 2, 3, 4, 5, 6, 7""",
    "e17_mechanism": f"""{_VARIANTS}, {REPEATS_SQL}, sp as (select distinct chrom, least(start, "end") as lo, greatest(start, "end") as hi from v where event <> 'transl_inter' union select chrom, least(mate_start, mate_end), greatest(mate_start, mate_end) from v where mate_start is not null)
, x as (select sp.*, r.s, r.e, r.rname, r.rclass, least(hi, e) - greatest(lo, s) + 1 as shared, hi - lo + 1 as own from sp join reps r on r.chrom = sp.chrom and r.s <= hi and r.e >= lo where hi - lo <= 100000)
, te as (select chrom, lo, hi, own, arg_min(rname, (s, e, rname)) filter (shared >= 0.8::double * own and shared >= 0.8::double * (e - s + 1)) as first, sum(shared) as total from x where rname is not null and rclass in ('LINE', 'SINE', 'LTR', 'DNA') group by all)
, el as (select chrom, lo, hi, coalesce(first, case when total >= 0.8::double * own then 'complex' end) as element from te), sr as (select distinct chrom, lo, hi from x where rclass in ('SIMPLE_REPEAT', 'SATELLITE', 'LOW_COMPLEXITY') and shared >= 0.8::double * own)
, m as (select v.*, d.element as de, i.element as ie, ds.lo is not null as dv, iv.lo is not null as iv from v left join el d on event <> 'transl_inter' and d.chrom = v.chrom and d.lo = least(start, "end") and d.hi = greatest(start, "end") left join el i on i.chrom = v.chrom and i.lo = least(mate_start, mate_end) and i.hi = greatest(mate_start, mate_end)
  left join sr ds on event <> 'transl_inter' and ds.chrom = v.chrom and ds.lo = least(start, "end") and ds.hi = greatest(start, "end") left join sr iv on iv.chrom = v.chrom and iv.lo = least(mate_start, mate_end) and iv.hi = greatest(mate_start, mate_end))
select pid, partner, event, start, "end", de as element, ie as inserted_element, case
  when event = 'del' and de is not null then 'TEI' when event = 'del' and dv then 'VNTR' when event = 'del' and homology > 100 then 'NAHR' when event = 'del' and homology > 1 then 'alt-EJ' when event = 'del' then 'NHEJ'
  when event like 'del\\_ins%' escape '\\' then case when de is not null and ie is not null then 'TEA' when ie is not null then 'TEI' when dv and iv then 'VNTR' when inserted < 11 then 'NHEJ' else 'NA' end
  when event like 'ins%' then case when ie is not null then 'TEI' when iv then 'VNTR' else 'NA' end
  when event = 'del_invers' then 'FoSTeS' when event = 'tandem_dup' and dv then 'VNTR' else 'NA' end as mechanism from m""",
    "e18_annotation": f"""{_VARIANTS}, {REPEATS_SQL}, pt as (select chrom as c, start as at_ from v union select mate_chrom, "end" from v union select mate_chrom, mate_start from v where mate_start is not null union select mate_chrom, mate_end from v where mate_end is not null)
, k as (select pt.c, pt.at_, case when bool_or(rclass in ('SIMPLE_REPEAT', 'SATELLITE', 'LOW_COMPLEXITY')) then 'SR' when bool_or(rclass in ('LINE', 'SINE', 'LTR', 'DNA')) then 'TE' else '' end as part from pt left join reps r on r.chrom = pt.c and pt.at_ between r.s and r.e group by pt.c, pt.at_)
select pid, partner, rule, event, chrom, mate_chrom, start, "end", 'BP:' || a.part || '_' || b.part || coalesce('_' || x.part || '_' || y.part, '') as kind from v join k a on a.c = chrom and a.at_ = start join k b on b.c = mate_chrom and b.at_ = "end" left join k x on x.c = mate_chrom and x.at_ = mate_start left join k y on y.c = mate_chrom and y.at_ = mate_end""",
    "j12_copy_number": f"""{_VARIANTS}, {_WINDOWS}, {REPEATS_SQL}, g as (select distinct chrom as rchrom, s, e, rname from reps where rname is not null and chrom is not null)
, ok as (select pid, partner, rule, event, chrom, mate_chrom, start, "end", mate_start, mate_end, bool_and(wchrom in (select rchrom from g)) as every from w group by all)
, h as (select distinct w.pid, w.partner, w.rule, w.event, w.chrom, w.mate_chrom, w.start, w."end", w.mate_start, w.mate_end, rchrom, s, e, rname from w join g on g.rchrom = w.wchrom and g.s <= w.hi and g.e >= w.lo)
, n as (select pid, partner, rule, event, chrom, mate_chrom, start, "end", mate_start, mate_end, count(*) as n, array_to_string(list_sort(list(rname)), '/') as names from h group by all)
select n.pid, n.partner, n.rule, n.event, n.start, n."end", n.n, n.names from n join ok on ok.pid = n.pid and ok.partner is not distinct from n.partner and ok.rule = n.rule and ok.event = n.event and ok.chrom = n.chrom and ok.mate_chrom = n.mate_chrom and ok.start = n.start and ok."end" = n."end" and ok.mate_start is not distinct from n.mate_start and ok.mate_end is not distinct from n.mate_end
where n.n <= 3 and every""",
    "j13_cohort": f"""{_VARIANTS}, {_WINDOWS}, h as (select distinct a.pid, a.partner, a.rule, a.event, a.start, a."end", b.pid as other, b.partner as other_partner from w a join w b on a.pid % 2 = 0 and b.pid % 2 = 1 and a.event = b.event and a.wchrom = b.wchrom and a.lo <= b.hi and b.lo <= a.hi and (a.event = 'transl_inter' or abs(a.size - b.size) < 10))
select 'S' as label, pid, partner, rule, event, start, "end", other % 4 as group_id, other, other_partner from h
union all select 'D', pid, partner, rule, event, start, "end", null, null, null from (select distinct pid, partner, rule, event, start, "end" from v where pid % 2 = 0) a where not exists (select 1 from h where h.pid = a.pid and h.partner is not distinct from a.partner and h.rule = a.rule and h.event = a.event and h.start = a.start and h."end" = a."end")""",
}

QUERIES = {f.__name__: f for f in (j9_two_rankings, e6_inter, e14_inter_demoted, a24_filtered, e17_mechanism, e18_annotation, j12_copy_number, j13_cohort)}
