"""Clusters of records, strand pairs, consensus positions and confidence (the insertion pipeline), and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.operators.carry import running
from strandwise.operators.gap_clusters import gap_clusters, wildcard_clusters
from strandwise.operators.intervals import exists_overlap, first_overlap, overlap_join
from strandwise.operators.pairing import WILDCARD, confidence, insertion_score, pair_strands, signal_to_noise, strand_modes
from strandwise.plans.records import GENES_SQL, PAIRS_SQL, REPEATS_SQL, gene_spans, pairs, repeats
from strandwise.runtime import checkpointed

GAP = 2_000
WILDCARD_GAP = 250
PAIR_GAP = 4_000
FRAGMENT = 500
MIN_RAM = 3
REPEAT_MARGIN = 500
JITTER = 2
READ_LEN = 100
MARGIN = 300


def _family() -> Column:
    return F.when(F.col("nm") == 0, WILDCARD).when(F.col("nm") % 2 == 1, "LINE").otherwise("SINE")


def _anchored(spark: SparkSession, folder: str) -> DataFrame:
    """records with known mismatches, as repeat-anchored mates; the family is bound to the mismatches."""
    rows = pairs(spark, folder).where("chrom is not null and pos is not null and name is not null and nm is not null")
    return rows.select("id", "name", "chrom", "strand", "pos", "nm", "len", "mate_pos", _family().alias("family"))


def w1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Gap clusters of each chromosome and strand; all members count, families and reads once."""
    rows = gap_clusters(_anchored(spark, folder), ["chrom", "strand"], "pos", GAP)
    # Map-side: members of a hot read or position are added up before they are shuffled to their cluster.
    return rows.groupBy("chrom", "strand", F.col("cluster_start").alias("s")).agg(F.max("pos").alias("e"), F.count(F.lit(1)).alias("ram"), F.count_distinct("name").alias("reads"), F.array_sort(F.collect_set("family")).alias("families"))


_ANCHORED = f"anchored as (select id, name, chrom, strand, pos, nm, len, mate_pos, case when nm = 0 then '{WILDCARD}' when nm % 2 = 1 then 'LINE' else 'SINE' end as family from pairs where chrom is not null and pos is not null and name is not null and nm is not null)"
_CLUSTERS = f"""{_ANCHORED}, lagged as (select *, lag(pos) over (partition by chrom, strand order by pos) as before from anchored)
, opened as (select *, max(case when before is null or pos - before > {GAP} then pos end) over (partition by chrom, strand order by pos) as s from lagged)
, clusters_ as (select chrom, strand, s, max(pos) as e, count(*) as ram, count(distinct name) as reads, list_sort(list(distinct family)) as families from opened group by chrom, strand, s)"""


def w1_wildcard(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters by family in which wildcard records join those of the other families, numbered from 0 along each chromosome, strand and family."""
    # A step above the gap ends the open clusters of all families, so runs without one can be scanned apart.
    rows = gap_clusters(_anchored(spark, folder), ["chrom", "strand"], "pos", WILDCARD_GAP).withColumnRenamed("cluster_start", "run")
    members = wildcard_clusters(rows, ["chrom", "strand", "run"], "family", "pos", "id", WILDCARD_GAP, WILDCARD)
    clusters = members.groupBy("chrom", "strand", "family", "run", "cluster_no").agg(F.min("pos").alias("s"), F.max("pos").alias("e"), F.count(F.lit(1)).alias("ram")).drop("run", "cluster_no")
    numbered = running(checkpointed(clusters).withColumn("one", F.lit(1).cast("long")), ["chrom", "strand", "family"], "s", "one", "before", "sum", inclusive=False)
    return numbered.select("chrom", "strand", "family", F.coalesce("before", F.lit(0)).alias("cluster_no"), "s", "e", "ram")


def j7_strand_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a plus and a minus cluster, with at least 3 records together; wildcard-only clusters pair with others only."""
    # Both sides come from it, so the clusters are made once.
    c = checkpointed(w1_clusters(spark, folder).select("chrom", "strand", "s", "e", "ram", "families"))
    paired = pair_strands(c.where("strand = 1").drop("strand"), c.where("strand = -1").drop("strand"), PAIR_GAP, READ_LEN)
    return paired.where("p_ram + n_ram >= 3").select(F.col("p_chrom").alias("chrom"), "p_s", "p_e", "n_s", "n_e", "p_ram", "n_ram")


_PAIRS = f"""{_CLUSTERS}, paired as (
  select p.chrom, p.s as p_s, p.e as p_e, n.s as n_s, n.e as n_e, p.ram as p_ram, n.ram as n_ram, p.families as p_families, n.families as n_families
  from clusters_ p join clusters_ n on p.strand = 1 and n.strand = -1 and p.chrom = n.chrom and n.s <= p.e + {PAIR_GAP} and n.e >= p.s
  where n.e - p.s + {READ_LEN} > {2 * READ_LEN + 10} and p.s <= n.s and p.e <= n.e and p.ram + n.ram >= 3
    and (list_has_all(list_append(p.families, '{WILDCARD}'), n.families) or p.families = ['{WILDCARD}']) and not (p.families = ['{WILDCARD}'] and n.families = ['{WILDCARD}']))"""


def w7_adjacent(spark: SparkSession, folder: str) -> DataFrame:
    """Of the pairs that share a start or an end the one with most records; ties keep the earlier."""
    return _reduced(j7_strand_pairs(spark, folder)).select("chrom", "p_s", "p_e", "n_s", "n_e", "size")


def _reduced(pairs_: DataFrame) -> DataFrame:
    p = pairs_.withColumn("size", F.col("p_ram") + F.col("n_ram"))
    best = lambda *k: F.row_number().over(Window.partitionBy("chrom", *k).orderBy(F.desc("size"), "p_s", "n_s"))
    return p.withColumns({"a": best("p_s"), "b": best("n_e")}).where("a = 1 and b = 1").drop("a", "b")


def _clips(spark: SparkSession, folder: str) -> DataFrame:
    """Clip votes: the position of a record, and the position after its mismatches are trimmed, once each."""
    return _clipped(spark, folder).select("chrom", "strand", F.explode(F.array_distinct(F.array(F.col("pos"), F.col("trimmed")))).alias("pos"))


def _clipped(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs(spark, folder).where("chrom is not null and pos is not null and nm > 0 and len >= 25")
    return rows.select("chrom", "strand", "pos", (F.col("pos") + F.col("nm")).alias("trimmed"))


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    """pairs of clusters, and clusters of one strand that are in no pair and not of the wildcard alone, with at least 3 records: kind, chrom, s, e, and the parts of both sides (null for a side that is not there)."""
    c = checkpointed(w1_clusters(spark, folder).select("chrom", "strand", "s", "e", "ram", "families"))
    plus, minus = c.where("strand = 1").drop("strand"), c.where("strand = -1").drop("strand")
    paired = checkpointed(pair_strands(plus, minus, PAIR_GAP, READ_LEN))
    parts = ["s", "e", "ram", "families"]
    both = _reduced(paired.where(F.col("p_ram") + F.col("n_ram") >= MIN_RAM).withColumn("chrom", F.col("p_chrom")))
    both = both.select(F.lit("pair").alias("kind"), "chrom", F.col("p_s").alias("lo"), (F.col("n_e") + READ_LEN).alias("hi"), *[f"{x}_{c}" for x in "pn" for c in parts])

    def alone(side: DataFrame, x: str, kind: str) -> DataFrame:
        taken = paired.select(F.col(f"{x}_chrom").alias("chrom"), F.col(f"{x}_s").alias("s")).distinct()
        rows = side.join(taken, ["chrom", "s"], "left_anti").where(F.col("families") != F.array(F.lit(WILDCARD))).where(F.col("ram") >= MIN_RAM)
        lo, hi = (F.col("s"), F.col("e") + READ_LEN + FRAGMENT) if x == "p" else (F.col("s") - FRAGMENT, F.col("e") + READ_LEN)
        none = {f"{y}_{c}": F.lit(None).cast(side.schema[c].dataType) for y in "pn" if y != x for c in parts}
        own = {f"{x}_{c}": F.col(c) for c in parts}
        return rows.select(F.lit(kind).alias("kind"), "chrom", lo.alias("lo"), hi.alias("hi"), *[(own | none)[f"{y}_{c}"].alias(f"{y}_{c}") for y in "pn" for c in parts])

    return both.unionByName(alone(plus, "p", "plus")).unionByName(alone(minus, "n", "minus"))


def _named_families(*sides: str):
    """The families of the sides, without the wildcard unless it is the only one."""
    every = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in sides])))
    return F.when(F.size(every) > 1, F.array_remove(every, WILDCARD)).otherwise(every)


def k5_raw_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The raw clusters in their three forms: a pair, a plus cluster alone, a minus cluster alone."""
    r = _raw(spark, folder)
    ram = lambda x: F.coalesce(f"{x}_ram", F.lit(0))
    family = lambda *x: F.array_join(_named_families(*[f"{y}_families" for y in x]), ",")
    own = lambda x: F.when(F.col(f"{x}_families").isNotNull(), family(x)).otherwise("")
    return r.select("kind", "chrom", F.col("lo").alias("s"), F.col("hi").alias("e"), (F.col("hi") - F.col("lo") + 1).alias("size"), family("p", "n").alias("families"), own("p").alias("p_families"), own("n").alias("n_families"), (ram("p") + ram("n")).alias("ram"), ram("p").alias("pram"), ram("n").alias("nram"), F.col("p_s").alias("pram_start"), F.col("p_e").alias("pram_end"), F.col("n_s").alias("nram_start"), F.col("n_e").alias("nram_end"))


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    """The raw clusters with the range in which clips are looked for, and what identifies them."""
    r = _raw(spark, folder)
    fetch = {
        "from": F.when(F.col("kind") == "pair", F.col("p_e") - READ_LEN).when(F.col("kind") == "plus", F.least(F.col("lo") + READ_LEN, F.col("p_e"))).otherwise(F.col("lo") + READ_LEN),
        "to": F.when(F.col("kind") == "pair", F.col("hi")).when(F.col("kind") == "plus", F.col("hi") - READ_LEN).otherwise(F.greatest(F.col("hi") - READ_LEN, F.col("n_s"))),
    }
    return checkpointed(r.withColumns({**fetch, "families": _named_families("p_families", "n_families"), "id": F.struct("chrom", "kind", F.col("lo").alias("s"), F.col("hi").alias("e"))}))


def _voted(spark: SparkSession, folder: str, regions: DataFrame) -> DataFrame:
    votes = _clips(spark, folder).select(F.col("chrom").alias("vchrom"), "strand", "pos")
    return overlap_join(regions.select("id", "chrom", "from", "to"), votes, [("chrom", "vchrom")], ("from", "to"), ("pos", "pos")).select("id", "strand", "pos")


_RAW = f"""{_CLUSTERS}, prs as (
  select p.chrom, p.s as p_s, p.e as p_e, n.s as n_s, n.e as n_e, p.ram as p_ram, n.ram as n_ram, p.families as p_families, n.families as n_families
  from clusters_ p join clusters_ n on p.strand = 1 and n.strand = -1 and p.chrom = n.chrom and n.s <= p.e + {PAIR_GAP} and n.e >= p.s
  where n.e - p.s > {READ_LEN + 10} and p.s <= n.s and p.e <= n.e
    and (list_has_all(list_append(p.families, '{WILDCARD}'), n.families) or p.families = ['{WILDCARD}']) and not (p.families = ['{WILDCARD}'] and n.families = ['{WILDCARD}']))
, best as (select *, p_ram + n_ram as size, row_number() over (partition by chrom, p_s order by p_ram + n_ram desc, p_s, n_s) as a, row_number() over (partition by chrom, n_e order by p_ram + n_ram desc, p_s, n_s) as b from prs where p_ram + n_ram >= {MIN_RAM})
, raw as (select 'pair' as kind, chrom, p_s as lo, n_e + {READ_LEN} as hi, p_s, p_e, p_ram, p_families, n_s, n_e, n_ram, n_families from best where a = 1 and b = 1
  union all select 'plus', chrom, s, e + {READ_LEN + FRAGMENT}, s, e, ram, families, null, null, null, null from clusters_ c where strand = 1 and ram >= {MIN_RAM} and families <> ['{WILDCARD}'] and not exists (select 1 from prs p where p.chrom = c.chrom and p.p_s = c.s)
  union all select 'minus', chrom, s - {FRAGMENT}, e + {READ_LEN}, null, null, null, null, s, e, ram, families from clusters_ c where strand = -1 and ram >= {MIN_RAM} and families <> ['{WILDCARD}'] and not exists (select 1 from prs p where p.chrom = c.chrom and p.n_s = c.s))
, fam as (select *, list_sort(list_distinct(list_concat(coalesce(p_families, []), coalesce(n_families, [])))) as every from raw)
, regions as (select * exclude (every), case when len(every) > 1 then list_filter(every, lambda x: x <> '{WILDCARD}') else every end as families,
    case kind when 'pair' then p_e - {READ_LEN} when 'plus' then least(lo + {READ_LEN}, p_e) else lo + {READ_LEN} end as "from", case kind when 'pair' then hi when 'plus' then hi - {READ_LEN} else greatest(hi - {READ_LEN}, n_s) end as "to" from fam)"""
_VOTED = f"""{_RAW}, clipped as (select chrom, strand, pos, pos + nm as trimmed from pairs where chrom is not null and pos is not null and nm > 0 and len >= 25)
, clips as (select chrom, strand, unnest(list_distinct([pos, trimmed])) as pos from clipped)
, votes as (select r.chrom, r.kind, r.lo, r.hi, c.strand, c.pos from regions r join clips c on c.chrom = r.chrom and c.pos between r."from" and r."to")"""


def a10_clip_votes(spark: SparkSession, folder: str) -> DataFrame:
    """How often each position of each strand is voted for in each region."""
    return _voted(spark, folder, _regions(spark, folder)).groupBy("id", "strand", "pos").agg(F.count(F.lit(1)).alias("n")).select("id.*", "strand", "pos", "n")


def a11_breakpoints(spark: SparkSession, folder: str) -> DataFrame:
    """The breakpoints of each region by mode, ties and partner search."""
    return strand_modes(_voted(spark, folder, _regions(spark, folder)), "id", MARGIN).select("id.*", "pbp", "nbp", "p_votes", "n_votes")


def a16_aligned(spark: SparkSession, folder: str) -> DataFrame:
    """Clipped records of each region by strand, and how many stand at its breakpoint: the position that stands for one is the clipped one if it or the trimmed one is within 2 of the breakpoint, else the trimmed one."""
    regions = _regions(spark, folder)
    bp = strand_modes(_voted(spark, folder, regions), "id", MARGIN)
    rows = _clipped(spark, folder).select(F.col("chrom").alias("vchrom"), "strand", "pos", "trimmed").where("strand in (1, -1)")
    met = overlap_join(regions.select("id", "chrom", "from", "to"), rows, [("chrom", "vchrom")], ("from", "to"), ("pos", "pos")).join(bp.select("id", "pbp", "nbp"), "id")
    at = F.when(F.col("strand") == 1, F.col("pbp")).otherwise(F.col("nbp"))
    off = lambda c: F.abs(F.col(c) - at)
    rep = F.when(F.least(off("pos"), off("trimmed")) <= JITTER, F.col("pos")).otherwise(F.col("trimmed"))
    return met.withColumn("aligned", F.abs(rep - at) <= JITTER).groupBy("id", "strand").agg(F.count(F.lit(1)).alias("n"), F.count_if("aligned").alias("aligned")).select("id.*", "strand", "n", "aligned")


def _insertions(spark: SparkSession, folder: str) -> DataFrame:
    """One row a region, also of one side."""
    regions = _regions(spark, folder)
    votes = checkpointed(_voted(spark, folder, regions))
    bp = strand_modes(votes, "id", MARGIN)
    crs = votes.groupBy("id").agg(F.count_if(F.col("strand") == 1).alias("pcr"), F.count_if(F.col("strand") == -1).alias("ncr"))
    spot = checkpointed(regions.join(bp, "id").join(crs, "id"))
    rows = _anchored(spark, folder).select(F.col("chrom").alias("rchrom"), F.col("strand").alias("rstrand"), F.col("pos").alias("rpos"))
    sides = overlap_join(spot.select("id", "chrom", "lo", "hi", "pbp", "nbp"), rows, [("chrom", "rchrom")], ("lo", "hi"), ("rpos", "rpos"))
    count = lambda s, test: F.count_if((F.col("rstrand") == s) & test)
    sides = sides.groupBy("id").agg(count(1, F.col("rpos") <= F.col("nbp")).alias("p_in"), count(-1, F.col("rpos") >= F.col("pbp")).alias("n_in"), count(1, F.col("rpos") > F.col("nbp")).alias("p_out"), count(-1, F.col("rpos") < F.col("pbp")).alias("n_out"))
    middle = F.expr("cast((lo + hi) / 2 as bigint)")
    known = F.col("pbp").isNotNull() & F.col("nbp").isNotNull()
    around = spot.withColumns({"rs": F.when(known, F.least("pbp", "nbp")).otherwise(middle) - REPEAT_MARGIN, "re": F.when(known, F.greatest("pbp", "nbp")).otherwise(middle) + REPEAT_MARGIN})
    reps = repeats(spark, folder).where("rclass is not null").select(F.col("chrom").alias("qchrom"), F.col("s").alias("qs"), F.col("e").alias("qe"), "rclass")
    flagged = exists_overlap(around, reps, "id", [("chrom", "qchrom")], ("rs", "re"), ("qs", "qe"), "same_repeat", F.array_contains("families", F.col("rclass")))
    c = F.col
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    acr = zero("p_votes") + zero("n_votes")
    out = flagged.join(sides, "id", "left").withColumns({"pacr": zero("p_votes"), "nacr": zero("n_votes"), "acr": acr, "acrr": acr / (c("pcr") + c("ncr")), "tsd": F.coalesce(c("nbp") - c("pbp") - 1, F.lit(-9999)), "pram": zero("p_ram"), "nram": zero("n_ram"), "oi": F.when(c("same_repeat"), 0).otherwise(1), **{x: zero(x) for x in ("p_in", "n_in", "p_out", "n_out")}})
    ram = c("pram") + c("nram")
    conf = confidence(c("acr"), c("pacr"), c("nacr"), c("acrr"), c("tsd"), ram, c("oi"), c("kind") == "pair")
    return out.withColumns({"ram": ram, "score": F.round(insertion_score(c("pram"), c("nram"), c("pacr"), c("nacr")), 9), "s2n": F.round(signal_to_noise(c("p_in"), c("n_in"), c("p_out"), c("n_out")), 9), "acrr": F.round("acrr", 9), "conf": conf})


_OUT = ["kind", "chrom", "s", "e", "families", "pbp", "nbp", "tsd", "ram", "pram", "nram", "cr", "pcr", "ncr", "acr", "pacr", "nacr", "acrr", "score", "s2n", "oi", "conf"]


def a15_insertions(spark: SparkSession, folder: str) -> DataFrame:
    """Clip figures, score, signal to noise, reference repeat and confidence of each region, also of those with one side; those that a reference repeat explains have confidence 0."""
    found = _insertions(spark, folder)
    return found.select(*[{"s": F.col("lo"), "e": F.col("hi"), "cr": F.col("pcr") + F.col("ncr"), "families": F.array_join("families", ",")}.get(x, F.col(x)).alias(x) for x in _OUT])


def f23_emitted(spark: SparkSession, folder: str) -> DataFrame:
    """The germline table: pairs with a confidence of 1 or more, with the segment at each breakpoint, or at the middle where one is unknown."""
    found = checkpointed(_insertions(spark, folder).where("kind = 'pair' and conf >= 1").select("chrom", "lo", "hi", "pbp", "nbp", "conf"))
    segments = gene_spans(spark, folder).drop("gstrand").where("gchrom is not null and gname is not null").distinct()
    middle = F.expr("cast((lo + hi) / 2 as bigint)")
    found = found.withColumn("id", F.struct("chrom", "lo", "hi"))
    for x in "pn":
        at = F.coalesce(F.col(f"{x}bp"), middle)
        found = first_overlap(found.withColumns({"from": at - JITTER, "to": at + JITTER}), segments, "id", [("chrom", "gchrom")], ("from", "to"), ("gs", "ge"), [F.col("gs"), F.col("ge"), F.col("gname"), F.col("gtype")], {f"{x}gene": F.concat_ws("_", "gname", "gtype")})
    return found.select("chrom", F.col("lo").alias("s"), F.col("hi").alias("e"), "conf", F.coalesce("pgene", F.lit("-")).alias("pgene"), F.coalesce("ngene", F.lit("-")).alias("ngene"))


def r10_described(spark: SparkSession, folder: str) -> DataFrame:
    """The variant without segments: each region gets the descriptions of its families, and those without any in the dictionary go; the dictionary is the annotation's class and least family."""
    words = repeats(spark, folder).where("rclass is not null and rname is not null").groupBy("rclass").agg(F.min("rname").alias("description"))
    each = _insertions(spark, folder).select("kind", "chrom", F.col("lo").alias("s"), F.col("hi").alias("e"), "conf", F.explode("families").alias("rclass")).join(words, "rclass")
    return each.groupBy("kind", "chrom", "s", "e", "conf").agg(F.array_join(F.sort_array(F.collect_set("description")), "_&_").alias("description"))  # families are three


_MODES = f"""{_VOTED}, cnt as (select chrom, kind, lo, hi, strand, pos, count(*) as n from votes group by all)
, topped as (select *, max(n) over (partition by chrom, kind, lo, hi, strand) as top from cnt)
, per as (select chrom, kind, lo, hi, min(pos) filter (strand = 1 and n = top) as p0, max(top) filter (strand = 1) as p_top, count(*) filter (strand = 1 and n = top) as p_ties,
    min(pos) filter (strand = -1 and n = top) as n0, max(top) filter (strand = -1) as n_top, count(*) filter (strand = -1 and n = top) as n_ties from topped group by all)
, ruled as (select *, case when p0 is null or n0 is null then 'one' when p_ties = 1 and (p_top > n_top or n_ties > 1) then 'plus' when n_ties = 1 and (n_top > p_top or p_ties > 1) then 'minus' when p_ties > 1 and n_ties > 1 then 'tied' else 'equal' end as rule from per)
, cand as (select t.*, r.rule, r.p0, r.n0, case when rule = 'plus' then t.pos - p0 when rule = 'minus' then t.pos - n0 end as off, cast(trunc((p0 + n0) / 2) as bigint) as middle from topped t join ruled r using (chrom, kind, lo, hi))
, keyed as (select *, case
    when rule = 'plus' and strand = -1 then case when off >= 0 and off < {MARGIN} then 0 when off >= -{MARGIN} and off < 0 then 1 else 2 end
    when rule = 'minus' and strand = 1 then case when off > -{MARGIN} and off < 0 then 0 when off > 0 and off < {MARGIN} then 1 else 2 end
    when rule = 'tied' then case when n <> top then 1 else 0 end
    else case when pos <> case when strand = 1 then p0 else n0 end then 1 else 0 end end as zone from cand)
, ordered as (select *, row_number() over (partition by chrom, kind, lo, hi, strand order by zone, case
    when (rule = 'plus' and strand = -1) or (rule = 'minus' and strand = 1) then case when zone < 2 then -n else abs(off) end
    when rule = 'tied' then abs(pos - middle) else 0 end, pos) as r from keyed)
, bp as (select chrom, kind, lo, hi, max(pos) filter (strand = 1) as pbp, max(pos) filter (strand = -1) as nbp, max(n) filter (strand = 1) as p_votes, max(n) filter (strand = -1) as n_votes from ordered where r = 1 group by all)"""

_INSERTIONS = f"""{_MODES}, {REPEATS_SQL}, crs as (select chrom, kind, lo, hi, count(*) filter (strand = 1) as pcr, count(*) filter (strand = -1) as ncr from votes group by all)
, spot as (select r.*, bp.pbp, bp.nbp, coalesce(p_votes, 0) as pacr, coalesce(n_votes, 0) as nacr, pcr, ncr, cast(trunc((r.lo + r.hi) / 2) as bigint) as middle from regions r join bp using (chrom, kind, lo, hi) join crs using (chrom, kind, lo, hi))
, sides as (select s.chrom, s.kind, s.lo, s.hi, count(*) filter (a.strand = 1 and a.pos <= nbp) as p_in, count(*) filter (a.strand = -1 and a.pos >= pbp) as n_in, count(*) filter (a.strand = 1 and a.pos > nbp) as p_out, count(*) filter (a.strand = -1 and a.pos < pbp) as n_out
  from spot s join anchored a on a.chrom = s.chrom and a.pos between s.lo and s.hi group by all)
, f as (select s.*, coalesce(p_in, 0) as p_in, coalesce(n_in, 0) as n_in, coalesce(p_out, 0) as p_out, coalesce(n_out, 0) as n_out, pacr + nacr as acr, (pacr + nacr) / (pcr + ncr) as acrr, coalesce(nbp - pbp - 1, -9999) as tsd, coalesce(p_ram, 0) as pram, coalesce(n_ram, 0) as nram,
    case when exists (select 1 from reps q where q.chrom = s.chrom and list_contains(s.families, q.rclass) and q.s <= case when pbp is null or nbp is null then middle else greatest(pbp, nbp) end + {REPEAT_MARGIN} and q.e >= case when pbp is null or nbp is null then middle else least(pbp, nbp) end - {REPEAT_MARGIN}) then 0 else 1 end as oi
  from spot s left join sides using (chrom, kind, lo, hi))
, ins as (select *, pram + nram as ram, case when oi = 0 then 0 when not (acr >= 2 and (kind <> 'pair' or (pacr >= 1 and nacr >= 1))) then 1 when not acrr >= 0.4 then 2 when not tsd between -20 and 50 then 3 when not pram + nram >= 6 then 4 else 5 end as conf from f)"""

SQL = {
    "w1_clusters": f"with {PAIRS_SQL}, {_CLUSTERS} select chrom, strand, s, e, ram, reads, families from clusters_",
    "w1_wildcard": f"""with recursive {PAIRS_SQL}, {_ANCHORED}, fams as (select distinct chrom, strand, family as f from anchored), ev as materialized (select a.chrom, a.strand, f, pos, id, family = f as own, row_number() over (partition by a.chrom, a.strand, f order by pos, id) as no from anchored a join fams on fams.chrom = a.chrom and fams.strand is not distinct from a.strand and (a.family = f or (a.family = '{WILDCARD}' and f <> '{WILDCARD}')))
, w as (select chrom, strand, f, no, own as kept, own as opens, case when own then pos end as last, pos from ev where no = 1
  union all select e.chrom, e.strand, e.f, e.no, e.own or coalesce(e.pos - w.last <= {WILDCARD_GAP}, false), e.own and coalesce(e.pos - w.last > {WILDCARD_GAP}, true), case when e.own or coalesce(e.pos - w.last <= {WILDCARD_GAP}, false) then e.pos else w.last end, e.pos from w join ev e on e.chrom = w.chrom and e.strand is not distinct from w.strand and e.f = w.f and e.no = w.no + 1)
, c as (select *, sum(opens::int) over (partition by chrom, strand, f order by no) - 1 as cluster_no from w where kept)
select chrom, strand, f as family, cast(cluster_no as bigint) as cluster_no, min(pos) as s, max(pos) as e, count(*) as ram from c group by chrom, strand, f, cluster_no""",
    "j7_strand_pairs": f"with {PAIRS_SQL}, {_PAIRS} select chrom, p_s, p_e, n_s, n_e, p_ram, n_ram from paired",
    "w7_adjacent": f"with {PAIRS_SQL}, {_RAW} select chrom, p_s, p_e, n_s, n_e, p_ram + n_ram as size from regions where kind = 'pair'",
    "k5_raw_clusters": f"""with {PAIRS_SQL}, {_RAW} select kind, chrom, lo as s, hi as e, hi - lo + 1 as size, array_to_string(families, ',') as families,
  coalesce(array_to_string(case when len(p_families) > 1 then list_filter(p_families, lambda x: x <> '{WILDCARD}') else p_families end, ','), '') as p_families, coalesce(array_to_string(case when len(n_families) > 1 then list_filter(n_families, lambda x: x <> '{WILDCARD}') else n_families end, ','), '') as n_families,
  coalesce(p_ram, 0) + coalesce(n_ram, 0) as ram, coalesce(p_ram, 0) as pram, coalesce(n_ram, 0) as nram, p_s as pram_start, p_e as pram_end, n_s as nram_start, n_e as nram_end from regions""",
    "a10_clip_votes": f"with {PAIRS_SQL}, {_VOTED} select chrom, kind, lo as s, hi as e, strand, pos, count(*) as n from votes group by all",
    "a11_breakpoints": f"with {PAIRS_SQL}, {_MODES} select chrom, kind, lo as s, hi as e, pbp, nbp, p_votes, n_votes from bp",
    "a16_aligned": f"""with {PAIRS_SQL}, {_MODES}, m as (select r.chrom, r.kind, r.lo, r.hi, c.strand, c.pos, c.trimmed, case when c.strand = 1 then pbp else nbp end as spot_ from regions r join bp using (chrom, kind, lo, hi) join clipped c on c.chrom = r.chrom and c.pos between r."from" and r."to" where c.strand in (1, -1))
select chrom, kind, lo as s, hi as e, strand, count(*) as n, count(*) filter (abs(pos - spot_) <= 2) as aligned from m group by chrom, kind, lo, hi, strand""",
    "a15_insertions": f"""with {PAIRS_SQL}, {_INSERTIONS} select kind, chrom, lo as s, hi as e, array_to_string(families, ',') as families, pbp, nbp, tsd, ram, pram, nram, pcr + ncr as cr, pcr, ncr, acr, pacr, nacr, round(acrr, 9) as acrr,
  round(least(pram, 20) / 20 + least(nram, 20) / 20 + least(pacr, 10) / 10 + least(nacr, 10) / 10, 9) as score, round(2 * sqrt(p_in * n_in) - (p_out + n_out), 9) as s2n, oi, conf from ins""",
    "f23_emitted": f"""with {PAIRS_SQL}, {_INSERTIONS}, {GENES_SQL}, g as (select distinct * exclude (gstrand) from gene_spans where gchrom is not null and gname is not null), em as (select *, coalesce(pbp, middle) as pa, coalesce(nbp, middle) as na from ins where kind = 'pair' and conf >= 1)
select chrom, lo as s, hi as e, conf, coalesce((select gname || '_' || gtype from g where gchrom = chrom and gs <= pa + 2 and ge >= pa - 2 order by gs, ge, gname, gtype limit 1), '-') as pgene,
  coalesce((select gname || '_' || gtype from g where gchrom = chrom and gs <= na + 2 and ge >= na - 2 order by gs, ge, gname, gtype limit 1), '-') as ngene from em""",
    "r10_described": f"""with {PAIRS_SQL}, {_INSERTIONS}, d as (select rclass, min(rname) as description from reps where rclass is not null and rname is not null group by rclass), x as (select kind, chrom, lo, hi, conf, unnest(families) as rclass from ins)
select kind, chrom, lo as s, hi as e, conf, array_to_string(list_sort(list(distinct description)), '_&_') as description from x join d using (rclass) group by kind, chrom, lo, hi, conf""",
}

QUERIES = {f.__name__: f for f in (w1_clusters, w1_wildcard, j7_strand_pairs, w7_adjacent, k5_raw_clusters, a10_clip_votes, a11_breakpoints, a16_aligned, a15_insertions, f23_emitted, r10_described)}
