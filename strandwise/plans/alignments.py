"""Reads with bases, qualities and CIGARs: clipping, trimming, fragments, uniqueness and text forms, and their SQL.

The tables hold no bases. A read gets some out of a digest of its name: front
and back clips as long as its own and its mate's mismatches say, tails of A and
T for some ids, and qualities with runs of the lowest one at some ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions import sequence as q
from strandwise.plans.discordance import ENCODINGS
from strandwise.plans.records import MEMBERS_SQL, PAIRS_SQL, members, pairs
from strandwise.plans.tables import table
from strandwise.sources.text_tables import fetch_ranges, reference_chunks

BIG = 10
FRAGMENT = 20
SEGMENT = 25
GOOD = 20


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs(spark, folder).where("name is not null and len > 0 and strand in (1, -1)")
    rows = rows.withColumns({"mate_no": F.expr("cast(id % 2 + 1 as int)"), "front": F.coalesce("nm", F.lit(0)) * 3, "back": F.coalesce("mate_nm", F.lit(0)) * 4}).withColumn("n", F.expr("cast(front + len + back as int)"))
    text = lambda of, signs: F.expr(f"translate(substr(repeat(md5({of}), cast(ceil(n / 32) as int)), 1, n), '0123456789abcdef', '{signs}')")
    rows = rows.withColumns({"seq": text("name", "ACGTACGTACGTACGT"), "qual": text("concat('q', name)", "##(-27<AEFGHIJ5,")})
    rows = rows.withColumn("seq", F.expr("if(id % 7 = 0 and front >= 12, concat(repeat('A', 12), substr(seq, 13)), seq)")).withColumn("seq", F.expr("if(id % 5 = 0 and back >= 12, concat(substr(seq, 1, n - 12), repeat('T', 12)), seq)"))
    rows = rows.withColumn("qual", F.expr("if(id % 4 = 0 and n > 9, concat('###', substr(qual, 4)), qual)")).withColumn("qual", F.expr("if(id % 3 = 0 and n > 9, concat(substr(qual, 1, n - 6), '######'), qual)"))
    rows = rows.withColumn("cigar", F.expr("concat(if(front > 0, concat(front, 'S'), ''), len, 'M', if(back > 0, concat(back, 'S'), ''))"))
    rows = rows.withColumn("md", F.expr("concat(greatest(len - coalesce(nm, 0) - 5, 0), 'A5')"))
    return rows.withColumns({"mapped": F.expr("chrom is not null and pos is not null"), "mate_mapped": F.expr("mate_chrom is not null and mate_pos is not null"), "reverse": F.col("strand") == -1})


ALIGNMENTS_SQL = f"""{PAIRS_SQL}, a0 as (select *, cast(id % 2 + 1 as int) as mate_no, coalesce(nm, 0) * 3 as front, coalesce(mate_nm, 0) * 4 as back, cast(coalesce(nm, 0) * 3 + len + coalesce(mate_nm, 0) * 4 as int) as n from pairs where name is not null and len > 0 and strand in (1, -1))
, a1 as (select *, translate(substr(repeat(md5(name), cast(ceil(n / 32.0) as bigint)), 1, n), '0123456789abcdef', 'ACGTACGTACGTACGT') as sq, translate(substr(repeat(md5('q' || name), cast(ceil(n / 32.0) as bigint)), 1, n), '0123456789abcdef', '##(-27<AEFGHIJ5,') as ql from a0)
, a2 as (select *, case when id % 7 = 0 and front >= 12 then repeat('A', 12) || substr(sq, 13) else sq end as sq1, case when id % 4 = 0 and n > 9 then '###' || substr(ql, 4) else ql end as ql1 from a1)
, aln as (select * exclude (sq, ql, sq1, ql1), case when id % 5 = 0 and back >= 12 then substr(sq1, 1, n - 12) || repeat('T', 12) else sq1 end as seq, case when id % 3 = 0 and n > 9 then substr(ql1, 1, n - 6) || '######' else ql1 end as qual,
  case when front > 0 then front || 'S' else '' end || len || 'M' || case when back > 0 then back || 'S' else '' end as cigar, greatest(len - coalesce(nm, 0) - 5, 0) || 'A5' as md, chrom is not null and pos is not null as mapped, mate_chrom is not null and mate_pos is not null as mate_mapped, strand = -1 as reverse from a2)"""

_RC = "translate(reverse({0}), 'ACGT', 'TGCA')"


def f5_extracted(spark: SparkSession, folder: str) -> DataFrame:
    """reads with a big soft clip at either end, or unmapped, whose mate is mapped, by name and mate."""
    rows = alignments(spark, folder).withColumn("ops", q.cigar_ops("cigar"))
    ends = F.array(F.get("ops", F.lit(0)), F.element_at("ops", -1))
    big = q.has_big_clip(ends, F.col("n"), BIG)
    return rows.where((big | ~F.col("mapped")) & F.col("mate_mapped")).select("id", F.concat("name", F.col("mate_no")).alias("key"), big.alias("clipped"))


def f8_unmapped(spark: SparkSession, folder: str) -> DataFrame:
    """Unmapped reads of which trimming leaves two fragments, with the mate in the name."""
    rows = alignments(spark, folder).where("not mapped").withColumn("left", _left())
    return rows.where(F.col("left") >= 2 * FRAGMENT).select("id", F.concat_ws("_", "name", "mate_no").alias("key"), "left")


def f9_clipped_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Reads with a good clip at the end that their strand looks for, long tails of one base or few mismatches and many matches, and where they are clipped."""
    rows = alignments(spark, folder).where("mapped").withColumn("ops", q.cigar_ops("cigar"))
    good = lambda part: q.longest_run_above(part, 2) >= 5
    front, back = F.expr("substr(qual, 1, front)"), F.expr("substr(qual, n - back + 1, back)")
    starts = ~F.col("reverse") & (F.col("front") >= 5) & good(front)
    ends = F.col("reverse") & (F.col("back") >= 5) & good(back)
    poly = (starts & F.contains(F.expr("substr(seq, 1, front)"), F.lit("A" * 10))) | (ends & F.contains(F.expr("substr(seq, n - back + 1, back)"), F.lit("T" * 10)))
    few = (F.coalesce("nm", F.lit(0)) <= 9) & (q.md_matches("md") >= 25)
    return rows.where((starts | ends) & (poly | few)).select("id", poly.alias("poly"), q.clip_position(F.col("pos"), F.col("ops"), F.col("reverse")).alias("clipped_at"))


def f11_low_ends(spark: SparkSession, folder: str) -> DataFrame:
    """runs of the lowest quality at both ends."""
    return alignments(spark, folder).select("id", q.edge_run("qual", "#", False).alias("leading"), q.edge_run("qual", "#", True).alias("trailing"))


def f14_unique(spark: SparkSession, folder: str) -> DataFrame:
    """which pairs each policy keeps. A read is R with other places or without a flag, else what its tag says; with alignments of all kinds neither both R nor any M may be, without only U with U."""
    rows = alignments(spark, folder)
    tag = lambda nm: F.when(F.col(nm) > 5, "M").when(F.col(nm) > 2, "R").otherwise("U")
    kind = lambda nm, others: F.when(others, "R").otherwise(tag(nm))
    one, two = kind("nm", (F.col("id") % 9 == 0) | (F.col("pos") % 11 == 0)), kind("mate_nm", F.col("mate_pos") % 13 == 0)
    rows = rows.withColumns({"one": one, "two": two})
    wide = ~((F.col("one") == "R") & (F.col("two") == "R")) & (F.col("one") != "M") & (F.col("two") != "M")
    return rows.select("id", "one", "two", wide.alias("any_kind"), ((F.col("one") == "U") & (F.col("two") == "U")).alias("only_unique"))


def _left() -> Column:
    return F.when(F.col("reverse"), q.trim_length(F.reverse("qual"), GOOD)).otherwise(q.trim_length("qual", GOOD))


def x14_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of good qualities, what trimming the 3' end leaves, and the clip or match there after it."""
    rows = alignments(spark, folder).withColumn("left", _left())
    ops = q.cigar_ops("cigar")
    end = F.when(F.col("reverse"), F.get(ops, F.lit(0)).len).otherwise(F.element_at(ops, -1).len)
    return rows.select("id", q.longest_run_above("qual", 16).alias("run"), "left", F.greatest(F.lit(0), end - (F.col("n") - F.col("left"))).alias("end_op"))


def _snip(start, length) -> Column:
    """So many bases from the 5' end on, as stored."""
    return F.when(F.col("reverse"), F.substr("seq", F.col("n") - start - length + 1, F.lit(length))).otherwise(F.substr("seq", start + 1, F.lit(length)))


def x15_split(spark: SparkSession, folder: str) -> DataFrame:
    """Both end fragments of reads with a clip of a fragment and the length of two, named with the length of the read."""
    rows = alignments(spark, folder).where((F.greatest("front", "back") >= FRAGMENT) & (F.col("n") >= 2 * FRAGMENT))
    parts = F.array(F.struct(F.lit("head").alias("part"), _snip(F.lit(0), FRAGMENT).alias("seq")), F.struct(F.lit("tail").alias("part"), _snip(F.col("n") - FRAGMENT, FRAGMENT).alias("seq")))
    return rows.select("id", F.concat_ws("~", "name", "n").alias("key"), F.explode(parts).alias("p")).select("id", "key", "p.*")


def r9_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """The fragments with the read group of their read, by read group."""
    rows = alignments(spark, folder).select("id", F.coalesce("rg", F.lit("none")).alias("rg"))
    return x15_split(spark, folder).join(rows, "id").groupBy("rg").agg(F.count(F.lit(1)).alias("fragments"), F.count_distinct("key").alias("reads"))


def _mates(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Of each read and mate its longest record, the first of equals; reads with both mates, as columns a_ and b_."""
    columns = ["id", "n", "seq", "qual", "reverse", "mapped", "front", "back", "cigar", *more]
    best = alignments(spark, folder).groupBy("name", "mate_no").agg(F.min_by(F.struct(*columns), F.struct(-F.col("n"), F.col("id"))).alias("x"))
    side = lambda no, p: best.where(f"mate_no = {no}").select("name", *[F.col(f"x.{c}").alias(f"{p}_{c}") for c in columns])
    return side(1, "a").join(side(2, "b"), "name")


_MATES = "best as (select * from (select *, row_number() over (partition by name, mate_no order by n desc, id) as no from aln) where no = 1), mates as (select a.name, a.id as a_id, a.n as a_n, a.seq as a_seq, a.qual as a_qual, a.reverse as a_reverse, a.mapped as a_mapped, a.front as a_front, a.back as a_back, b.id as b_id, b.n as b_n, b.seq as b_seq, b.qual as b_qual, b.reverse as b_reverse, b.mapped as b_mapped, b.front as b_front, b.back as b_back from best a join best b on a.name = b.name and a.mate_no = 1 and b.mate_no = 2)"


def r1_fastq(spark: SparkSession, folder: str) -> DataFrame:
    """Both mates of each read as text records; reads of the minus strand are turned back, bases and qualities."""
    m = _mates(spark, folder)
    record = lambda p, no: F.concat(F.lit("@"), "name", F.lit(f"/{no}\n"), F.when(F.col(f"{p}_reverse"), q.reverse_complement(f"{p}_seq")).otherwise(F.col(f"{p}_seq")), F.lit("\n+\n"), F.when(F.col(f"{p}_reverse"), F.reverse(f"{p}_qual")).otherwise(F.col(f"{p}_qual")))
    return m.select("name", F.md5(record("a", 1)).alias("first"), F.md5(record("b", 2)).alias("second"))


def r8_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """The fragment pairs of each read: mu1, mu2 with one mate unmapped (the mapped one whole), sc with a big clip (the larger clipped end of the mate whose clip is larger, the first of equals), else uu1 to uu4 of the ends."""
    m = _mates(spark, folder)
    clip = lambda p: F.greatest(f"{p}_front", f"{p}_back")
    m = m.withColumns({"first": clip("a") >= clip("b"), "mapped": F.col("a_mapped") & F.col("b_mapped"), "one": F.col("a_mapped") != F.col("b_mapped")})

    def snip(p: str, start: Column) -> Column:
        at = F.when(F.col(f"{p}_reverse"), F.col(f"{p}_n") - start - BIG + 1).otherwise(start + 1)
        return F.substr(f"{p}_seq", at.cast("int"), F.lit(BIG))

    head, tail = (lambda p: snip(p, F.lit(0))), (lambda p: snip(p, F.col(f"{p}_n") - BIG))
    long_ = lambda p, times: F.col(f"{p}_n") >= times * BIG
    pair = lambda test, name, one, two: F.when(test, F.struct(F.lit(name).alias("suffix"), one.alias("one"), two.alias("two")))
    uu = F.col("mapped") & (F.greatest(clip("a"), clip("b")) < BIG) & long_("a", 1) & long_("b", 1)
    made = [pair(uu, "uu1", head("a"), head("b")), pair(uu & long_("a", 2), "uu2", tail("a"), head("b")), pair(uu & long_("b", 2), "uu3", head("a"), tail("b")), pair(uu & long_("a", 2) & long_("b", 2), "uu4", tail("a"), tail("b"))]
    for lost, kept in (("a", "b"), ("b", "a")):
        um = F.col("one") & ~F.col(f"{lost}_mapped") & long_(lost, 1) & long_(kept, 2)
        made += [pair(um, "mu1", F.col(f"{kept}_seq"), head(lost)), pair(um & long_(lost, 2), "mu2", F.col(f"{kept}_seq"), tail(lost))]
    for cut, mate, own in (("a", "b", F.col("first")), ("b", "a", ~F.col("first"))):
        sc = F.col("mapped") & own & (clip(cut) >= BIG) & long_(mate, 2)
        end = F.when(F.col(f"{cut}_front") < F.col(f"{cut}_back"), F.expr(f"substr({cut}_seq, cast({cut}_n - {cut}_back + 1 as int), cast({cut}_back as int))")).otherwise(F.expr(f"substr({cut}_seq, 1, cast({cut}_front as int))"))
        made.append(pair(sc, "sc", end, F.col(f"{mate}_seq")))
    return m.select("name", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("name", "x.suffix", F.md5("x.one").alias("one"), F.md5("x.two").alias("two"))


def r2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of a read's first mate with every segment of its second, numbered; segments are what the longest record's CIGAR cuts it into, so a read has nine pairs at most."""
    m = _mates(spark, folder)
    cut = lambda p: q.segments(F.col(f"{p}_seq"), q.cigar_ops(f"{p}_cigar"), F.col(f"{p}_reverse"), SEGMENT)
    m = m.select("name", cut("a").alias("one"), cut("b").alias("two"))
    each = m.select("name", F.size("two").alias("k"), "two", F.posexplode("one").alias("i", "s1")).select("name", "k", "i", "s1", F.posexplode("two").alias("j", "s2"))
    return each.select("name", (F.col("i") * F.col("k") + F.col("j") + 1).alias("no"), F.md5("s1").alias("one"), F.md5("s2").alias("two"))


def x17_soft(spark: SparkSession, folder: str) -> DataFrame:
    """Records with hard clips get back the bases of the read's longest record of the same mate, turned to their strand, and soft clips, unless they are as long. Odd ids stand for records with hard clips."""
    rows = alignments(spark, folder).withColumns({"hard": F.col("id") % 2 == 1, "group_no": F.expr("cast(id % 4 div 2 as int)")})
    rows = rows.withColumns({"cigar": F.when(F.col("hard"), F.translate("cigar", "S", "H")).otherwise(F.col("cigar")), "bases": F.when(F.col("hard"), F.expr("substr(seq, cast(front + 1 as int), cast(len as int))")).otherwise(F.col("seq"))})
    keys = ["name", "group_no"]
    plain = F.when(F.col("reverse"), q.reverse_complement("bases")).otherwise(F.col("bases"))
    longest = rows.groupBy(*keys).agg(F.min_by(plain, F.struct(-F.char_length("bases"), F.col("id"))).alias("longest"), F.count(F.lit(1)).alias("records"))
    met = rows.join(longest, keys)
    turn = (F.col("records") > 1) & q.is_clipped(F.filter(q.cigar_ops("cigar"), lambda o: o.op == "H")) & (F.char_length("bases") != F.char_length("longest"))
    back = F.when(F.col("reverse"), q.reverse_complement("longest")).otherwise(F.col("longest"))
    return met.select("id", F.when(turn, F.translate("cigar", "H", "S")).otherwise(F.col("cigar")).alias("cigar"), F.md5(F.when(turn, back).otherwise(F.col("bases"))).alias("bases"))


def w5_couples(spark: SparkSession, folder: str) -> DataFrame:
    """Of the mapped reads at one place whose unmapped mates have the same bases the first."""
    rows = alignments(spark, folder).where("mapped and not mate_mapped")
    return rows.groupBy("chrom", "pos", "strand", F.md5("seq").alias("bases")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def k1_sam_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each record as a line of alignment text, with its flag bits."""
    rows = alignments(spark, folder)
    flag = F.lit(1)
    for bit, test in ((4, ~F.col("mapped")), (8, ~F.col("mate_mapped")), (16, F.col("reverse")), (32, F.coalesce(F.col("mate_strand") == -1, F.lit(False))), (64, F.col("mate_no") == 1), (128, F.col("mate_no") == 2)):
        flag = F.when(test, q.set_flag(flag, bit)).otherwise(flag)
    mate = F.when(F.col("mate_chrom") == F.col("chrom"), "=").otherwise(F.coalesce("mate_chrom", F.lit("*")))
    fields = [F.col("name"), flag, F.coalesce("chrom", F.lit("*")), F.coalesce("pos", F.lit(0)), F.lit(60), F.col("cigar"), mate, F.coalesce("mate_pos", F.lit(0)), F.coalesce("isize", F.lit(0)), F.col("seq"), F.col("qual"), F.concat(F.lit("RG:Z:"), F.coalesce("rg", F.lit("none"))), F.concat(F.lit("MD:Z:"), "md")]
    return rows.select("id", F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("line"))


def j20_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Of each cluster the distinct reads, by name and length, that have a record of that length, and the bases of the first such record."""
    m = members(spark, folder).where("name is not null and len > 0").select("cluster_id", "name", "len").distinct()
    rows = alignments(spark, folder).groupBy("name", "len").agg(F.min_by("seq", "id").alias("seq"))
    return m.join(rows, ["name", "len"]).select("cluster_id", F.concat_ws("~", "name", F.col("len").cast("string")).alias("key"), F.md5("seq").alias("bases"))


def j23_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a file by their number in it, kept if an id that begins with the number is on a list: the records with the duplicate flag, and those after them."""
    rows = table(spark, folder, "block_boundaries").where("file_id is not null and file_offset is not null").groupBy("file_id", "file_offset").agg(F.max(F.col("aln_flag").bitwiseAND(F.lit(1024).cast("long"))).alias("marked"), F.min("read_name").alias("read_name"))
    numbered = rows.withColumn("no", F.row_number().over(Window.partitionBy("file_id").orderBy("file_offset")))  # of one file, which one task wrote
    ids = numbered.where("marked > 0").select("file_id", F.explode(F.array(F.concat_ws("~", "no", "read_name"), F.concat_ws("~", F.col("no") + 1, F.lit("next")))).alias("key"))
    wanted = ids.select("file_id", F.regexp_extract("key", "^([0-9]+)", 1).cast("int").alias("no")).distinct()
    return numbered.join(wanted, ["file_id", "no"], "left_semi").select("file_id", "no", "file_offset")


def j24_either_way(spark: SparkSession, folder: str) -> DataFrame:
    """The name `a~b` of each cluster's two chromosomes looked up as it is, else the other way round."""
    names = members(spark, folder).where("chrom is not null and mate_chrom is not null").select("cluster_id", "chrom", "mate_chrom").distinct()
    known = pairs(spark, folder).where("chrom is not null and mate_chrom is not null and strand = 1").groupBy(F.concat_ws("~", "chrom", "mate_chrom").alias("known")).agg(F.count(F.lit(1)).alias("n"))
    both = names.withColumns({"own": F.concat_ws("~", "chrom", "mate_chrom"), "turned": F.concat_ws("~", "mate_chrom", "chrom")})
    a = both.join(known.withColumnsRenamed({"known": "own", "n": "n1"}), "own", "left").join(known.withColumnsRenamed({"known": "turned", "n": "n2"}), "turned", "left")
    return a.where("n1 is not null or n2 is not null").select("cluster_id", "own", F.coalesce("n1", "n2").alias("n"), F.col("n1").isNull().alias("by_turning"))


def a19_across_files(spark: SparkSession, folder: str) -> DataFrame:
    """How often each read stands in all files, and in how many."""
    rows = table(spark, folder, "block_boundaries").where("read_name is not null and read_name <> ''")
    return rows.groupBy("read_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("files"))


def o8_first_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Of each read the first size that it came with, and its place among the sizes of its read group's first reads, up to 5."""
    first = pairs(spark, folder).where("name is not null and isize is not null and rg is not null").groupBy("rg", "name").agg(F.min_by("isize", "id").alias("isize"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("rg").orderBy("isize", "name"))).where("place <= 5")


def o10_two_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Of each cluster the two members nearest to its expected breakpoint, the largest start of the plus strand or the least of the minus one; of equal distances the first by position and name."""
    rows = members(spark, folder).where("pos is not null and name is not null and strand in (1, -1)").select("cluster_id", "strand", "pos", "name").distinct()
    at = rows.groupBy("cluster_id", "strand").agg(F.max("pos").alias("most"), F.min("pos").alias("least")).withColumn("at", F.when(F.col("strand") == 1, F.col("most")).otherwise(F.col("least"))).select("cluster_id", "strand", "at")
    met = rows.join(at, ["cluster_id", "strand"])
    ranked = met.withColumn("no", F.row_number().over(Window.partitionBy("cluster_id", "strand").orderBy(F.abs(F.col("pos") - F.col("at")), "pos", "name"))).where("no <= 2")
    return ranked.select("cluster_id", "strand", "no", "pos", "name")


def r4_region_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Left half, 100 N and right half of a region, the right one reverse complemented where the flag says so; one fetch where the halves meet. Texts stand for chromosomes, odd ids for the flag."""
    docs = table(spark, folder, "documents").where("text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("name"), q.plain_bases("text").alias("seq"))
    size = docs.select("name", F.char_length("seq").cast("long").alias("n"), (F.col("name").cast("long") % 2 == 1).alias("turned"))
    apart = F.col("n") > 120
    left = size.select(F.concat("name", F.lit("~l")).alias("id"), F.col("name").alias("chrom"), F.lit(1).cast("long").alias("start"), F.when(apart, 60).otherwise(F.col("n")).cast("long").alias("stop"))
    right = size.where(apart).select(F.concat("name", F.lit("~r")).alias("id"), F.col("name").alias("chrom"), F.when(F.col("turned"), F.col("n")).otherwise(F.col("n") - 59).alias("start"), F.when(F.col("turned"), F.col("n") - 59).otherwise(F.col("n")).alias("stop"))
    fetched = fetch_ranges(left.unionByName(right), reference_chunks(docs), "id")
    parts = fetched.select(F.split("id", "~")[0].alias("name"), F.split("id", "~")[1].alias("half"), "fetched")
    whole = parts.groupBy("name").agg(F.max(F.when(F.col("half") == "l", F.col("fetched"))).alias("l"), F.max(F.when(F.col("half") == "r", F.col("fetched"))).alias("r"))
    return whole.select(F.col("name").cast("long").alias("doc_id"), F.when(F.col("r").isNull(), F.col("l")).otherwise(F.concat("l", F.lit("N" * 100), "r")).alias("seq"))


def r5_chosen(spark: SparkSession, folder: str) -> DataFrame:
    """Of a read's other places in the region of its mate the right one, and its flag with the strand of that place. Places come out of positions."""
    rows = alignments(spark, folder).where("mapped and mate_mapped")
    hits = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.col("pos") * i + F.col("mate_pos")) % 1000)
    hit = q.choose_hit(hits, F.col("pos") % 1000, F.col("mate_pos") % 1000, F.lit(131), F.lit(400), F.lit(350), F.lit(900))
    return rows.withColumn("at", hit).select("id", "at", F.when(F.col("at") % 2 == 1, q.set_flag(F.lit(65), 16)).otherwise(q.set_flag(F.lit(81), 16, False)).alias("flag"))


def x26_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Bases without their poly tail, one other base in it forgiven."""
    rows = alignments(spark, folder)
    return rows.select("id", F.char_length(q.without_poly_tail("seq", "T")).alias("without_t"), F.char_length(q.without_poly_tail(F.reverse("seq"), "A")).alias("without_a"))


def f7_eligible(spark: SparkSession, folder: str) -> DataFrame:
    """Records that count for coverage, by chromosome: mapped, primary, no quality failure, no duplicate, by the bits of their flags."""
    rows = alignments(spark, folder)
    flag = F.lit(1)
    for bit, test in ((4, ~F.col("mapped")), (256, F.col("id") % 10 == 0), (512, F.coalesce(F.col("nm") > 12, F.lit(False))), (1024, F.col("id") % 17 == 0)):
        flag = F.when(test, q.set_flag(flag, bit)).otherwise(flag)
    return rows.withColumn("flag", flag).where(F.col("flag").bitwiseAND(F.lit(4 + 256 + 512 + 1024)) == 0).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def f12_anchored(spark: SparkSession, folder: str) -> DataFrame:
    """which mapped records have any mapping quality and a tag, if there is one, that says unique; and which pairs have a quality of 20 or more on both sides. Qualities come out of mismatches."""
    quality = lambda nm: F.greatest(F.lit(0), 60 - 10 * F.coalesce(nm, F.lit(6)))
    tag = F.when(F.col("id") % 4 != 0, F.when(F.col("nm") <= 2, "U").otherwise("R"))
    rows = alignments(spark, folder).where("mapped").withColumns({"own": quality("nm"), "mate": quality("mate_nm"), "tag": tag})
    anchored = (F.col("own") > 0) & (F.col("tag").isNull() | F.contains("tag", F.lit("U")))
    return rows.select("id", anchored.alias("anchored"), (F.least("own", "mate") >= 20).alias("both_good"))


def j2_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """The longest record of a read's first mate with the records of its second, which are numbered from m1 to m19."""
    rows = alignments(spark, folder)
    one = rows.where("mate_no = 1").groupBy("name").agg(F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("id"))
    two = rows.where("mate_no = 2").select("name", F.col("id").alias("mate_id"), F.row_number().over(Window.partitionBy("name").orderBy("id")).alias("no")).where("no <= 19")
    return one.join(two, "name").select(F.concat("name", F.lit(":m"), "no").alias("key"), "id", "mate_id")


def j3_representative(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of a read's records with no more mismatches than its longest one, in order; the wildcard, where it is among them, stands alone."""
    rows = alignments(spark, folder).where("nm is not null")
    kind = F.when(F.col("nm") == 0, "POLYA").when(F.col("nm") % 2 == 1, "LINE").otherwise("SINE")
    primary = rows.groupBy("name").agg(F.min_by("nm", F.struct(-F.col("len"), F.col("id"))).alias("most"))
    # Of a hot read one row a number of mismatches is left before it meets its primary record.
    kinds = rows.groupBy("name", "nm").agg(F.first(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    kept = kinds.join(primary, "name").where("nm <= most").groupBy("name").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("n").alias("n"))
    return kept.select("name", F.when(F.array_contains("kinds", "POLYA"), "POLYA").otherwise(F.array_join("kinds", ",")).alias("kinds"), "n")


def x20_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Of each read the record whose CIGAR has the longest match, the first of equals, with the bases before and after it."""
    cigar = F.concat("front", F.lit("S"), "len", F.lit("M2D"), (F.col("front") + 1).cast("string"), F.lit("I120M"), "back", F.lit("S"))
    rows = alignments(spark, folder).withColumn("m", q.around_longest_match(q.cigar_ops(cigar)))
    best = rows.groupBy("name").agg(F.min(F.struct((-F.col("m.len")).alias("k"), "id", F.col("m.before").alias("before"), F.col("m.after").alias("after"))).alias("x"))
    return best.select("name", "x.id", (-F.col("x.k")).alias("len"), "x.before", "x.after")


def a2_first_stat(spark: SparkSession, folder: str) -> DataFrame:
    """The scalar lines of a file's first statistics: records, unmapped, clipped, longest, and the place of the quality encoding in the table of those that hold all codes, the nearest by both ends."""
    rows = alignments(spark, folder).withColumn("codes", q.quality_codes("qual", 0))
    one = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("mapped")).alias("unmapped"), F.count_if(F.greatest("front", "back") >= BIG).alias("clipped"), F.max("n").alias("max_read_len"), F.min(F.array_min("codes")).alias("low"), F.max(F.array_max("codes")).alias("high"))
    fits = F.array(*[F.when((F.col("low") >= a) & (F.col("high") <= b), F.struct((F.abs(F.col("low") - a) + F.abs(F.col("high") - b)).alias("d"), F.lit(i).alias("i"))) for i, (_, a, b) in enumerate(ENCODINGS)])
    return one.withColumn("encoding", F.coalesce(F.array_min(F.filter(fits, lambda x: x.isNotNull())).getField("i"), F.lit(0))).drop("low", "high")


def _pieces(seq: str, front: str, length: str, back: str, reverse: str) -> str:
    return f"list_transform(list_filter([substr({seq}, 1, {front}), substr({seq}, {front} + 1, {length}), substr({seq}, {front} + {length} + 1, {back})], lambda x: len(x) >= {SEGMENT}), lambda x: case when {reverse} then translate(reverse(x), 'ACGT', 'TGCA') else x end)"


_A = f"with {ALIGNMENTS_SQL}"
_HEAD = "case when {0}_reverse then substr({0}_seq, {0}_n - 9, 10) else substr({0}_seq, 1, 10) end"
_TAIL = "case when {0}_reverse then substr({0}_seq, 1, 10) else substr({0}_seq, {0}_n - 9, 10) end"
_TRIM = f"""c as (select id, n, case when reverse then qual else reverse(qual) end as r from aln), u as (select id, unnest(range(1, n + 1)) as i, r from c), s as (select id, i, sum({GOOD} - (ascii(substr(r, i, 1)) - 33)) over (partition by id order by i) as s from u)
, best as (select id, arg_min(i, (-s, i)) as cut from s group by id), tr as (select c.id, c.n - case when ascii(c.r) - 33 >= {GOOD} then 0 else cut end as "left" from c join best using (id))"""

SQL = {
    "f5_extracted": f"{_A} select id, name || mate_no as key, greatest(front, back) >= 10 as clipped from aln where (greatest(front, back) >= 10 or not mapped) and mate_mapped",
    "f8_unmapped": f"""{_A}, {_TRIM} select id, name || '_' || mate_no as key, "left" from aln join tr using (id) where not mapped and "left" >= 40""",
    "f9_clipped_reads": f"""{_A}, g as (select *, not reverse and front >= 5 and list_max(list_transform(string_split(substr(qual, 1, front), '#'), lambda x: len(x))) >= 5 as st, reverse and back >= 5 and list_max(list_transform(string_split(right(qual, back), '#'), lambda x: len(x))) >= 5 as en from aln where mapped)
, p as (select *, (st and contains(substr(seq, 1, front), 'AAAAAAAAAA')) or (en and contains(right(seq, back), 'TTTTTTTTTT')) as poly from g where st or en)
select id, poly, case when reverse then -(pos + len) else pos end as clipped_at from p where poly or (coalesce(nm, 0) <= 9 and greatest(len - coalesce(nm, 0) - 5, 0) + 5 >= 25)""",
    "f11_low_ends": f"{_A} select id, length(qual) - length(ltrim(qual, '#')) as leading, length(qual) - length(rtrim(qual, '#')) as trailing from aln",
    "f14_unique": f"""{_A}, k as (select id, case when id % 9 = 0 or pos % 11 = 0 then 'R' when nm > 5 then 'M' when nm > 2 then 'R' else 'U' end as one, case when mate_pos % 13 = 0 then 'R' when mate_nm > 5 then 'M' when mate_nm > 2 then 'R' else 'U' end as two from aln)
select *, one || two not in ('RR', 'MM', 'MR', 'RM', 'MU', 'UM') as any_kind, one || two = 'UU' as only_unique from k""",
    "x14_quality": f"""{_A}, {_TRIM} select id, coalesce(list_max(list_transform(string_split(translate(qual, '#(-,', '    '), ' '), lambda x: len(x))), 0) as run, "left", greatest(0, case when reverse then case when front > 0 then front else len end else case when back > 0 then back else len end end - (n - "left")) as end_op from aln join tr using (id)""",
    "x15_split": f"""{_A}, f as (select * from aln where greatest(front, back) >= 20 and n >= 40)
select id, name || '~' || n as key, 'head' as part, case when reverse then right(seq, 20) else left(seq, 20) end as seq from f union all select id, name || '~' || n, 'tail', case when reverse then left(seq, 20) else right(seq, 20) end from f""",
    "r9_tagged": f"{_A} select coalesce(rg, 'none') as rg, 2 * count(*) as fragments, count(distinct name || '~' || n) as reads from aln where greatest(front, back) >= 20 and n >= 40 group by 1",
    "r1_fastq": f"{_A}, {_MATES} select name, md5('@' || name || '/1' || chr(10) || case when a_reverse then {_RC.format('a_seq')} else a_seq end || chr(10) || '+' || chr(10) || case when a_reverse then reverse(a_qual) else a_qual end) as first, md5('@' || name || '/2' || chr(10) || case when b_reverse then {_RC.format('b_seq')} else b_seq end || chr(10) || '+' || chr(10) || case when b_reverse then reverse(b_qual) else b_qual end) as second from mates",
    "r8_fragments": f"""{_A}, {_MATES}, k as (select *, greatest(a_front, a_back) as ac, greatest(b_front, b_back) as bc, {_HEAD.format('a')} as ah, {_TAIL.format('a')} as at_, {_HEAD.format('b')} as bh, {_TAIL.format('b')} as bt from mates)
, uu as (select * from k where a_mapped and b_mapped and ac < 10 and bc < 10 and a_n >= 10 and b_n >= 10), um as (select name, case when a_mapped then a_seq else b_seq end as whole, case when a_mapped then bh else ah end as h, case when a_mapped then bt else at_ end as t, case when a_mapped then b_n else a_n end as n from k where a_mapped <> b_mapped and case when a_mapped then b_n else a_n end >= 10 and case when a_mapped then a_n else b_n end >= 20)
, sc as (select name, case when ac >= bc then case when a_front < a_back then right(a_seq, a_back) else left(a_seq, a_front) end else case when b_front < b_back then right(b_seq, b_back) else left(b_seq, b_front) end end as part, case when ac >= bc then b_seq else a_seq end as mate from k where a_mapped and b_mapped and greatest(ac, bc) >= 10 and case when ac >= bc then b_n else a_n end >= 20)
select name, 'uu1' as suffix, md5(ah) as one, md5(bh) as two from uu union all select name, 'uu2', md5(at_), md5(bh) from uu where a_n >= 20 union all select name, 'uu3', md5(ah), md5(bt) from uu where b_n >= 20 union all select name, 'uu4', md5(at_), md5(bt) from uu where a_n >= 20 and b_n >= 20
union all select name, 'mu1', md5(whole), md5(h) from um union all select name, 'mu2', md5(whole), md5(t) from um where n >= 20 union all select name, 'sc', md5(part), md5(mate) from sc""",
    "r2_segments": f"""{_A}, {_MATES}, g as (select name, {_pieces('a_seq', 'a_front', '(a_n - a_front - a_back)', 'a_back', 'a_reverse')} as one, {_pieces('b_seq', 'b_front', '(b_n - b_front - b_back)', 'b_back', 'b_reverse')} as two from mates)
, i as (select name, one, two, unnest(range(1, len(one) + 1)) as i from g), j as (select *, unnest(range(1, len(two) + 1)) as j from i)
select name, cast((i - 1) * len(two) + j as int) as no, md5(one[i]) as one, md5(two[j]) as two from j""",
    "x17_soft": f"""{_A}, h as (select *, id % 2 = 1 as hard, id % 4 // 2 as g, case when id % 2 = 1 then translate(cigar, 'S', 'H') else cigar end as cg, case when id % 2 = 1 then substr(seq, front + 1, len) else seq end as bases from aln)
, l as (select name, g, arg_min(case when reverse then {_RC.format('bases')} else bases end, (-len(bases), id)) as longest, count(*) as k from h group by name, g)
, t as (select h.*, longest, k > 1 and contains(cg, 'H') and len(bases) <> len(longest) as turn from h join l using (name, g))
select id, case when turn then translate(cg, 'H', 'S') else cg end as cigar, md5(case when turn then case when reverse then {_RC.format('longest')} else longest end else bases end) as bases from t""",
    "w5_couples": f"{_A} select chrom, pos, strand, md5(seq) as bases, min(id) as id, count(*) as copies from aln where mapped and not mate_mapped group by chrom, pos, strand, md5(seq)",
    "k1_sam_lines": f"""{_A} select id, concat_ws(chr(9), name, 1 + case when mapped then 0 else 4 end + case when mate_mapped then 0 else 8 end + case when reverse then 16 else 0 end + case when mate_strand = -1 then 32 else 0 end + 64 * mate_no, coalesce(chrom, '*'), coalesce(pos, 0), 60, cigar, case when mate_chrom = chrom then '=' else coalesce(mate_chrom, '*') end, coalesce(mate_pos, 0), coalesce(isize, 0), seq, qual, 'RG:Z:' || coalesce(rg, 'none'), 'MD:Z:' || md) as line from aln""",
    "j20_sequences": f"{_A}, {MEMBERS_SQL}, m as (select distinct cluster_id, name, len from members where name is not null and len > 0), r as (select name, len, arg_min(seq, id) as seq from aln group by name, len) select cluster_id, name || '~' || len as key, md5(seq) as bases from m join r using (name, len)",
    "j23_numbered": """with r as (select file_id, file_offset, max(aln_flag & 1024) as jump from block_boundaries where file_id is not null and file_offset is not null group by all), n as (select *, cast(row_number() over (partition by file_id order by file_offset) as int) as no from r), k as (select *, lag(jump) over (partition by file_id order by file_offset) as before from n)
select file_id, no, file_offset from k where jump > 0 or before > 0""",
    "j24_either_way": f"""with {PAIRS_SQL}, {MEMBERS_SQL}, m as (select distinct cluster_id, chrom, mate_chrom from members where chrom is not null and mate_chrom is not null), k as (select chrom, mate_chrom, count(*) as n from pairs where chrom is not null and mate_chrom is not null and strand = 1 group by all)
select cluster_id, m.chrom || '~' || m.mate_chrom as own, coalesce(a.n, b.n) as n, a.n is null as by_turning from m left join k a on a.chrom = m.chrom and a.mate_chrom = m.mate_chrom left join k b on b.chrom = m.mate_chrom and b.mate_chrom = m.chrom where a.n is not null or b.n is not null""",
    "a19_across_files": "select read_name, count(*) as n, count(distinct file_id) as files from block_boundaries where read_name is not null and read_name <> '' group by read_name",
    "o8_first_by_key": f"with {PAIRS_SQL}, f as (select rg, name, arg_min(isize, id) as isize from pairs where name is not null and isize is not null and rg is not null group by rg, name) select * from (select *, cast(row_number() over (partition by rg order by isize, name) as int) as place from f) where place <= 5",
    "o10_two_nearest": f"""with {MEMBERS_SQL}, r as (select distinct cluster_id, strand, pos, name from members where pos is not null and name is not null and strand in (1, -1)), d as (select *, case when strand = 1 then max(pos) over w - pos else pos - min(pos) over w end as d from r window w as (partition by cluster_id, strand))
select cluster_id, strand, no, pos, name from (select *, cast(row_number() over (partition by cluster_id, strand order by d, pos, name) as int) as no from d) where no <= 2""",
    "r4_region_sequence": f"""with b as (select doc_id, translate(regexp_replace(text, '[^ACGTacgt]', 'N', 'g'), 'acgt', 'ACGT') as s from documents where text is not null and text <> '')
select doc_id, case when length(s) <= 120 then s else substr(s, 1, 60) || repeat('N', 100) || case when doc_id % 2 = 1 then {_RC.format('right(s, 60)')} else right(s, 60) end end as seq from b""",
    "f7_eligible": f"{_A} select chrom, count(*) as n, min(id) as first from aln where mapped and id % 10 <> 0 and coalesce(nm, 0) <= 12 and id % 17 <> 0 group by chrom",
    "f12_anchored": f"{_A} select id, coalesce(nm, 6) < 6 and (id % 4 = 0 or coalesce(nm <= 2, false)) as anchored, greatest(coalesce(nm, 6), coalesce(mate_nm, 6)) <= 4 as both_good from aln where mapped",
    "j2_numbered": f"{_A}, o as (select name, arg_min(id, (-n, id)) as id from aln where mate_no = 1 group by name), t as (select name, id as mate_id, row_number() over (partition by name order by id) as no from aln where mate_no = 2) select name || ':m' || no as key, id, mate_id from o join t using (name) where no <= 19",
    "j3_representative": f"""{_A}, k as (select name, nm, first_value(nm) over (partition by name order by len desc, id) as most from aln where nm is not null), f as (select name, case when nm = 0 then 'POLYA' when nm % 2 = 1 then 'LINE' else 'SINE' end as kind from k where nm <= most)
select name, case when bool_or(kind = 'POLYA') then 'POLYA' else array_to_string(list_sort(list(distinct kind)), ',') end as kinds, count(*) as n from f group by name""",
    "x20_matches": f"""{_A}, m as (select name, id, greatest(len, 120) as l, case when len >= 120 then front else front + len + front + 1 end as before, case when len >= 120 then front + 1 + 120 + back else back end as after from aln), r as (select *, row_number() over (partition by name order by l desc, id) as no from m)
select name, id, cast(l as int) as len, cast(before as int) as before, cast(after as int) as after from r where no = 1""",
    "a2_first_stat": f"""{_A}, c as (select min(ascii(substr(qual, i, 1))) as low, max(ascii(substr(qual, i, 1))) as high from aln, range(1, 400) as t(i) where i <= n)
select count(*) as total, count(*) filter (not mapped) as unmapped, count(*) filter (greatest(front, back) >= 10) as clipped, max(n) as max_read_len, (select case when low >= 33 and high <= 73 then 0 when low >= 59 and high <= 104 then 1 else 0 end from c) as encoding from aln""",
    "r5_chosen": f"""{_A}, h0 as (select id, pos % 1000 as a0, mate_pos % 1000 as mp, [(pos * i + mate_pos) % 1000 for i in [1, 2, 3, 4]] as h from aln where mapped and mate_mapped)
, h1 as (select *, abs(abs(h[1] - mp) - 131) < 2 as e1, abs(abs(h[2] - mp) - 131) < 2 as e2, abs(abs(h[3] - mp) - 131) < 2 as e3, abs(abs(h[4] - mp) - 131) < 2 as e4 from h0)
, s1 as (select *, case when e1 or (a0 < 400 and h[1] < 400 and abs(h[1] - 350) < abs(a0 - 350)) or (a0 > 500 and h[1] > 500 and abs(h[1] - 900) < abs(a0 - 900)) then h[1] else a0 end as a1 from h1)
, s2 as (select *, case when e1 then a1 when e2 or (a1 < 400 and h[2] < 400 and abs(h[2] - 350) < abs(a1 - 350)) or (a1 > 500 and h[2] > 500 and abs(h[2] - 900) < abs(a1 - 900)) then h[2] else a1 end as a2 from s1)
, s3 as (select *, case when e1 or e2 then a2 when e3 or (a2 < 400 and h[3] < 400 and abs(h[3] - 350) < abs(a2 - 350)) or (a2 > 500 and h[3] > 500 and abs(h[3] - 900) < abs(a2 - 900)) then h[3] else a2 end as a3 from s2)
, s4 as (select *, case when e1 or e2 or e3 then a3 when e4 or (a3 < 400 and h[4] < 400 and abs(h[4] - 350) < abs(a3 - 350)) or (a3 > 500 and h[4] > 500 and abs(h[4] - 900) < abs(a3 - 900)) then h[4] else a3 end as at_ from s3)
select id, at_ as "at", case when at_ % 2 = 1 then 81 else 65 end as flag from s4""",
    "x26_tails": f"""{_A}, t as (select id, regexp_replace(seq, '(T)[^T](T*)$', '\\1T\\2') as a, regexp_replace(reverse(seq), '(A)[^A](A*)$', '\\1A\\2') as b, length(seq) - length(rtrim(seq, 'T')) as ta, length(seq) - length(ltrim(seq, 'A')) as tb from aln)
select id, cast(case when length(a) - length(rtrim(a, 'T')) >= 5 then length(rtrim(a, 'T')) else length(a) end as int) as without_t, cast(case when length(b) - length(rtrim(b, 'A')) >= 5 then length(rtrim(b, 'A')) else length(b) end as int) as without_a from t""",
}

QUERIES = {f.__name__: f for f in (f5_extracted, f8_unmapped, f9_clipped_reads, f11_low_ends, f14_unique, x14_quality, x15_split, r9_tagged, r1_fastq, r8_fragments, r2_segments, x17_soft, w5_couples, k1_sam_lines, j20_sequences, j23_numbered, j24_either_way, a19_across_files, o8_first_by_key, o10_two_nearest, r4_region_sequence, r5_chosen, x26_tails, f7_eligible, f12_anchored, j2_numbered, j3_representative, x20_matches, a2_first_stat)}
