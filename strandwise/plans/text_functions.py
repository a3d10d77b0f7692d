"""Sequence, quality, CIGAR and set functions over whole text columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions import sequence as q
from strandwise.operators.carry import running
from strandwise.plans.records import PAIRS_SQL, pairs
from strandwise.plans.tables import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", "text")


def x2_reverse_complement(spark: SparkSession, folder: str) -> DataFrame:
    """Base complement of whole texts (as a digest), and how many bases are N."""
    d = _docs(spark, folder)
    return d.select("doc_id", F.md5(q.reverse_complement("text")).alias("rc"), q.count_n(q.plain_bases("text")).alias("n"))


def x3_prefix_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Characters in which the names of a record's read and of its read group differ, up to the end of the shorter."""
    rows = table(spark, folder, "alt_map").where("read_name is not null and read_group is not null")
    return rows.select("alt_id", q.prefix_difference("read_name", "read_group").alias("differ"))


def x7_trimmed(spark: SparkSession, folder: str) -> DataFrame:
    """Trimmed text, its fields with and without empty ones, joined again."""
    d = _docs(spark, folder)
    kept, dropped = q.split_keep_empty("text", " "), q.split_drop_empty("text", " ")
    return d.select("doc_id", F.md5(q.strip_space("text")).alias("trimmed"), F.size(kept).alias("fields"), F.size(dropped).alias("words"), F.md5(F.array_join(dropped, " ")).alias("joined"))


def x10_stem(spark: SparkSession, folder: str) -> DataFrame:
    """Read names up to their last colon part, and a strand-aware piece."""
    rows = table(spark, folder, "alt_map").where("read_name is not null and read_strand in (1, -1)")
    return rows.select("alt_id", q.strip_suffix("read_name", (":",)).alias("stem"), q.snip("read_name", F.col("read_strand") == -1, 2, 6).alias("piece"))


def x19_cigar(spark: SparkSession, folder: str) -> DataFrame:
    """CIGARs made of lengths and mismatches; clipped, normal form, longest match, kept end, flags."""
    rows = pairs(spark, folder).where("len > 0 and nm is not null")
    cigar = F.concat(F.col("nm"), F.lit("S"), F.col("len"), F.lit("M2D"), F.col("nm") + 1, F.lit("I3M"), F.coalesce("mate_nm", F.lit(1)), F.lit("S"))
    rows = rows.withColumn("ops", q.cigar_ops(cigar))
    normal = F.array_join(F.transform(q.normal_cigar(F.col("ops")), lambda o: F.concat(o.len, o.op)), "")
    md = F.concat(F.col("len"), F.lit("A"), F.col("nm"), F.lit("^AC"), F.lit("7"))
    return rows.select("id", q.is_clipped(F.col("ops")).alias("clipped"), q.has_big_clip(F.col("ops"), F.col("len"), 4).alias("big"), normal.alias("normal"), q.longest_match(F.col("ops")).alias("longest"), q.reference_length(F.col("ops")).alias("span"), q.kept_clip(F.col("ops")).alias("side"), q.md_matches(md).alias("matches"), q.set_flag(q.set_flag(F.lit(65), 16, True), 1, False).alias("flag"))


def x25_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of one letter at both ends of whole texts, and poly tails."""
    d = _docs(spark, folder)
    a, t = q.has_poly_tail("text", "text")
    return d.select("doc_id", q.edge_run("text", ".", True).alias("dots"), q.edge_run("text", "A-Z", False).alias("capitals"), a.alias("a_tail"), t.alias("t_head"))


def x23_alternatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of an alternative tag per read, and the representative list of families in which the wildcard wins."""
    rows = pairs(spark, folder).where("name is not null and chrom is not null and pos is not null and nm is not null")
    tag = F.concat(F.lit("XA:Z:"), F.col("chrom"), F.lit(","), F.when(F.col("strand") == -1, "-").otherwise("+"), F.col("pos"), F.lit(",50M,"), F.col("nm"), F.lit(";"))
    hits = rows.select("name", F.explode(q.alternative_hits(tag)).alias("h"))
    # Hits of one read, chromosome and number of mismatches are added up first, so a hot read is a few rows.
    kinds = hits.groupBy("name", F.col("h.chrom").alias("chrom"), F.col("h.nm").alias("nm")).agg(F.count(F.lit(1)).alias("n"))
    best = kinds.groupBy("name").agg(F.min("nm").alias("least"))
    kept = kinds.join(best, "name").where("nm <= least + 1")
    out = kept.groupBy("name").agg(F.array_sort(F.collect_set("chrom")).alias("f"), F.sum("n").alias("n"))
    return out.select("name", "n", F.when(F.array_contains("f", "1"), F.lit("1")).otherwise(F.array_join("f", ",")).alias("families"))


def j2_mate_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one strand that look up those of the other strand of their read by (name, strand): how many, and the least."""
    rows = pairs(spark, folder).where("name is not null")
    plus, minus = rows.where("strand = 1").select("id", "name"), rows.where("strand = -1").groupBy("name").agg(F.count(F.lit(1)).alias("mates"), F.min("id").alias("first"))
    return plus.join(minus, "name").select("id", "mates", "first")


def u2_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Reads of both tables, as difference, intersection and union."""
    a, b = table(spark, folder, "alt_map").select(F.col("read_name").alias("name")).where("name is not null"), table(spark, folder, "clusters").select(F.col("readname").alias("name")).where("name is not null")
    return a.join(b, "name", "left_anti").distinct().select("name", F.lit("only a").alias("part")).unionByName(a.intersect(b).select("name", F.lit("both").alias("part"))).unionByName(b.join(a, "name", "left_anti").distinct().select("name", F.lit("only b").alias("part")))


def u5_unordered(spark: SparkSession, folder: str) -> DataFrame:
    """Unordered pairs of chromosomes, whichever way round, with their orientations."""
    rows = pairs(spark, folder).where("chrom is not null and mate_chrom is not null and chrom <> mate_chrom")
    return rows.groupBy(F.least("chrom", "mate_chrom").alias("a"), F.greatest("chrom", "mate_chrom").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("strand", "mate_strand").alias("ways"))


def f29_once(spark: SparkSession, folder: str) -> DataFrame:
    """Reads that stand once in all."""
    return table(spark, folder, "clusters").where("readname is not null").groupBy("readname").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("readname")


def o4_contig_order(spark: SparkSession, folder: str) -> DataFrame:
    """Contigs in natural order, numbers first, of those on the list of contigs."""
    seen = pairs(spark, folder).where("chrom is not null").select("chrom").distinct()
    known = table(spark, folder, "contigs").select(F.regexp_replace(F.trim("contig"), "^[cC][hH][rR]", "").alias("chrom")).distinct()
    number = F.expr("try_cast(chrom as int)")
    return seen.join(known, "chrom", "left_semi").select("chrom", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(number.isNull(), number, "chrom")).alias("place"))


def s17_carried(spark: SparkSession, folder: str) -> DataFrame:
    """In each file the last record with the duplicate flag, carried forward over the records after it; closing rows, named `last`, are no records."""
    rows = table(spark, folder, "block_boundaries").where("file_offset is not null and file_id is not null and not (read_name <=> 'last')")
    spots = rows.groupBy("file_id", "file_offset").agg(F.max(F.col("aln_flag").bitwiseAND(F.lit(1024).cast("long"))).alias("jump"))
    headed = spots.withColumn("header", F.when(F.col("jump") > 0, F.col("file_offset")))
    return running(headed, ["file_id"], "file_offset", "header", "section").select("file_id", "file_offset", "section")


SQL = {
    "x2_reverse_complement": "select doc_id, md5(reverse(translate(b, 'ACGT', 'TGCA'))) as rc, cast(length(b) - length(replace(b, 'N', '')) as int) as n from (select doc_id, translate(regexp_replace(text, '[^ACGTacgt]', 'N', 'g'), 'acgt', 'ACGT') as b from documents where text is not null)",
    "x3_prefix_difference": "select alt_id, cast(list_sum(list_transform(range(1, least(length(read_name), length(read_group)) + 1), lambda i: case when substr(read_name, i, 1) <> substr(read_group, i, 1) then 1 else 0 end)) as int) as differ from alt_map where read_name is not null and read_group is not null",
    "x7_trimmed": r"""with d as (select doc_id, text, string_split(text, ' ') as f from documents where text is not null)
select doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as trimmed, len(f) as fields, len(list_filter(f, lambda x: x <> '')) as words, md5(array_to_string(list_filter(f, lambda x: x <> ''), ' ')) as joined from d""",
    "x10_stem": "select alt_id, case when contains(read_name, ':') then regexp_extract(read_name, '^(.*):', 1) else read_name end as stem, case when read_strand = -1 then substr(read_name, length(read_name) - 7, 6) else substr(read_name, 3, 6) end as piece from alt_map where read_name is not null and read_strand in (1, -1)",
    "x19_cigar": "with "
    + PAIRS_SQL
    + """, c as (select id, len, nm, coalesce(mate_nm, 1) as m from pairs where len > 0 and nm is not null)
select id, true as clipped, (least(len, nm) >= 4 or least(len, m) >= 4) as big, nm || 'S' || (len + nm + 1 + 3) || 'M' || m || 'S' as normal, cast(greatest(len, 3) as int) as longest, cast(len + 5 as int) as span,
  case when nm = 0 and m = 0 then null when nm < m then 'back' else 'front' end as side, cast(len + nm + 7 as bigint) as matches, 80 as flag from c""",
    "x25_tails": r"""select doc_id, length(regexp_extract(text, '([.]*)$', 1)) as dots, length(regexp_extract(text, '^([A-Z]*)', 1)) as capitals,
  length(right(upper(text), 6)) - length(replace(right(upper(text), 6), 'A', '')) >= 5 as a_tail, length(left(upper(text), 6)) - length(replace(left(upper(text), 6), 'T', '')) >= 5 as t_head from documents where text is not null""",
    "x23_alternatives": "with "
    + PAIRS_SQL
    + """, h as (select *, min(nm) over (partition by name) as least from pairs where name is not null and chrom is not null and pos is not null and nm is not null)
select name, count(*) as n, case when bool_or(chrom = '1') then '1' else array_to_string(list_sort(list(distinct chrom)), ',') end as families from h where nm <= least + 1 group by name""",
    "j2_mate_lookup": "with " + PAIRS_SQL + ", m as (select name, count(*) as mates, min(id) as first from pairs where name is not null and strand = -1 group by name) select id, mates, first from pairs join m using (name) where strand = 1",
    "u2_sets": """select name, case when a and b then 'both' when a then 'only a' else 'only b' end as part from (select name, bool_or(s = 'a') as a, bool_or(s = 'b') as b from (select read_name as name, 'a' as s from alt_map union all select readname, 'b' from clusters) where name is not null group by name)""",
    "u5_unordered": "with " + PAIRS_SQL + " select least(chrom, mate_chrom) as a, greatest(chrom, mate_chrom) as b, count(*) as n, count(distinct case when strand is not null and mate_strand is not null then strand || ',' || mate_strand end) as ways from pairs where chrom is not null and mate_chrom is not null and chrom <> mate_chrom group by 1, 2",
    "f29_once": "select readname from clusters where readname is not null group by readname having count(*) = 1",
    "o4_contig_order": "with " + PAIRS_SQL + ", s as (select distinct chrom from pairs where chrom in (select regexp_replace(trim(contig), '^[cC][hH][rR]', '') from contigs)) select chrom, cast(row_number() over (order by try_cast(chrom as int) is null, try_cast(chrom as int), chrom) as int) as place from s",
    "s17_carried": """with s as (select file_id, file_offset, max(aln_flag & 1024) as jump from block_boundaries where file_offset is not null and file_id is not null and read_name is distinct from 'last' group by all)
select file_id, file_offset, max(case when jump > 0 then file_offset end) over (partition by file_id order by file_offset) as section from s""",
}

QUERIES = {f.__name__: f for f in (x2_reverse_complement, x3_prefix_difference, x7_trimmed, x10_stem, x19_cigar, x25_tails, x23_alternatives, j2_mate_lookup, u2_sets, u5_unordered, f29_once, o4_contig_order, s17_carried)}
