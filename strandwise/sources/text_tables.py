"""Readers of the text formats of the domain. Each takes a path (plain or compressed) and gives a DataFrame; nothing is read on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.arrowgroups import run_starts
from strandwise.functions.sequence import alternative_hits, cigar_ops, plain_bases, reverse_complement, split_drop_empty, split_keep_empty, trim_length
from strandwise.operators.carry import running

# Classes of annotated repeats that go to the table of mobile elements and to that of simple repeats.
MOBILE = ("LINE", "SINE", "LTR", "DNA", "Other")
SIMPLE = ("Satellite", "Simple_repeat", "Low_complexity")


def tsv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[tuple[int, str, str]], keep_empty: bool = True, comment: str | None = "#", skip: int = 0) -> DataFrame:
    """Columns (index, name, type) of tab-separated lines. Values that don't parse are null, missing fields too.

    `keep_empty=False` joins neighbouring separators. `skip` leaves out so many
    lines of each file; it needs a file to be read as one split.
    """
    lines = numbered_lines(spark, path).where(F.col("line_no") >= skip) if skip else spark.read.text(path if isinstance(path, str) else list(path)).withColumnRenamed("value", "line")
    if comment:
        lines = lines.where(~F.col("line").startswith(comment))
    fields = split_keep_empty("line") if keep_empty else split_drop_empty("line")
    parts = lines.where("line <> ''").select(fields.alias("f"))
    return parts.select(*[F.expr(f"try_cast(get(f, {i}) as {kind})").alias(name) for i, name, kind in columns])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, line -> the same with `at`, the place of the line in its block; the lines of a block come in one run."""
    here, done = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = run_starts(batch.columns[:2])
        at = np.arange(batch.num_rows)
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
            since = done if key == here else 0
            at[a:b] += since - a
            here, done = key, since + b - a
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, line_no (from 0 in its file), line. Files are read in blocks, by as many tasks as they have; a line's number is its place in its block after the lines of the blocks before."""
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    placed = lines.mapInArrow(_numbered, "file string, block long, line string, at long")
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # one row a block
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at")).alias("line_no"), "line")


def isinfo(spark: SparkSession, path: str, k: float = 3.0) -> DataFrame:
    """Insert-size info: a label line (`Median of ...<tab>rg`, ...) and its value on the next: rg, read_length, mean, median, sd, upper, lower."""
    lines = numbered_lines(spark, path)
    nxt = F.lead("line").over(Window.partitionBy("file").orderBy("line_no"))
    label = lines.withColumn("number", nxt)
    kind = F.when(F.col("line").startswith("Read length"), "read_length").when(F.col("line").startswith("Mean"), "mean").when(F.col("line").startswith("Median"), "median").when(F.col("line").startswith("Standard deviation"), "sd")
    rows = label.select(kind.alias("kind"), F.element_at(F.split("line", "\t"), -1).alias("rg"), F.expr("try_cast(number as double)").alias("v")).where("kind is not null")
    wide = rows.groupBy("rg").agg(*[F.max(F.when(F.col("kind") == x, F.col("v"))).alias(x) for x in ("read_length", "mean", "median", "sd")])
    return wide.withColumns({"upper": (F.col("median") + k * F.col("sd")).cast("long") + 1, "lower": (F.col("median") - k * F.col("sd")).cast("long") - 1})


def with_all(stats: DataFrame, values: Sequence[str]) -> DataFrame:
    """Read-group rows and a row `all` with their mean, truncated to whole numbers."""
    return stats.select("rg", *values).unionByName(stats.agg(*[F.avg(v).cast("long").cast("double").alias(v) for v in values]).withColumn("rg", F.lit("all")).select("rg", *values))


def gaps_of_sizes(sizes: DataFrame) -> DataFrame:
    """rg, mean, sd, read_length -> the gaps derived from them."""
    c = F.col
    out = sizes.withColumn("fr", F.floor(c("mean") + 3 * c("sd")))
    out = out.withColumn("intra_gap", F.least(F.lit(250), F.floor((c("fr") - c("read_length")) * 2 / 3)))
    return out.withColumns({"inter_gap": 2 * c("intra_gap"), "gap_size": F.floor(2 * c("mean") / 3 + c("read_length")), "ins_margin": F.floor(1.5 * c("fr"))})


def blacklist(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, [(0, "chrom", "string"), (1, "pos", "long"), (2, "depth", "long")])


def names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def repeat_classes(spark: SparkSession, path: str) -> DataFrame:
    """name<tab>class/family; the class defaults to NA."""
    rows = tsv(spark, path, [(0, "name", "string"), (1, "both", "string")])
    parts = F.split("both", "/")
    return rows.select(F.upper("name").alias("name"), F.coalesce(F.get(parts, F.lit(0)), F.lit("NA")).alias("class"), F.coalesce(F.get(parts, F.lit(1)), F.lit("NA")).alias("family"))


def virus_names(spark: SparkSession, path: str) -> DataFrame:
    """Fields between pipes and commas: the key is the second, the description the fifth."""
    f = F.filter(F.split("value", r"[|,]"), lambda x: x != "")
    return spark.read.text(path).select(F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(4)).alias("description")).where("name is not null")


def sectioned_intervals(spark: SparkSession, path: str) -> DataFrame:
    """`key: NAME CHROM` opens a section; each `start end` line below is an interval of it."""
    lines = numbered_lines(spark, path)
    # The number of the last header is carried, not its text, and its text is looked up.
    numbered = running(lines.withColumn("own", F.when(F.col("line").startswith("key:"), F.col("line_no"))), ["file"], "line_no", "own", "head_no").drop("own")
    heads = lines.where(F.col("line").startswith("key:")).select("file", F.col("line_no").alias("head_no"), F.col("line").alias("head"))
    carried = numbered.join(heads, ["file", "head_no"])
    f, h = F.split(F.trim("line"), r"\s+"), F.split(F.trim(F.substring("head", 5, 1_000_000)), r"\s+")
    rows = carried.where("head is not null and not startswith(line, 'key:')")
    return rows.select(h[0].alias("name"), F.get(h, F.lit(1)).alias("chrom"), F.expr("try_cast(split(trim(line), '\\\\s+')[0] as long)").alias("start"), f.alias("f")).select("name", "chrom", "start", F.expr("try_cast(get(f, 1) as long)").alias("stop")).where("start is not null and stop is not null")


def assembly_gaps(spark: SparkSession, path: str) -> DataFrame:
    """A `#` header names chrom, chromStart and chromEnd; both ends are counted from 1."""
    lines = numbered_lines(spark, path)
    header = F.first(F.when(F.col("line").startswith("#"), F.split(F.substring("line", 2, 1_000_000), "\t")), True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = lines.withColumn("h", header).where("not startswith(line, '#') and line <> ''").withColumn("m", F.map_from_entries(F.arrays_zip(F.col("h").alias("k"), F.slice(F.concat(F.split("line", "\t"), F.array_repeat(F.lit(None).cast("string"), 100)), 1, F.size("h")).alias("v"))))
    return rows.select(F.col("m")["chrom"].alias("chrom"), (F.col("m")["chromStart"].cast("long") + 1).alias("start"), (F.col("m")["chromEnd"].cast("long") + 1).alias("stop"))


def gene_table(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, [(0, "chrom", "string"), (1, "strand", "string"), (2, "s", "long"), (3, "e", "long"), (4, "gene_name", "string"), (5, "gene_type", "string")], skip=1).where("gene_name is not null")


def repeat_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A repeat track, routed by class into mobile elements and simple repeats."""
    rows = tsv(spark, path, [(5, "chrom", "string"), (6, "s", "long"), (7, "e", "long"), (10, "name", "string"), (11, "class", "string")]).where("s is not null and e is not null")
    return rows.where(F.col("class").isin(*MOBILE)), rows.where(F.col("class").isin(*SIMPLE))


def first_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Five scalar lines in one row, and the names after them."""
    lines = numbered_lines(spark, path)
    value = lambda i: F.max(F.when(F.col("line_no") == i, F.expr("try_cast(line as long)")))
    head = lines.groupBy("file").agg(*[value(i).alias(n) for i, n in enumerate(("total", "unmapped", "clipped", "max_read_len", "encoding"))])
    return head, lines.where("line_no >= 5 and line <> ''").select("file", F.col("line").alias("name"))


def anchored_mates(spark: SparkSession, path: str, classes: DataFrame, with_sequence: bool = False) -> DataFrame:
    """name, chrom, signed position[, sequence id][, comma list of repeats] -> a row a repeat, with class and family; position 0 goes."""
    last = 4 if with_sequence else 3
    rows = tsv(spark, path, [(0, "name", "string"), (1, "chrom", "string"), (2, "signed", "long"), (last, "repeats", "string")]).where("signed <> 0")
    each = rows.select("name", "chrom", F.abs("signed").alias("pos"), F.signum("signed").cast("int").alias("strand"), F.explode_outer(F.split("repeats", ",")).alias("repeat"))
    joined = each.join(classes.withColumnRenamed("name", "cname"), F.upper("repeat") == F.col("cname"), "left")
    return joined.select("name", "chrom", "pos", "strand", F.coalesce("repeat", F.lit("-")).alias("repeat"), F.coalesce("class", F.lit("-" if with_sequence else "*")).alias("class"), F.coalesce("family", F.lit("-")).alias("family"))


def local_hits(spark: SparkSession, path: str) -> DataFrame:
    """Twelve-column local alignments."""
    columns = ("query", "subject", "pct_id", "aln_len", "mismatches", "gap_opens", "q_start", "q_end", "s_start", "s_end", "evalue", "bitscore")
    kinds = ("string", "string", "double", *["long"] * 7, "double", "double")
    return tsv(spark, path, [(i, c, k) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))])


def sam(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Alignments of SAM text: fields, CIGAR operations, tags as a map, hits of XA, counted from 1."""
    lines = spark.read.text(path if isinstance(path, str) else list(path)).where("not startswith(value, '@') and value <> ''")
    f = F.split("value", "\t")
    tags = F.map_from_entries(F.transform(F.slice(f, 12, 1_000), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.regexp_replace(t, "^..:.:", "").alias("v"))))
    out = lines.select(f.alias("f"), tags.alias("tags"))
    c = F.col("f")
    rows = out.select(c[0].alias("name"), c[1].cast("int").alias("flag"), c[2].alias("chrom"), c[3].cast("long").alias("pos"), c[4].cast("int").alias("mapq"), cigar_ops(c[5]).alias("cigar"), F.when(c[6] == "=", c[2]).otherwise(c[6]).alias("mate_chrom"), c[7].cast("long").alias("mate_pos"), c[8].cast("long").alias("isize"), c[9].alias("seq"), c[10].alias("qual"), "tags")
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    return rows.withColumns({"paired": bit(1), "mapped": ~bit(4), "mate_mapped": ~bit(8), "reverse": bit(16), "mate_reverse": bit(32), "first": bit(64), "secondary": bit(256), "qc_fail": bit(512), "duplicate": bit(1024), "hits": alternative_hits(F.col("tags")["XA"])})


def fastq(spark: SparkSession, path: str | Sequence[str], good: int | None = None, plain: bool = False) -> DataFrame:
    """name, seq, qual of four-line records; records are put together by the numbers of their lines, so a large file is read by many tasks.

    `good` trims the end down to that quality, `plain` makes N of all that is no
    base. What is left over at the end of a file is no record.
    """
    lines = numbered_lines(spark, path).withColumns({"record": F.expr("line_no div 4"), "part": F.col("line_no") % 4})
    part = lambda i: F.max(F.when(F.col("part") == i, F.col("line")))
    records = lines.groupBy("file", "record").agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual")).where("startswith(head, '@') and qual is not null")
    rows = records.select(F.substring("head", 2, 1_000_000).alias("name"), plain_bases("seq").alias("seq") if plain else "seq", "qual")
    if good is None:
        return rows
    left = trim_length("qual", good)
    return rows.withColumn("left", left).select("name", F.substr("seq", F.lit(1), F.col("left")).alias("seq"), F.substr("qual", F.lit(1), F.col("left")).alias("qual"))


def fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """name, seq of each record; records are split at `>`, so a large file is read by many tasks."""
    rows = spark.read.option("lineSep", ">").text(path if isinstance(path, str) else list(path)).where("trim(value) <> ''")
    name = F.regexp_extract("value", r"^([^\s]+)", 1)
    return rows.select(name.alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def reference_chunks(seqs: DataFrame, size: int = 65_536) -> DataFrame:
    """name, seq -> chrom, chunk, seq: pieces of equal size, for range fetches by equi join."""
    n = F.expr(f"sequence(0, (char_length(seq) - 1) div {size})")
    return seqs.where("seq <> ''").select(F.col("name").alias("chrom"), "seq", F.explode(n).alias("chunk")).select("chrom", "chunk", F.substr("seq", F.col("chunk") * size + 1, F.lit(size)).alias("seq"))


def fetch_ranges(ranges: DataFrame, chunks: DataFrame, id: str, size: int = 65_536) -> DataFrame:
    """`id`, `fetched`: bases start to stop, counted from 1 and inclusive; a start after the stop gives the reverse complement."""
    spans = ranges.select(F.col(id).alias("id"), "chrom", F.least("start", "stop").alias("a"), F.greatest("start", "stop").alias("b"), (F.col("start") > F.col("stop")).alias("back"))
    parts = spans.withColumn("chunk", F.explode(F.expr(f"sequence((a - 1) div {size}, (b - 1) div {size})"))).join(chunks, ["chrom", "chunk"])
    low = F.greatest(F.col("a") - F.col("chunk") * size, F.lit(1))
    piece = F.substr("seq", low.cast("int"), (F.least(F.col("b") - F.col("chunk") * size, F.lit(size)) - low + 1).cast("int"))
    whole = parts.groupBy("id", "back").agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))).alias("x")).withColumn("s", F.array_join(F.col("x.p"), ""))
    return whole.select(F.col("id").alias(id), F.when(F.col("back"), reverse_complement("s")).otherwise(F.col("s")).alias("fetched"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Read group and read length, tab-separated."""
    return tsv(spark, path, [(0, "rg", "string"), (1, "read_length", "long")]).where("rg is not null")


def listed_files(spark: SparkSession, listing: str) -> list[tuple[str, str]]:
    """Paths and group ids of a list of files, one a line, with the group after a tab or else the path itself; paths beside the list may be relative. The list is read on the driver, as it names what is to be read."""
    base = listing.rsplit("/", 1)[0]
    rows = [r.value.split("\t") for r in spark.read.text(listing).where("trim(value) <> ''").collect()]
    return [(x[0] if x[0].startswith("/") or "://" in x[0] else f"{base}/{x[0]}", x[1] if len(x) > 1 else x[0]) for x in rows]


def cohort(spark: SparkSession, listing: str, columns: Sequence[tuple[int, str, str]]) -> DataFrame:
    """The lines of all listed files as columns (index, name, type), each with the `group_id` of its file."""
    files = listed_files(spark, listing)
    parts = [tsv(spark, path, columns).withColumn("group_id", F.lit(group)) for path, group in files]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
