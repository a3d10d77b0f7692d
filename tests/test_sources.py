import random

import pytest

from strandwise.runtime import checkpointed
from strandwise.sources.text_tables import cohort, fastq, numbered_lines
import gzip

from strandwise.sources import sinks, text_tables as t


def put(tmp_path, name, text):
    path = tmp_path / name
    if name.endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tables(spark, tmp_path):
    assert rows(t.blacklist(spark, put(tmp_path, "b.gz", "1\t5\t900\n#x\n2\tbad\t7\n"))) == [("1", 5, 900), ("2", None, 7)]
    assert rows(t.tsv(spark, put(tmp_path, "e.txt", "a\t\tc\n"), [(1, "x", "string")], keep_empty=False)) == [("c",)]
    assert rows(t.names(spark, put(tmp_path, "n.txt", "rg1\n\nrg1 \n"))) == [("rg1",)]
    assert rows(t.repeat_classes(spark, put(tmp_path, "r.txt", "l1\tLINE/L1\nx\n"))) == [("L1", "LINE", "L1"), ("X", "NA", "NA")]
    assert rows(t.virus_names(spark, put(tmp_path, "v.txt", "gi|12|ref|NC|Some virus, complete\n"))) == [("12", "Some virus")]
    assert rows(t.gene_table(spark, put(tmp_path, "g.txt", "chrom\tst\ts\te\tn\tt\n1\t+\t5\t9\tA\tcoding\n"))) == [("1", "+", 5, 9, "A", "coding")]
    assert rows(t.assembly_gaps(spark, put(tmp_path, "gap.txt", "#bin\tchrom\tchromStart\tchromEnd\n0\tchr1\t0\t10\n"))) == [("chr1", 1, 11)]
    assert rows(t.sectioned_intervals(spark, put(tmp_path, "s.txt", "key: L1 chr2\n5 9\n11 12\nkey: Alu chr3\n1 2\n"))) == [("Alu", "chr3", 1, 2), ("L1", "chr2", 11, 12), ("L1", "chr2", 5, 9)]
    head, names = t.first_stats(spark, put(tmp_path, "f.txt", "10\n2\n3\n101\n1\nr1\nr2\n"))
    assert rows(head.drop("file")) == [(10, 2, 3, 101, 1)] and rows(names.drop("file")) == [("r1",), ("r2",)]
    mobile, simple = t.repeat_tracks(spark, put(tmp_path, "k.txt", "\t".join("0 0 0 0 0 chr1 5 9 + 0 L1HS LINE L1".split()) + "\n" + "\t".join("0 0 0 0 0 chr1 15 19 + 0 (CA)n Simple_repeat x".split()) + "\n"))
    assert rows(mobile) == [("chr1", 5, 9, "L1HS", "LINE")] and simple.count() == 1
    hits = t.local_hits(spark, put(tmp_path, "m8.txt", "q\ts\t99.5\t50\t1\t0\t1\t50\t7\t56\t1e-9\t88.5\n"))
    assert rows(hits.select("query", "pct_id", "s_end")) == [("q", 99.5, 56)]


def test_isinfo_and_gaps(spark, tmp_path):
    text = "Read length of\trg1\n100\nMean insert size of\trg1\n300.5\nMedian insert size of\trg1\n300\nStandard deviation of\trg1\n20.5\n"
    got = t.isinfo(spark, put(tmp_path, "i.isinfo", text))
    assert rows(got) == [("rg1", 100.0, 300.5, 300.0, 20.5, 362, 237)]
    assert ("all", 300.0, 20.0) in rows(t.with_all(got.select("rg", "mean", "sd"), ["mean", "sd"]))
    g = t.gaps_of_sizes(got.select("rg", "mean", "sd", "read_length")).first()
    assert (g.fr, g.intra_gap, g.inter_gap, g.gap_size, g.ins_margin) == (362, 174, 348, 300, 543)


def test_anchored_mates(spark, tmp_path):
    classes = spark.createDataFrame([("L1", "LINE", "L1")], "name string, class string, family string")
    path = put(tmp_path, "ram.txt", "r1\t1\t-50\tl1,zz\nr2\t1\t0\tl1\nr3\t2\t7\n")
    assert rows(t.anchored_mates(spark, path, classes)) == [("r1", "1", 50, -1, "l1", "LINE", "L1"), ("r1", "1", 50, -1, "zz", "*", "-"), ("r3", "2", 7, 1, "-", "*", "-")]


def test_sam_fastq_fasta(spark, tmp_path):
    line = "r1\t99\tchr1\t100\t37\t5S45M\t=\t300\t245\tACGTN\tIIIII\tNM:i:2\tXA:Z:chr2,-500,50M,3;chr3,+7,50M,1;\tMD:Z:10A34\n"
    row = t.sam(spark, put(tmp_path, "x.sam", "@HD\tVN:1\n" + line)).first()
    assert (row.name, row.mate_chrom, row.paired, row.reverse, row.mate_reverse, row.tags["NM"]) == ("r1", "chr1", True, False, True, "2")
    assert [tuple(c) for c in row.cigar] == [("S", 5), ("M", 45)] and [tuple(h) for h in row.hits] == [("chr2", -1, 500, "50M", 3), ("chr3", 1, 7, "50M", 1)]
    assert rows(t.fastq(spark, put(tmp_path, "x.fq.gz", "@a/1\nACGT\n+\nIIII\n@b/1\nTT\n+\n@@\n"))) == [("a/1", "ACGT", "IIII"), ("b/1", "TT", "@@")]
    seqs = t.fasta(spark, put(tmp_path, "x.fa", ">c1 long name\nACGT\nACGA\n>c2\nTTTT\n"))
    assert rows(seqs) == [("c1", "ACGTACGA"), ("c2", "TTTT")]
    ranges = spark.createDataFrame([(1, "c1", 2, 7), (2, "c1", 7, 2), (3, "c2", 4, 4)], "id int, chrom string, start long, stop long")
    assert rows(t.fetch_ranges(ranges, t.reference_chunks(seqs, 3), "id", 3)) == [(1, "CGTACG"), (2, "CGTACG"), (3, "T")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.005, ["x", "y"], None)], "n string, v double, l array<string>, z int")
    sinks.write_tsv(df, str(tmp_path / "out"), two_places=["v"], missing="-")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    line = next(x for x in text.splitlines() if x.startswith("a\t"))
    assert line.endswith("\tx,y\t-") and line.count("\t") == 3
    pairs = spark.createDataFrame([("p", "ACNN", "IIHH", True, "NAAA", "ABCD", False), ("q", "A", "I", False, "C", "J", False)], "name string, seq1 string, qual1 string, reverse1 boolean, seq2 string, qual2 string, reverse2 boolean")
    assert rows(sinks.pair_fastq_lines(pairs, 2)) == [("@q/1\nA\n+\nI", "@q/2\nC\n+\nJ")]
    assert ("@p/1\nNNGT\n+\nHHII", "@p/2\nNAAA\n+\nABCD") in rows(sinks.pair_fastq_lines(pairs, 3))
    bed = spark.createDataFrame([(1, 0, 3, "1", 500, 1, "1", 20_000, -1), (2, 0, 3, "1", 500, 1, "1", 900, -1), (3, 0, 9, "GL1", 5, 1, "1", 9, 1)], "pid int, sid int, support int, chrom string, pos long, strand int, mchrom string, mpos long, mstrand int")
    assert rows(sinks.discord_bed(bed)) == [("1", 0, 1500, "1", 19000, 21000, 1, 0, "+", "-")]
    events = spark.createDataFrame([(1, 2, "del", "1", 5, 9), (1, 3, "del", "1", 0, 9)], "pid int, partner int, event string, chrom string, start long, `end` long")
    assert rows(sinks.event_lines(events)) == [("del\t1/2\t1\t5\t9\t4",)]


def test_large_files_are_numbered_in_blocks(spark, tmp_path):
    rnd = random.Random(1)
    files = {}
    for name, n in (("a.fq", 500), ("b.fq", 3)):
        files[name] = [(f"r{i}", "".join(rnd.choice("ACGTn") for _ in range(rnd.randrange(1, 40)))) for i in range(n)]
        (tmp_path / name).write_text("".join(f"@{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in files[name]) + ("@left over\nAC\n" if name == "b.fq" else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        by = {}
        for r in lines.collect():
            by.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
        assert all([by[name][i] for i in sorted(by[name])] == (tmp_path / name).read_text().splitlines() for name in files)
        got = sorted(map(tuple, fastq(spark, str(tmp_path)).collect()))
        assert got == sorted((i, s, "@" * len(s)) for own in files.values() for i, s in own)
        assert "n" not in "".join(r.seq for r in fastq(spark, str(tmp_path), plain=True).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_of_a_cohort(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("del\t5\n")
    (tmp_path / "y.tsv").write_text("del\t7\ninv\t9\n")
    (tmp_path / "list.txt").write_text("x.tsv\tone\ny.tsv\n")
    got = cohort(spark, str(tmp_path / "list.txt"), [(0, "event", "string"), (1, "at", "long")]).collect()
    assert sorted(map(tuple, got)) == [("del", 5, "one"), ("del", 7, "y.tsv"), ("inv", 9, "y.tsv")]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        checkpointed(Frame())
