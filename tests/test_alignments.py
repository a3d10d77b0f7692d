import random
import re

from pyspark.sql import functions as F

from strandwise.functions import sequence as q


def chosen(hits, first, mate, apart, left_size, left_at, right_at):
    at = first
    for h in hits:
        if abs(abs(h - mate) - apart) < 2:
            return h
        if at < left_size and h < left_size and abs(h - left_at) < abs(at - left_at):
            at = h
        elif at > left_size + 100 and h > left_size + 100 and abs(h - right_at) < abs(at - right_at):
            at = h
    return at


def test_the_right_place_of_a_mate(spark):
    rnd = random.Random(1)
    rows = [([rnd.randrange(1000) for _ in range(rnd.randrange(6))], rnd.randrange(1000), rnd.randrange(1000)) for _ in range(200)] + [([131, 5], 700, 0)]
    got = spark.createDataFrame(rows, "hits array<int>, first int, mate int").select("hits", "first", "mate", q.choose_hit(F.col("hits"), F.col("first"), F.col("mate"), F.lit(131), F.lit(400), F.lit(350), F.lit(900)).alias("at"))
    assert all(r.at == chosen(r.hits, r.first, r.mate, 131, 400, 350, 900) for r in got.collect())


def test_quality_trimming_and_tails(spark):
    def trimmed(codes, good):
        if not codes or codes[-1] >= good:
            return len(codes)
        best, cut, s = None, 0, 0
        for i, c in enumerate(reversed(codes)):
            s += good - c
            if best is None or s > best:
                best, cut = s, i + 1
        return len(codes) - cut

    rnd = random.Random(2)
    quals = ["".join(chr(33 + rnd.choice((2, 10, 30, 40))) for _ in range(rnd.randrange(30))) for _ in range(150)]
    got = spark.createDataFrame([(x,) for x in quals], "qual string").select("qual", q.trim_length("qual", 20).alias("left")).collect()
    assert all(r.left == trimmed([ord(c) - 33 for c in r.qual], 20) for r in got)
    tails = {"ACGTAAAAA": "ACGT", "ACGTAAAA": "ACGTAAAA", "CGAAATAAA": "CG", "CGTATAAA": "CGT", "CGTTTAAA": "CGTTTAAA", "": "", None: None, "AAAAAA": ""}
    df = spark.createDataFrame([(x,) for x in tails], "s string").select("s", q.without_poly_tail("s", "A").alias("out"))
    assert {r.s: r.out for r in df.collect()} == tails


def test_segments_and_clip_positions(spark):
    df = spark.createDataFrame([("AACCCCGGGT", "2S4M1D3I1S", False), ("AACCCCGGGT", "2S4M3I1S", True), ("CCCC", "3H4M", False)], "seq string, cigar string, reverse boolean")
    ops = q.cigar_ops("cigar")
    got = df.select(q.segments(F.col("seq"), ops, F.col("reverse"), 2).alias("parts"), q.clip_position(F.lit(100), ops, F.col("reverse")).alias("at")).collect()
    assert [r.parts for r in got] == [["AA", "CCCCGGG"], ["TT", "CCCGGGG"], ["CCCC"]]
    assert [r["at"] for r in got] == [100, -104, 100]
    assert re.fullmatch("[ACGT]+", got[0].parts[1])
