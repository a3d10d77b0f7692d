"""Queries over whole inputs: what earlier bounds left out."""

import pytest

from strandwise.operators.events import intra_events
from strandwise.plans import insertions, interval_queries, text_functions, variants


def test_wildcard_clusters_cross_megabases(spark, monkeypatch):
    edge = 1 << 20
    rows = [(1, "c", 1, edge - 100, "L1"), (2, "c", 1, edge + 50, "POLYA"), (3, "c", 1, edge + 200, "L1"), (4, "c", 1, edge + 900, "L1")]
    df = spark.createDataFrame(rows, "id long, chrom string, strand int, pos long, family string")
    monkeypatch.setattr(insertions, "_anchored", lambda *_: df)
    got = {(r.family, r.cluster_no, r.s, r.e, r.ram) for r in insertions.w1_wildcard(spark, "").collect()}
    assert got == {("L1", 0, edge - 100, edge + 200, 3), ("POLYA", 0, edge + 50, edge + 50, 1), ("L1", 1, edge + 900, edge + 900, 1)}


def test_mechanism_of_every_event(spark, monkeypatch):
    rows = [(1, None, "", "del", 1000, 1100, None, None, 99, None, 5), (2, None, "", "del", 5000, 5999, None, None, 998, None, 120), (3, None, "", "del", 1_000_000, 1_900_000, None, None, 9, None, 55), (5, None, "", "del", 20_000, 20_099, None, None, 98, None, 0), (6, None, "", "del", 30_000, 30_010, None, None, 9, None, 1)]
    rows += [(7, 70, "inssd", "del_inssd", 1000, 1100, 20_000, 20_044, 99, 45, None), (8, 80, "inssd", "del_inssd", 40_000, 40_100, 1000, 1100, 99, 101, None), (9, 90, "insou", "del_insou", 40_000, 40_100, 50_000, 50_005, 99, 6, None), (10, 91, "insou", "del_insou", 40_000, 40_100, 50_000, 50_050, 99, 51, None)]
    rows += [(11, 92, "insod", "insod", 40_000, 40_001, 1000, 1100, 0, 101, None), (12, 93, "invers", "del_invers", 40_000, 40_300, 41_000, 41_200, 299, 5, None), (13, None, "", "tandem_dup", 60_000, 60_099, None, None, 99, None, 0), (14, None, "", "transl_inter", 1000, 1100, None, None, None, None, 3)]
    v = spark.createDataFrame([(*r[:4], "c", *r[4:6], "d" if r[3] == "transl_inter" else "c", *r[6:]) for r in rows], "pid long, partner long, rule string, event string, chrom string, start long, end long, mate_chrom string, mate_start long, mate_end long, size long, inserted long, homology long")
    reps = [("c", 1000, 1100, "ALU", "SINE"), ("c", 5990, 7000, "L1", "LINE"), ("c", 20_000, 20_044, "A", "SINE"), ("c", 20_050, 20_099, "B", "SINE"), ("c", 1_000_000, 1_900_000, "BIG", "LINE"), ("c", 60_010, 60_200, "CA", "SIMPLE_REPEAT")]
    monkeypatch.setattr(variants, "_variants", lambda *_: v)
    monkeypatch.setattr(variants, "repeats", lambda *_: spark.createDataFrame(reps, "chrom string, s long, e long, rname string, rclass string"))
    got = {r.pid: (r.element, r.mechanism) for r in variants.e17_mechanism(spark, "").collect()}
    assert got == {1: ("ALU", "TEI"), 2: (None, "NAHR"), 3: (None, "alt-EJ"), 5: ("complex", "TEI"), 6: (None, "NHEJ"), 7: ("ALU", "TEA"), 8: (None, "TEI"), 9: (None, "NHEJ"), 10: (None, "NA"), 11: (None, "TEI"), 12: (None, "FoSTeS"), 13: (None, "VNTR"), 14: (None, "NA")}


CASES = {
    # event: anchor (s1, s2, m1, m2, t), partner, start, end, mate_start, mate_end, deleted, inserted; worked out by hand
    "inssd": ((1000, 1100, 1500, 1600, 3), (700, 950, 1450, 1700, 0), 950, 1000, 1450, 1600, 49, 151),
    "del_inssu": ((1000, 1100, 1500, 1600, 3), (1200, 1300, 2000, 2100, 0), 1600, 2000, 1000, 1300, 399, 301),
    "invers": ((1000, 1100, 5000, 5100, 1), (1150, 1250, 5150, 5250, 2), 1100, 1150, 5100, 5150, 49, 3950),
    "del_invers": ((1000, 1100, 5000, 5100, 1), (2000, 2100, 6000, 6100, 2), 1100, 2000, 5100, 6000, 899, 3100),
    "del_insod": ((1000, 1100, 5000, 5100, 1), (1300, 1400, 4000, 4100, 2), 1100, 1300, 4000, 5100, 199, 1101),
    "insou": ((3000, 3100, 5000, 5100, 1), (2500, 2600, 5150, 5250, 2), 5100, 5150, 2500, 3100, 49, 601),
}


@pytest.mark.parametrize("event", CASES)
def test_each_rule_by_hand(spark, event):
    anchor, partner, *want = CASES[event]
    df = spark.createDataFrame([(1, "c", *anchor), (2, "c", *partner), (1, "d", *partner)], "pid long, chrom string, s1 long, s2 long, m1 long, m2 long, t int")
    got = [tuple(r) for r in intra_events(df, 100, 10**9).select("event", "pid", "partner", "start", "end", "mate_start", "mate_end", "deleted", "inserted").collect()]
    assert (event, 1, 2, *want) in got


def test_events_between_chromosomes_by_hand(spark, monkeypatch):
    """Both branches of both kinds; a partner of any distance; the first in both rankings; not the cluster itself."""
    rows = [(1, "a", "b", 1, 100, 200, 5000, 5100), (2, "a", "b", 2, 250, 300, 4900, 4950), (3, "a", "b", 0, 9_000_000, 9_000_100, 100, 150), (4, "a", "b", 3, 50, 90, 60, 80), (5, "c", "d", 0, 1000, 1100, 100, 200), (6, "c", "d", 3, 1500, 1600, 250, 900), (6, "c", "d", 0, 7, 8, 9, 10), (7, "e", "d", 1, 1, 2, 3, 4), (8, "e", "d", 2, 1, 2, 3, 4)]
    monkeypatch.setattr(variants, "clusters", lambda *_: spark.createDataFrame([(*r, 1, 0) for r in rows], "pid long, chrom string, mate_chrom string, t int, s1 long, s2 long, m1 long, m2 long, support long, mm long"))
    got = {(r.pid, r.partner): tuple(r)[2:] for r in variants.e6_inter(spark, "").collect()}
    assert got == {
        (1, 2): ("inso", "A", "a", 200, 250, "b", 4900, 5100, 49, 201),
        (3, 4): ("inss", "B", "b", 80, 100, "a", 50, 9_000_100, 19, 9_000_051),
        (5, 6): ("del_inss", "A", "c", 1100, 1500, "d", 100, 900, 399, 801),
    }
    assert {(r.pid, r.partner, r.r1, r.r2) for r in variants.j9_two_rankings(spark, "").collect()} == {(1, 2, 1, 1), (3, 4, 1, 1), (5, 6, 1, 1), (7, 8, 1, 1)}


def test_clips_vote_on_exact_positions(spark, monkeypatch):
    rows = [("c", 1, 101, 3, 50), ("c", -1, 149, 1, 50)]
    monkeypatch.setattr(insertions, "pairs", lambda *_: spark.createDataFrame(rows, "chrom string, strand int, pos long, nm long, len long"))
    assert sorted(tuple(r) for r in insertions._clips(spark, "").collect()) == [("c", -1, 149), ("c", -1, 150), ("c", 1, 101), ("c", 1, 104)]


def test_members_with_far_ends_are_flagged(spark, monkeypatch):
    rows = [(1, "c", "c", 100, 5000, 1), (2, "c", "c", 100, 20_000, 1), (3, "c", "c", 9000, 9100, 1), (4, "c", "c", 100, 9400, 1), (5, "c", "c", 9000, 9100, 2)]
    monkeypatch.setattr(interval_queries, "members", lambda *_: spark.createDataFrame(rows, "cluster_id long, chrom string, mate_chrom string, pos long, mate_pos long, nm long"))
    monkeypatch.setattr(interval_queries, "repeats", lambda *_: spark.createDataFrame([("c", 5400, 8600, "R", "LINE")], "chrom string, s long, e long, rname string, rclass string"))
    assert {r.cluster_id: r.oi for r in interval_queries.j10_near_repeat(spark, "").collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1}


def test_mates_of_any_mismatches(spark, monkeypatch):
    rows = [(1, "r", 1, 9), (2, "r", -1, 1), (3, "r", -1, None)]
    monkeypatch.setattr(text_functions, "pairs", lambda *_: spark.createDataFrame(rows, "id long, name string, strand int, nm long"))
    assert [tuple(r) for r in text_functions.j2_mate_lookup(spark, "").collect()] == [(1, 2, 2)]
