import random

from pyspark.sql import functions as F

from strandwise.operators.regions import demoted_name, insertion_orientation, is_orphan, is_transduction, merge_regions, widen


def brute(rows):
    now = {}
    for i, c, m, *b in rows:
        now.setdefault((c, m, *b), []).append(i)
    now = [(c, m, *b, min(ids), len(ids)) for (c, m, *b), ids in now.items()]
    while True:
        for x in range(len(now)):
            for y in range(x + 1, len(now)):
                p, q = now[x], now[y]
                if p[:2] == q[:2] and p[2] <= q[3] and q[2] <= p[3] and p[4] <= q[5] and q[4] <= p[5]:
                    break
            else:
                continue
            break
        else:
            return {(i, c, m, a1, a2, b1, b2, n) for c, m, a1, a2, b1, b2, i, n in now}
        joined = (*p[:2], min(p[2], q[2]), max(p[3], q[3]), min(p[4], q[4]), max(p[5], q[5]), min(p[6], q[6]), p[7] + q[7])
        now = [r for k, r in enumerate(now) if k not in (x, y)] + [joined]


def test_merging_reaches_the_fixpoint(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(120):
        a, b = rnd.randrange(4000), rnd.randrange(4000)
        rows.append((i, rnd.choice("xy"), "z", a, a + rnd.randrange(300), b, b + rnd.randrange(300)))
    rows += [(900, *rows[3][1:]), (901, "x", "z", 9, 5, 1, 2)]
    df = spark.createDataFrame(rows, "id long, chrom string, mate_chrom string, a1 long, a2 long, b1 long, b2 long")
    got = {(r.id, r.chrom, r.mate_chrom, r.a1, r.a2, r.b1, r.b2, r.ids) for r in merge_regions(df).collect()}
    assert got == brute(rows[:-1])


def test_rounds_of_merging_keep_a_bounded_estimate(spark):
    """Three rounds: 1 meets 2, their hull 3 and 4, and that hull 5. The estimated size may not grow with them."""
    rows = [(1, "x", "z", 0, 10, 0, 10), (2, "x", "z", 8, 20, 8, 20), (3, "x", "z", 15, 30, 0, 5), (4, "x", "z", 0, 5, 15, 40), (5, "x", "z", 22, 60, 30, 35), (9, "x", "z", 100, 101, 0, 10)]
    merged = merge_regions(spark.createDataFrame(rows, "id long, chrom string, mate_chrom string, a1 long, a2 long, b1 long, b2 long"))
    assert {(r.id, r.chrom, r.mate_chrom, r.a1, r.a2, r.b1, r.b2, r.ids) for r in merged.collect()} == brute(rows)
    assert merged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 70


def test_rules(spark):
    t, f = F.lit(True), F.lit(False)
    orphans = [is_orphan(t, f, f, f, t), is_orphan(t, f, f, f, f), is_orphan(f, t, t, f, f), is_orphan(f, f, f, t, t), is_orphan(f, t, f, f, t), is_transduction(t, f, t, t, t, t), is_transduction(t, f, t, f, t, t), is_transduction(t, t, f, f, f, t)]
    assert tuple(spark.range(1).select(*[o.alias(f"c{i}") for i, o in enumerate(orphans)]).first()) == (True, False, False, True, True, False, True, False)
    names = [demoted_name(F.lit(x)) for x in ("inssd", "del_insou", "del_invers", "inso", "del")] + [insertion_orientation(F.lit("+-"), F.lit("++")), insertion_orientation(F.lit("++"), F.lit("++"))]
    assert tuple(spark.range(1).select(*[n.alias(f"c{i}") for i, n in enumerate(names)]).first()) == ("tandem_dup", "invers_f", "invers_f", "transl_inter", "del", "1 inv", None)
    wide = widen(spark.createDataFrame([(5, 9)], "a long, b long"), [("a", "b")], 10).first()
    assert tuple(wide) == (0, 19)
