import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwise.functions import sequence as q
from strandwise.functions.names import norm_contig, norm_name, norm_source
from strandwise.operators.assignment import Assigner
from strandwise.operators.carry import running
from strandwise.operators.coverage import coverage
from strandwise.operators.gap_clusters import gap_clusters, wildcard_clusters
from strandwise.operators.intervals import LEVELS, exists_overlap, fold_overlap, overlap_join, point_join
from strandwise.operators.pairing import confidence, insertion_score, strand_modes
import strandwise.operators.set_packing as set_packing
from strandwise.operators.set_packing import components, pack_sets


@pytest.mark.parametrize("how", ["max", "sum"])
def test_running_is_a_window_over_the_key(spark, how):
    rnd = random.Random(1)
    rows = [(rnd.choice(("a", "a", None)), at, rnd.choice((None, 1, 5, -3))) for at in rnd.sample(range(-(2**45), 2**45, 2**18), 300) + list(range(200))]
    df = spark.createDataFrame([(k, at, v) for k, at, v in rows], "k string, at long, v long")
    for inclusive in (True, False):
        got = {(r.k, r.at): r.out for r in running(df, ["k"], "at", "v", "out", how, inclusive).collect()}
        for k, at, _ in rows:
            seen = [v for a, b, v in rows if a == k and v is not None and (b < at or (inclusive and b == at))]
            assert got[k, at] == ((max if how == "max" else sum)(seen) if seen else None)


def test_gap_edges_and_wildcard(spark):
    df = spark.createDataFrame([("c", p, i) for i, p in enumerate((100, 350, 601, 601))] + [("c", None, 9)], "k string, pos long, id long")
    assert Counter(r.cluster_start for r in gap_clusters(df, ["k"], "pos", 250).collect()) == {100: 2, 601: 2}
    rows = spark.createDataFrame([("c", "L1", 100, 1), ("c", "P", 200, 2), ("c", "L1", 440, 3)], "k string, f string, pos long, id long")
    got = {tuple(r) for r in wildcard_clusters(rows, ["k"], "f", "pos", "id", 250, "P").collect()}
    assert got == {("c", "L1", 0, 1, 100), ("c", "L1", 0, 2, 200), ("c", "P", 0, 2, 200), ("c", "L1", 0, 3, 440)}


@pytest.mark.parametrize("seed", [1, 2])
def test_wildcard_against_a_scan(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(("x", None)), rnd.choice(("P", "A", "B")), rnd.randrange(3000), i) for i in range(300)]
    want = set()
    for key in ("x", None):
        last, no = {}, {}
        for _, f, p, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3])):
            targets = ([g for g in last if g != "P" and p - last[g] <= 40] if f == "P" else []) + [f]
            for g in targets:
                no[g] = 0 if g not in last else no[g] + (p - last[g] > 40)
                last[g] = p
                want.add((key, g, no[g], i, p))
    df = spark.createDataFrame(rows, "k string, f string, pos long, id long").repartition(3)
    assert {tuple(r) for r in wildcard_clusters(df, ["k"], "f", "pos", "id", 40, "P").collect()} == want


def test_overlap_join_against_all_pairs(spark):
    rnd = random.Random(3)

    def spans(n):
        return [(rnd.choice("ab"), s, s + int(2 ** rnd.uniform(0, 33)) - 2, i) for i, s in enumerate(rnd.randrange(2**34) if i % 3 else rnd.randrange(5000) for i in range(n))]

    left, right = spans(150) + [("a", 10, 20, 900), (None, 1, 5, 901), ("a", None, 5, 902)], spans(150) + [("a", 20, 30, 900), ("a", 1, 2**40, 901)]
    l = spark.createDataFrame(left, "lk string, ls long, le long, li int")
    r = spark.createDataFrame(right, "rk string, rs long, re long, ri int")
    got = sorted((x.li, x.ri) for x in overlap_join(l, r, [("lk", "rk")], ("ls", "le"), ("rs", "re")).collect())
    ok = lambda a, b: a[0] == b[0] and None not in a and a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2]
    assert got == sorted((a[3], b[3]) for a in left for b in right if ok(a, b)) and len(LEVELS) == 8
    points = spark.createDataFrame([("a", 20), ("a", 30), ("a", 29)], "pk string, p long")
    assert sorted(x.p for x in point_join(points, r.where("ri = 900"), [("pk", "rk")], "p", ("rs", "re")).where("rs = 20").collect()) == [20, 29]
    flagged = exists_overlap(l.where("li >= 900"), r, "li", [("lk", "rk")], ("ls", "le"), ("rs", "re"))
    assert {x.li: x.hit for x in flagged.collect()} == {900: True, 901: False, 902: False}


def test_fold_restarts_when_disjoint(spark):
    acc = (F.lit(0), F.lit(0))
    for a, b in ((5, 9), (20, 30), (22, 40)):
        acc = fold_overlap((F.lit(a), F.lit(b)), acc)
    assert tuple(spark.range(1).select(*acc).first()) == (22, 40)


def test_coverage(spark):
    df = spark.createDataFrame([("c", 5, 3), ("c", 6, 4), ("c", 6, 0), ("c", None, 4)], "k string, s long, n long")
    assert sorted(map(tuple, coverage(df, ["k"], "s", "n").collect())) == [("c", 5, 1), ("c", 6, 2), ("c", 8, 1), ("c", 10, 0)]


def test_modes(spark):
    votes = [("t", 1, 100)] * 2 + [("t", 1, 105)] * 2 + [("t", -1, 110)] * 3 + [("one", 1, 7)] + [("eq", 1, 50), ("eq", -1, 60)]
    votes += [("tie", s, p) for s, p in ((1, 10), (1, 40), (-1, 60), (-1, 100)) for _ in range(2)]
    df = spark.createDataFrame(votes, "id string, strand int, pos long")
    got = {r.id: (r.pbp, r.nbp, r.p_votes, r.n_votes) for r in strand_modes(df, "id", 50).collect()}
    assert got == {"t": (100, 110, 2, 3), "one": (7, None, 1, None), "eq": (50, 60, 1, 1), "tie": (40, 60, 2, 2)}


def test_ladder_and_score(spark):
    lit = F.lit
    rung = lambda acr, acrr, tsd, ram, oi=1: confidence(lit(acr), lit(acr - acr // 2), lit(acr // 2), lit(acrr), lit(tsd), lit(ram), lit(oi), lit(True))
    cases = [rung(2, 0.4, 50, 6), rung(2, 0.4, 50, 5), rung(2, 0.4, 51, 6), rung(2, 0.39, 50, 6), rung(1, 0.4, 50, 6), rung(2, 0.4, 50, 6, 0)]
    assert tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cases)]).first()) == (5, 4, 3, 2, 1, 0)
    assert spark.range(1).select(insertion_score(lit(25), lit(10), lit(12), lit(5))).first()[0] == 3.0


def one_by_one(clusters):
    """Sequential choice: cluster -> {read: weight}; gives (leader, {equal clusters}) in order."""
    left, out = {c: dict(m) for c, m in clusters.items()}, []
    while any(left.values()):
        key = lambda c: (round(sum(left[c].values()), 10), min(left[c]), -c)
        best = max((c for c in left if left[c]), key=key)
        equal = {c for c in left if set(left[c]) == set(left[best]) and key(c)[0] == key(best)[0]}
        out.append((best, equal))
        for read in list(left[best]):
            for m in left.values():
                m.pop(read, None)
    return out


def frame(spark, clusters, more=()):
    rows = [(c, r, w, "1", "1", 300, 0) for c, m in clusters.items() for r, w in m.items()]
    return spark.createDataFrame(rows + list(more), "c long, r string, w double, a string, b string, size long, mm long")


def test_greedy_choice(spark):
    clusters = {1: {"r1": 1.0, "r2": 1.0, "r3": 1.0}, 2: {"r3": 1.0, "r4": 1.0}, 3: {"r4": 1.0}}
    df = frame(spark, clusters, [(7, "z", 1.0, "1", "2", None, None), (8, None, 1.0, "1", "1", 1, 1)])
    got = {(x.leader, x.rank, x.cluster, x.n_reads) for x in pack_sets(df, "c", "r", "w", "a", "b", "size", "mm").collect()}
    assert got == {(1, 0, 1, 3), (2, 0, 2, 1), (2, 1, 3, 1), (7, 0, 7, 1)}
    assert pack_sets(df.where("false"), "c", "r", "w", "a", "b", "size", "mm").count() == 0


def test_choice_in_rounds_is_that_of_one_by_one(spark):
    rnd = random.Random(4)
    clusters = {c: {f"r{rnd.randrange(40)}" if rnd.random() < 0.8 else "hot": float(rnd.randint(1, 3)) for _ in range(rnd.randint(1, 6))} for c in range(60)}
    got = pack_sets(frame(spark, clusters), "c", "r", "w", "a", "b", "size", "mm").collect()
    groups: dict = {}
    for x in got:
        groups.setdefault((-x.weight, x.leader), set()).add(x.cluster)
    want = one_by_one(clusters)
    assert {leader: own for (_, leader), own in groups.items()} == dict(want)
    order = {leader: i for i, (leader, _) in enumerate(want)}
    weights = [-w for w, leader in sorted(groups, key=lambda g: order[g[1]])]
    assert weights == sorted(weights, reverse=True)


@pytest.mark.parametrize("rounds", [1, 3, 1000])
def test_a_long_chain_has_an_end(spark, monkeypatch, rounds):
    """Each cluster is better than the next, so a round can choose one only; components are chosen from apart."""
    monkeypatch.setattr(set_packing, "ROUNDS", rounds)
    n = 14 if rounds > 100 else 60
    clusters = {c: {f"r{c:03}": 1.0, f"r{c + 1:03}": 1.0 + (n - c) / 100} for c in range(n)} | {500: {"x": 1.0}, 501: {"x": 1.0}}
    got = pack_sets(frame(spark, clusters), "c", "r", "w", "a", "b", "size", "mm").collect()
    groups: dict = {}
    for x in got:
        groups.setdefault(x.leader, set()).add(x.cluster)
    assert groups == dict(one_by_one(clusters))


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(60), f"r{rnd.randrange(70)}") for _ in range(70)] + [(100 + i, f"chain{i // 1}") for i in range(20)] + [(101 + i, f"chain{i}") for i in range(19)] + [(500, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None:
            parent[root(("l", a))] = root(("r", b))
        root(("l", a))
    groups: dict = {}
    for a, _ in links:
        groups.setdefault(root(("l", a)), set()).add(a)
    want = {a: min(g) for g in groups.values() for a in g}
    got = components(spark.createDataFrame(links, "a long, b string"), "a", "b").collect()
    assert {r.a: r.component for r in got} == want


def test_assignment():
    base = ("n", 100, "c", 1, 500, -1, 300, 400, 300.0, 10.0)
    a = Assigner(3.0, 400)
    assert a.add(base) == 0
    assert a.add(base) == -1  # an exact repetition
    assert a.add(("m", 120, "c", 1, 520, -1, 305, 400, 300.0, 10.0)) == 0
    assert a.add(("o", 130, "c", 1, 520, -1, 900, 400, 300.0, 10.0)) == 1  # too different a size
    assert a.add(("p", 140, "c", 1, 5000, -1, 300, 400, 300.0, 10.0)) == 2  # mate too far
    assert a.add(("q", 9000, "c", 1, 9300, -1, 300, 400, 300.0, 10.0)) == 3 and len(a.clusters) == 1


def asked_one_by_one(rows, k, reach):
    """All clusters from the newest to the oldest, all members in order."""
    clusters, made, out = [], 0, []
    for row in rows:
        name, start, mchrom, strand, mstart, mstrand, size, upper, median, sd = row
        target, dropped = None, False
        for own in reversed(clusters):
            stop = False
            for o in own[1]:
                if (o[2], o[3], o[5]) == (mchrom, strand, mstrand):
                    if (o[0], o[1], o[4]) == (name, start, mstart):
                        dropped = stop = True
                        break
                    far = max(o[7], upper)
                    if abs(start - o[1]) <= far and abs(mstart - o[4]) <= far and (strand == mstrand or abs((size - o[6]) - (median - o[8])) <= k * (sd**2 + o[9] ** 2) ** 0.5):
                        target, stop = own, True
                        break
                if abs(start - o[1]) > reach:
                    stop = True
                    break
            if stop:
                break
        if dropped:
            out.append(-1)
            continue
        if target is None:
            target = (made, [])
            made += 1
            clusters.append(target)
        target[1].append(row)
        while all(abs(start - o[1]) > reach for o in clusters[0][1]):
            clusters.pop(0)
        out.append(target[0])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_that_of_asking_all(seed):
    rnd = random.Random(seed)
    start, rows = 0, []
    for _ in range(700):
        start += rnd.choice((0, 0, 1, 15, 60, 400 if seed % 2 else 3))
        rows.append((f"n{rnd.randrange(9)}", start, rnd.choice("cd"), rnd.choice((1, -1)), rnd.choice((start + rnd.randrange(300), rnd.randrange(900))), rnd.choice((1, -1)), rnd.randrange(200, 400), rnd.choice((60, 250, 900)), 300.0, 15.0))
    a = Assigner(3.0, 300)
    assert [a.add(r) for r in rows] == asked_one_by_one(rows, 3.0, 300)


def test_names_and_sequences(spark):
    row = spark.range(1).select(norm_contig(F.lit(" CHR1 ")), norm_contig(F.lit("chrchr2")), norm_name(F.lit(" rg1 ")), norm_source(F.lit(" Help - _Threads ")), q.reverse_complement(F.lit("acgtNx")), q.edge_run(F.lit("CAAA"), "A", True), q.longest_run_above(F.lit("II#III"), 10), q.trim_length(F.lit("IIII##"), 20), q.strip_suffix(F.lit("read1sc")), q.md_matches(F.lit("10A5^AC6")), q.prefix_difference(F.lit("abcd"), F.lit("abxx9"))).first()
    assert tuple(row) == ("1", "chr2", "RG1", "help_threads", "NNACGT", 3, 3, 4, "read1", 21, 2)
    none = spark.range(1).select(norm_contig(F.lit(None).cast("string")), q.reverse_complement(F.lit(None).cast("string")), q.count_n(F.lit(""))).first()
    assert tuple(none) == (None, None, 0)
