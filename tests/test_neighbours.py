import random

import pytest

from strandwise.operators.neighbours import k_nearest, overlap_counts


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_of_all_distances(spark, seed):
    rnd = random.Random(seed)
    place = lambda: rnd.choice((rnd.randrange(40), rnd.randrange(2**22), rnd.randrange(-(2**40), 2**40)))
    left = [(rnd.choice(("a", "b", None)), rnd.choice((place(), place(), None)), i) for i in range(80)]
    right = [(rnd.choice(("a", "a", "c", None)), rnd.choice((place(), place(), None)), i) for i in range(90)] + [("a", 7, 200 + i) for i in range(20)]
    got = k_nearest(spark.createDataFrame(left, "k string, p long, no int"), spark.createDataFrame(right, "k string, p long, id int"), ["k"], "p", "id", 3)
    for r in got.collect():
        want = sorted((abs(p - r.p), i, p) for k, p, i in right if k == r.k and None not in (k, p, r.p)) if r.p is not None else []
        assert [tuple(x) for x in r.near] == want[:3], r
    assert got.count() == len(left)


def test_overlaps_are_counted_without_pairs(spark):
    rnd = random.Random(3)
    span = lambda: (s := rnd.randrange(2**21), s + rnd.choice((0, 5, 3000, 2**21, -4)))
    spans = [(rnd.choice(("a", "b", None)), *span(), i) for i in range(60)] + [("a", None, 4, 99)]
    intervals = [(rnd.choice(("a", "a", None)), *span()) for _ in range(120)] * 2
    got = overlap_counts(spark.createDataFrame(spans, "k string, a long, b long, no int"), spark.createDataFrame(intervals, "k string, s long, e long"), ["k"], ("a", "b"), ("s", "e"))
    assert {r.no: r.n for r in got.collect()} == {i: sum(k is not None and a is not None and j == k and a <= b and s <= e and s <= b and a <= e for j, s, e in intervals) for k, a, b, i in spans}
