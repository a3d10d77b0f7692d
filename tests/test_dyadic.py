import random

import pyarrow as pa
import pytest

from strandwise.operators.dyadic import continuous_periods, period_gaps


def brute(rows):
    """rows: (key, start, end) -> periods and gaps."""
    by = {}
    for key, s, e in rows:
        if s is not None and e is not None:
            by.setdefault(key, []).append((min(s, e), max(s, e)))
    periods, gaps = set(), set()
    for key, spans in by.items():
        spans.sort()
        at = list(spans[0])
        for s, e in spans[1:]:
            if s <= at[1] + 1:
                at[1] = max(at[1], e)
            else:
                periods.add((key, *at))
                gaps.add((key, at[1] + 1, s - 1))
                at = [s, e]
        periods.add((key, *at))
    return periods, gaps


def both(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"name string, s {kind}, e {kind}")
    got = [tuple(r) for r in continuous_periods(df, ["name"], "s", "e").collect()], [tuple(r) for r in period_gaps(df, ["name"], "s", "e").collect()]
    assert len(set(got[0])) == len(got[0]) and len(set(got[1])) == len(got[1])
    return set(got[0]), set(got[1])


@pytest.mark.parametrize("seed,span,size", [(1, 400, 30), (2, 10**7, 3 * 10**6), (3, 2**45, 2**43), (4, 2**62, 2**61)])
def test_matches_a_sweep(spark, seed, span, size):
    rnd = random.Random(seed)
    rows = []
    for _ in range(400):
        s = rnd.randint(-span, span)
        e = s + int(size * rnd.random() ** 4) * rnd.choice((1, 1, 1, -1))
        rows.append((rnd.choice(("A", "A", "A", "B", "C", None)), s, e))
    rows += rows[:50] + [("A", None, 3), ("A", 3, None), (None, None, None), ("D", 5, 5)]
    assert both(spark, rows) == brute(rows)


def test_edges(spark):
    top, low = 2**63 - 1, -(2**63)
    rows = [("touch", 1, 4), ("touch", 5, 9), ("gap1", 1, 4), ("gap1", 6, 9), ("all", low, top), ("ends", low, low), ("ends", top, top), ("minus", -1, -1), ("minus", 0, 0), ("cell", 2**20 - 1, 2**20 - 1), ("cell", 2**20, 2**20), ("nest", 1, 2**41), ("nest", 7, 9), ("nest", 2**41 + 2, 2**41 + 3)]
    assert both(spark, rows) == brute(rows)


def test_many_in_one_cell(spark):
    rnd = random.Random(9)
    rows = [("hot", s, s + rnd.randint(0, 3)) for s in (rnd.randrange(60_000) for _ in range(6000))]
    assert both(spark, rows) == brute(rows)


def test_empty_other_columns_and_kinds(spark):
    empty = spark.createDataFrame([], "name string, s long, e long")
    assert period_gaps(empty, ["name"], "s", "e").count() == continuous_periods(empty, ["name"], "s", "e").count() == 0
    clash = spark.createDataFrame([(1, "x", 2, 3, "c"), (1, "y", 9, 9, "c")], "cell int, codes string, lo int, hi int, k0 string")
    assert [tuple(r) for r in period_gaps(clash, ["cell", "k0"], "lo", "hi").collect()] == [(1, "c", 4, 8)]
    day = spark.sql("select 1 k, date'2024-01-01' a, date'2024-01-03' b union all select 1, date'2024-01-06', date'2024-01-07'")
    assert [str(r.gap_start) + str(r.gap_end) for r in period_gaps(day, ["k"], "a", "b").collect()] == ["2024-01-042024-01-05"]
    with pytest.raises(TypeError):
        period_gaps(spark.sql("select 1 k, 1.5D a, 2D b"), ["k"], "a", "b")


def test_arrow_version_has_what_is_used():
    assert hasattr(pa.RecordBatch, "cast")
