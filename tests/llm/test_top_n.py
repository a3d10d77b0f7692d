import random

import pytest

from strandwise.llm.top_n import distinct_by_digest, distinct_items, top_n


def rows_of(seed, n=600):
    rnd = random.Random(seed)
    pick = lambda *a: rnd.choice(a)
    return [(pick("hot", "hot", "hot", f"r{rnd.randrange(120)}", None), pick(None, 0, 1, 2), pick(None, 50, 60), i) for i in range(n)]


def brute(rows, n, only_larger):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = set()
    for own in by.values():
        if only_larger and len(own) <= n:
            continue
        own.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] is None, -(r[2] or 0), r[3]))
        out |= {(*r, i + 1) for i, r in enumerate(own[:n])}
    return out


@pytest.mark.parametrize("only_larger", [False, True])
def test_matches_sorting(spark, only_larger):
    rows = rows_of(4)
    df = spark.createDataFrame(rows, "name string, nm int, len int, id int").repartition(7)
    got = top_n(df, ["name"], [("nm", "asc"), ("len", "desc"), ("id", "asc")], 3, only_larger=only_larger)
    assert {tuple(r) for r in got.collect()} == brute(rows, 3, only_larger)


def test_the_group_limit_is_on_both_sides(spark):
    df = spark.createDataFrame(rows_of(5), "name string, nm int, len int, id int")
    plan = top_n(df, ["name"], [("nm", "asc"), ("id", "asc")], 3, only_larger=True)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "Final" in plan and plan.count("WindowGroupLimit") >= 2


def test_copies_empty_and_names(spark):
    df = spark.createDataFrame([("a", None, 9), ("a", None, 4), ("a", 1, 5)], "name string, x int, id int")
    assert {tuple(r) for r in distinct_items(df, ["name", "x"], "id").collect()} == {("a", None, 4), ("a", 1, 5)}
    assert top_n(df.where("id < 0"), ["name"], [("id", "asc")], 2).count() == 0
    clash = df.withColumnRenamed("x", "group_size")
    assert top_n(clash, ["name"], [("id", "asc")], 2, only_larger=True).columns == ["name", "group_size", "id", "rank_no"]
    with pytest.raises(ValueError):
        top_n(df.withColumnRenamed("x", "RANK_NO"), ["name"], [("id", "asc")], 2)


def test_copies_by_digest_are_copies(spark):
    """Nulls are values of their own, wherever they stand; ties and repeated rows fold; names may clash."""
    rnd = random.Random(8)
    rows = [(rnd.choice(("a", "b", None)), rnd.choice((1, None)), rnd.choice((5, None)), rnd.choice((5, None)), rnd.choice(("x", "", None)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, nm long, digest_1 long, u long, v string, id long").repartition(5)
    want = {(r.name, r.nm, r.id) for r in distinct_items(df, ["name", "nm", "digest_1", "u", "v"], "id").collect()}
    got = [tuple(r) for r in distinct_by_digest(df, ["name", "nm"], ["digest_1", "u", "v"], "id").collect()]
    assert set(got) == want and len(got) == len(want)
    assert {tuple(r) for r in distinct_by_digest(df, ["name"], [], "id").collect()} == {(n, min(r[5] for r in rows if r[0] == n)) for n in ("a", "b", None)}
    assert distinct_by_digest(df.where("id < 0"), ["name"], ["u"], "id").count() == 0
