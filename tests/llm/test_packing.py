import random

import pytest
from pyspark.sql import functions as F

import strandwise.llm.packing as packing
from strandwise.llm.packing import container_report, match_downward, pack, plan_packing


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    return len(gaps)


@pytest.mark.parametrize("seed,shape", [(1, "mixed"), (2, "small"), (3, "large"), (4, "same")])
def test_plan(spark, monkeypatch, seed, shape):
    monkeypatch.setattr(packing, "SPAN", 8)  # three sweeps a round
    rnd = random.Random(seed)
    capacity = 200
    draw = {"mixed": lambda: rnd.randint(1, 200), "small": lambda: rnd.randint(1, 19), "large": lambda: rnd.randint(90, 200), "same": lambda: 67}[shape]
    sizes = [draw() for _ in range(1500)]
    counts = {s: sizes.count(s) for s in set(sizes)}
    plan, containers = plan_packing(spark.createDataFrame(list(counts.items()), "item long, n long"), capacity)
    used, seen = {}, {}
    for size, rank, count, container in plan.collect():
        for i in range(count):
            used[container + i] = used.get(container + i, 0) + size
            seen.setdefault(size, []).append(rank + i)
    assert {s: sorted(r) for s, r in seen.items()} == {s: list(range(n)) for s, n in counts.items()}
    assert max(used.values()) <= capacity and len(used) == containers
    assert containers <= best_fit_decreasing(sizes, capacity) * 1.01 + 1


def test_sweeps_in_ranges_match_one_sweep(spark, monkeypatch):
    rnd = random.Random(9)
    runs = [(kind, value, i * 1000, rnd.randint(1, 9)) for i, (kind, value) in enumerate({(rnd.randint(0, 1), rnd.randint(1, 300)) for _ in range(250)})]
    want, left = match_downward(iter(sorted(runs, key=lambda r: (-r[1], r[0], r[2]))))
    monkeypatch.setattr(packing, "SPAN", 4)
    df = spark.createDataFrame([(*r, None, None) for r in runs], packing.RUNS)
    got = [tuple(r) for r in packing._round(df, 300).collect()]

    def single(rows):
        return {(size, rank + i, container + i, rest) for size, rank, n, container, rest in rows for i in range(n)}

    assert single((v, f, n, o, r) for k, v, f, n, o, r in got if k == packing.MATCH) == single(want)
    assert sorted(r[:4] for r in got if r[0] != packing.MATCH) == sorted(left)
    assert all(gap >= size for size, _, _, _, gap in ((s, r, n, c, s + rest) for s, r, n, c, rest in want))


def test_every_item_once_and_no_container_over(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice((None, 0, 1, 34, 100, 250, 300, rnd.randint(1, 500)))) for i in range(900)] + [(7, 34), (7, 34)]
    df = spark.createDataFrame(rows, "id long, size int").repartition(5)
    got = pack(df, "id", F.col("size"), 100).collect()
    want = {}
    for i, s in rows:
        want[i] = want.get(i, 0) + max(0, s or 0)
    have, used, pieces = {}, {}, {}
    for r in got:
        have[r.id] = have.get(r.id, 0) + r.n_tokens
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        pieces[r.id] = pieces.get(r.id, 0) + 1
    assert have == want and max(used.values()) <= 100
    once = {i: s or 0 for i, s in rows if i != 7}
    assert all(pieces[i] == max(1, -(-s // 100)) for i, s in once.items())
    again = pack(df.repartition(2), "id", F.col("size"), 100)
    assert sorted(map(tuple, again.where("id != 7").collect())) == sorted(tuple(r) for r in got if r.id != 7)
    report = container_report(again, 100).first()
    assert report.n_tokens == sum(want.values()) and report.fill > 0.97


def test_empty_and_names(spark):
    empty = spark.createDataFrame([], "id long, size long")
    assert pack(empty, "id", F.col("size"), 10).count() == 0
    assert container_report(pack(empty, "id", F.col("size"), 10), 10).first().n_containers == 0
    none = spark.createDataFrame([("a", None)], "item string, size long")
    assert [tuple(r) for r in pack(none, "item", F.col("size"), 10).collect()] == [("a", 0, 0, 0)]


def test_null_ids_clashing_names_and_a_very_large_item(spark):
    df = spark.createDataFrame([(None, 7, 1), (None, 7, 2), (5, 10_000_003, 3)], "item long, part long, along long")
    got = pack(df, "item", F.col("part"), 10).collect()
    assert sum(r.n_tokens for r in got) == 10_000_017 and sum(r.item is None for r in got) == 2
    used = {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) == 10 and len(used) == 1_000_002
