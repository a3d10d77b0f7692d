import math
import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators.hotkeys import heavy_keys, key_profile


def brute(rows, percents):
    by = {}
    for key, item, value in rows:
        by.setdefault(key, []).append((item, value))
    out = {}
    for key, own in by.items():
        values = sorted(v for _, v in own if v is not None)
        pick = [values[max(1, math.ceil(q * len(values) / 100)) - 1] if values else None for q in percents]
        out[key] = (len(own), len({i for i, _ in own if i is not None}), len(values), sum(values) if values else None, min(values, default=None), max(values, default=None), *pick)
    return out


@pytest.mark.parametrize("seed,width,step", [(1, 50, 12), (2, 10**6, 4), (3, 2**62, 16), (4, 2**40, 12)])
def test_matches_sorting(spark, seed, width, step):
    rnd = random.Random(seed)
    rows = []
    for _ in range(900):
        key = "hot" if rnd.random() < 0.5 else rnd.choice(("a", "b", None, "c"))
        rows.append((key, rnd.choice((None, "x", "y", str(rnd.randrange(40)))), None if rnd.random() < 0.1 else rnd.randint(-width, width)))
    rows += [("none", "i", None), ("one", None, 2**63 - 1 if width > 2**60 else 7)]
    percents = (1, 50, 95, 100)
    df = spark.createDataFrame(rows, "key string, item string, value long")
    got = {r[0]: tuple(r[1:]) for r in key_profile(df, ["key"], F.col("value"), F.col("item"), percents, step).collect()}
    assert {k: tuple(int(x) if x is not None else None for x in v) for k, v in got.items()} == brute(rows, percents)


def test_empty_ties_and_names(spark):
    empty = spark.createDataFrame([], "n long, bucket string, value long")
    assert key_profile(empty, ["bucket"], F.col("value"), F.col("n")).count() == 0
    same = spark.createDataFrame([(1, "k", 5)] * 30, "n long, bucket string, value long")
    assert tuple(key_profile(same, ["bucket"], F.col("value"), F.col("n")).first()) == ("k", 30, 1, 30, 150, 5, 5, 5, 5)


def test_heavy(spark):
    rows = [("t", "a", 1)] * 6 + [("t", f"x{i}", 1) for i in range(94)] + [("u", None, 1)] * 19 + [("u", "b", 1)] + [("u", "c", 1)] * 2
    profile = key_profile(spark.createDataFrame(rows, "t string, k string, v long"), ["t", "k"], F.col("v"), F.col("v"))
    assert {tuple(r)[:2] for r in heavy_keys(profile, ["t"], 0.05).collect()} == {("t", "a"), ("u", None), ("u", "c")}
