import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm.quantile_digest import BITS, build_digest, code_bounds, compress, digest_percentiles, merge_digests, quantize


def test_codes_keep_the_order_and_bound_their_values():
    rnd = random.Random(1)
    values = sorted({rnd.randint(-(2**b), 2**b) for b in range(63) for _ in range(40)} | {-(2**63), 2**63 - 1, 0, -1, 1, 4095, 4096, -4096, -4097})
    v = np.array(values, np.int64)
    code = quantize(v)
    low, high = code_bounds(code)
    assert (np.diff(code) >= 0).all() and code.min() >= 0 and code.max() < 2**BITS
    assert (low <= v).all() and (v <= high).all()
    small = np.abs(v.astype(float)) < 4000
    assert (low[small] == v[small]).all() and (high[small] == v[small]).all()
    assert all(int(h) - int(l) <= max(1, abs(int(x))) / 2**11 for l, h, x in zip(low, high, v, strict=True))


@pytest.mark.parametrize("error", [0.01, 0.2])
def test_compressing_keeps_counts_and_is_small(error):
    rng = np.random.default_rng(2)
    values = (rng.lognormal(8, 3, 60_000)).astype(np.int64)
    group = rng.integers(0, 3, len(values))
    g, node, n = compress(group, quantize(values) + 2**BITS, np.ones(len(values), np.int64), error)
    assert [n[g == i].sum() for i in range(3)] == [(group == i).sum() for i in range(3)]
    assert len(node) <= 3 * 3 * BITS / error + 3


def true_rank_bounds(values, q, n):
    return values[max(1, math.ceil(q * n / 100)) - 1]


@pytest.mark.parametrize("error", [0.005, 0.05])
def test_bounds_hold_and_loads_combine(spark, error):
    rnd = random.Random(3)
    rows = []
    for i in range(20_000):
        key = rnd.choice(("hot", "hot", "b", None))
        rows.append((key, i % 3, None if rnd.random() < 0.05 else int(rnd.choice((1, -1, 1)) * rnd.lognormvariate(6, 2))))
    rows += [("one", 0, 2**63 - 1), ("none", 0, None), ("ties", 0, 7), ("ties", 0, 7)]
    df = spark.createDataFrame(rows, "key string, day int, value long").repartition(5)
    percents = (1, 50, 95, 100)
    whole = digest_percentiles(build_digest(df, ["key"], F.col("value"), error), ["key"], percents)
    days = [build_digest(df.where(f"day = {d}"), ["key"], F.col("value"), error) for d in range(3)]
    merged = digest_percentiles(merge_digests(*days, keys=["key"], error=error), ["key"], percents)
    by = {}
    for key, _, value in rows:
        if value is not None:
            by.setdefault(key, []).append(value)
    for got in (whole.collect(), merged.collect()):
        assert {r.key for r in got} == set(by) and len(got) == len(by) * len(percents)
        for r in got:
            values = np.sort(np.array(by[r.key], np.int64))
            n = len(values)
            rank = max(1, math.ceil(r.q * n / 100))
            assert r.n == n and r.lower <= values[rank - 1] <= r.upper
            # ranks that the bounds leave open: at most the error each way, beside the values of the same code as the bounds
            code = quantize(values)
            low, high = quantize(np.array([r.lower, r.upper], np.int64))
            inside = ((code > low) & (code < high)).sum()
            assert inside <= 2 * error * n


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 6, 1)], "upper string, q long, k0 int")
    got = digest_percentiles(build_digest(df.withColumnRenamed("upper", "name"), ["name"], F.col("q")), ["name"], (50,)).collect()
    assert [tuple(r) for r in got] == [("a", 50, 2, 5, 5)]
    none = spark.createDataFrame([], "name string, v long")
    assert digest_percentiles(build_digest(none, ["name"], F.col("v")), ["name"], (50,)).count() == 0
