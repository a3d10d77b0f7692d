import heapq
import random
from fractions import Fraction

from pyspark.sql import functions as F

import strandwise.llm.mixing as mixing
import strandwise.llm.token_sizes as token_sizes
from strandwise.llm.mixing import mix, sainte_lague, shard_quotas


def one_by_one(weights, caps, seats):
    got = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def test_apportionment_is_that_of_one_seat_at_a_time():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 8)
        weights = [Fraction(rnd.choice((0, 1, 2, 3, 5, rnd.randint(1, 1000)))) for _ in range(n)]
        caps = [rnd.choice((0, 3, 50, 10**6)) for _ in range(n)]
        seats = rnd.choice((0, 1, 7, 400, 3000))
        assert sainte_lague(weights, caps, seats) == one_by_one(weights, caps, seats)


def test_shards_get_what_one_seat_at_a_time_gives(spark, monkeypatch):
    """Also where a shard is far larger than the others, caps bind, and shards are shared out in several steps."""
    rnd = random.Random(7)
    rows, want = [], {}
    for name, sizes, repeats, part in (("even", [rnd.randint(90, 110) for _ in range(40)], 9, 2.5), ("giant", [5] * 60 + [9000], 9, 1.7), ("full", [rnd.randint(1, 50) for _ in range(33)], 2, 2.0)):
        blocks = min(int(sum(sizes) * part / 8), sum(sizes) * repeats // 8)
        rows += [(name, i, blocks, repeats, sum(sizes), n) for i, n in enumerate(sizes)]
        want[name] = blocks, sizes, repeats
    held = spark.createDataFrame(rows, "source string, shard long, blocks long, max_repeats long, available long, held long")
    flat = {(r.source, r.shard): r.quota for r in shard_quotas(held, 8, 61).collect()}
    for name, (blocks, sizes, repeats) in want.items():
        caps = [-(-n * repeats // 8) for n in sizes]
        seats = one_by_one([Fraction(n) for n in sizes], caps, blocks)
        assert [flat[name, i] for i in range(len(sizes))] == [min(s * 8, n * repeats) for s, n in zip(seats, sizes, strict=True)], name
    monkeypatch.setattr(mixing, "FANOUT_BITS", 2)
    steps = shard_quotas(held, 8, 61).collect()
    for name, (blocks, sizes, repeats) in want.items():
        own = {r.shard: r.quota for r in steps if r.source == name}
        assert len(own) == len(sizes) and all(own[i] <= n * repeats for i, n in enumerate(sizes))
        assert blocks * 8 - 8 * len(sizes) <= sum(own.values()) <= blocks * 8


def test_shares_repeats_and_report(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SIZE", 5_000)
    rnd = random.Random(2)
    rows = [(i, rnd.choice(("a", "a", "a", "b", "tiny", "other", None)) if i > 5 else "tiny", rnd.choice((None, 0, 5, 30, 120))) for i in range(3000)]
    rows = [(i, s if s != "tiny" or i < 60 else "a", n) for i, s, n in rows]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("tiny", 0.1, 2), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, "doc long, source string, n int")
    mixture, report = mix(df, "doc", F.col("source"), F.col("n"), targets, block=64, seed=3)
    got = [tuple(r) for r in mixture.collect()]
    most = {"a": 1, "b": 4, "tiny": 2}
    by = {i: (s, n) for i, s, n in rows}
    assert len({r[0] for r in got}) == len(got) and all(by[d] == (s, n) and 1 <= k <= most[s] for d, s, n, k in got)
    available = {s: sum(n or 0 for _, x, n in rows if x == s) for s in ("a", "b", "tiny", "absent")}
    total = sum(available.values())
    have = {s: sum(n * k for _, x, n, k in got if x == s) for s in available}
    lines = {r.source: r for r in report.collect()}
    for s, line in lines.items():
        assert (line.available_tokens, line.actual_tokens) == (available[s], have[s])
        assert line.is_short == (available[s] * line.max_repeats < line.target_share * total)
        assert abs(line.actual_share - have[s] / sum(have.values())) < 1e-12
        assert abs(have[s] - line.quota_tokens) <= 120 * (available[s] // 5_000 + 1) + 64 * 8
    assert lines["tiny"].is_short and lines["absent"].is_short and have["tiny"] == 2 * available["tiny"]
    assert sorted(got) == sorted(map(tuple, mix(df.repartition(3), "doc", F.col("source"), F.col("n"), targets, block=64, seed=3)[0].collect()))
    assert sorted(got) != sorted(map(tuple, mix(df, "doc", F.col("source"), F.col("n"), targets, block=64, seed=4)[0].collect()))


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    none = spark.createDataFrame([], "blocks long, source string, n int")
    mixture, report = mix(none, "blocks", F.col("source"), F.col("n"), targets)
    assert mixture.count() == 0 and [(r.source, r.actual_tokens, r.actual_share, r.is_short) for r in report.collect()] == [("a", 0, None, False)]
    no_targets = mix(none, "blocks", F.col("source"), F.col("n"), targets.where("false"))
    assert no_targets[0].count() == no_targets[1].count() == 0


def test_null_ids_and_hot_source(spark):
    rows = [(None, "a", 10)] * 3 + [(i, "a", 10) for i in range(300)] + [(i, "b", 1_000_000) for i in range(1)]
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    mixture, report = mix(spark.createDataFrame(rows, "source_id long, source string, n int"), "source_id", F.col("source"), F.col("n"), targets, block=8)
    got = mixture.collect()
    assert all(1 <= r.repeats <= 3 for r in got) and sum(r.source_id is None for r in got) == 3
    assert {r.source: r.is_short for r in report.collect()} == {"a": True, "b": False}


def test_found_sources_come_from_the_mixture(spark, monkeypatch):
    """The plan ranks records in shards, and a source is found whatever its rounding."""
    docs = spark.createDataFrame([(i, "a", "x" * 900) for i in range(40)] + [(100 + i, "b", "y" * 100) for i in range(3)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(token_sizes, "table", lambda spark, folder, name: {"documents": docs, "mix_targets": targets}[name])
    found = token_sizes.p7_found(spark, "")
    assert [r.source for r in found.collect()] == ["b"]
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString()
