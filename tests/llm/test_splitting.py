import random

import pytest

import strandwise.llm.splitting as splitting
from strandwise.llm.splitting import cut_oversized, merge_segments, split_items


def verify(items, records, pieces, limit, overlap):
    """Everything the docstring promises, from scratch."""
    by = {}
    for key, start, end, cut in pieces:
        by.setdefault(key, []).append((start, end, cut))
    for key, lo, hi in items:
        own = sorted(by.pop(key, []))
        if lo is None or hi is None or hi <= lo:
            assert not own
            continue
        starts, labels = sorted({a for k, a, _ in records if k == key and a is not None and lo <= a < hi} | {lo}), {}
        for k, a, label in records:
            if k == key and a is not None and label is not None and (a not in labels or label < labels[a]):
                labels[a] = label
        assert own[0][0] == lo and own[-1][1] == hi and own[0][2] == "start"
        for start, end, _ in own:
            assert 0 < end - start <= limit
        for (_, end, _), (start, _, cut) in zip(own, own[1:], strict=False):
            near = [a for a in starts if end - overlap <= a <= end]
            assert start == (near[0] if near else end)
            if end in starts:
                at = starts.index(end)
                assert cut == ("same" if labels.get(end) == labels.get(starts[at - 1]) else "change")
            else:
                assert cut == "inside"
                assert any(b - a + overlap > limit for a, b in zip(starts, [*starts[1:], hi], strict=True) if a < end < b)
            if cut == "same":  # the run of the label, with its overlap, did not fit one piece
                at = starts.index(end)
                a = b = at
                while a > 0 and labels.get(starts[a - 1]) == labels.get(starts[at]):
                    a -= 1
                while b + 1 < len(starts) and labels.get(starts[b + 1]) == labels.get(starts[at]):
                    b += 1
                stop = starts[b + 1] if b + 1 < len(starts) else hi
                reach = min([x for x in starts if starts[a] - overlap <= x <= starts[a]])
                assert stop - (reach if a else starts[a]) > limit, (key, end)
    assert not by


def run(spark, items, records, limit, overlap):
    i = spark.createDataFrame(items, "name string, a long, b long")
    r = spark.createDataFrame(records, "name string, at long, who string").repartition(3)
    got = [tuple(x) for x in split_items(i, r, ["name"], "a", "b", "at", "who", limit, overlap).collect()]
    verify(items, records, got, limit, overlap)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_promises_hold(spark, monkeypatch, seed):
    monkeypatch.setattr(splitting, "CHUNK_BITS", 11)  # chunks of 2,048 positions, so that items have many
    rnd = random.Random(seed)
    items, records = [], []
    for n in range(12):
        key, lo = (f"f{n}" if n else None), rnd.randrange(50)
        at, who = lo, 0
        for _ in range(rnd.choice((3, 30, 400))):
            records.append((key, at, rnd.choice((None, f"r{who}", f"r{who}", f"r{who}"))))
            if rnd.random() < 0.4:
                who += 1
            at += rnd.choice((1, 5, 20, 60, 60, 700 if n % 3 else 20))
        items.append((key, lo, at + rnd.randrange(30)))
    records += records[:40] + [("f1", None, "x"), ("f1", 10**9, "x"), ("other", 5, "x"), ("f2", -5, "x")]
    items += [("bare", 0, 5000), ("none", 3, 3), ("null", None, 9), ("short", 5, 6)]
    got = run(spark, items, records, 300, 40)
    assert len(got) > 60 and {c for *_, c in got} == {"start", "change", "same", "inside"}


def test_weakest_boundaries_go_first():
    # a a | b b | c: the same-label boundaries merge, then the smallest pair that fits
    assert merge_segments([0, 10, 20, 30, 40], [0] * 5, [-1, 1, 2, 1, 2], 45, 25) == [0, 2]
    assert merge_segments([0, 10, 20, 30, 40], [0] * 5, [-1, 1, 2, 1, 2], 45, 20) == [0, 2, 4]
    assert merge_segments([0, 10], [0, 5], [-1, 2], 20, 20) == [0]
    assert merge_segments([7], [0], [-1], 20, 20) == [0]
    assert cut_oversized([0, 50], [0, 5], [-1, 2], 130, 40) == ([0, 40, 50, 85, 125], [0, 0, 5, 0, 0], [-1, 0, 2, 0, 0])


def test_empty_and_arguments(spark):
    assert run(spark, [], [], 300, 40) == []
    assert run(spark, [("a", 0, 299)], [], 300, 40) == [("a", 0, 299, "start")]
    one = spark.createDataFrame([(1, 0, 700)], "chunk int, at long, label long")
    recs = spark.createDataFrame([(1, 300, 5)], "chunk int, at long, label long")
    assert split_items(one, recs, ["chunk"], "at", "label", "at", "label", 300, 0).count() == 3
    with pytest.raises(ValueError):
        split_items(one, recs, ["chunk"], "at", "label", "at", "label", 300, 150)
