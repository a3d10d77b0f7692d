"""Percentiles of very large columns: mergeable digests with a guaranteed rank error.

A value is quantized to an ordered universe of `2**18` codes: exact below 4,096,
and to twelve significant bits above, with the sign. Over that universe stands
a binary tree. A digest of a group is a set of tree nodes with counts, where a
count says how many values lie somewhere below the node. Small nodes are pushed
up: a pair of siblings and their parent become the parent while together they
hold at most `n / k` of the `n` values, `k = 18 / error`.

* *Build*: in each task, over chunks of rows; a hot group sends a bounded
  number of nodes a chunk, not its rows.
* *Merge*: node counts are added (a sum by group and node, with map-side
  combining), then compressed anew. Digests of days or partitions combine into
  that of the whole in any order.
* *Read*: a node counts for a rank surely once its right end is passed and
  possibly once its left end is reached, so each percentile has a lower and an
  upper bound that hold without any assumption on the data; between them lie
  at most `error * n` ranks and one quantization step.

A group never has more than `2**19` nodes, which bounds every merge.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.arrowgroups import group_ids, run_starts

MANTISSA = 12
HALF = 17
BITS = HALF + 1
ERROR = 0.005
CHUNK_ROWS = 400_000
#: No value, used where a whole batch has none.
TOP = np.int64(np.iinfo(np.int64).max)


def _bit_length(values: np.ndarray) -> np.ndarray:
    high = values >> 32
    low = np.where(high > 0, high, values & 0xFFFFFFFF)
    return np.frexp(low.astype(np.float64))[1] + np.where(high > 0, 32, 0)


def quantize(values: np.ndarray) -> np.ndarray:
    """Codes in [0, 2**18), in the order of the values."""
    size = np.where(values < 0, -(values + 1), values)  # -1 -> 0, so that the least long has a size too
    shift = np.maximum(_bit_length(size) - MANTISSA, 0)
    code = (shift.astype(np.int64) << (MANTISSA - 1)) + (size >> shift)
    return np.where(values < 0, (1 << HALF) - 1 - code, (1 << HALF) + code)


def code_bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of each code."""
    negative = code < (1 << HALF)
    own = np.where(negative, (1 << HALF) - 1 - code, code - (1 << HALF)).astype(np.int64)
    shift = np.maximum((own >> (MANTISSA - 1)) - 1, 0)
    mantissa = own - (shift << (MANTISSA - 1))
    fits = shift <= 63 - MANTISSA
    shift = np.where(fits, shift, 0)
    low = np.where(fits, mantissa << shift, TOP)
    high = np.where(fits, low + ((np.int64(1) << shift) - 1), TOP)
    return np.where(negative, -high - 1, low), np.where(negative, -low - 1, high)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds equal nodes of a group and pushes small ones up; sorted by group and node."""
    if len(node) == 0:
        return group, node, count
    key, at = np.unique((group.astype(np.int64) << (BITS + 1)) | node, return_inverse=True)
    count = _sums(at, count, len(key))
    group, node = key >> (BITS + 1), key & ((1 << (BITS + 1)) - 1)
    total = _sums(group, count, int(group.max()) + 1)
    most = (total / (BITS / error)).astype(np.int64)
    if not most.any():
        return group, node, count
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = np.frexp(node.astype(np.float64))[1] - 1
    g, v, c = (x[depth == BITS] for x in (group, node, count))
    for level in range(BITS, 0, -1):
        above = depth == level - 1
        pg, pv, pc = group[above], node[above], count[above]
        parent = (g << (BITS + 1)) | (v >> 1)
        parents, of = np.unique(parent, return_inverse=True)
        pair = _sums(of, c, len(parents))
        own_key = (pg << (BITS + 1)) | pv
        place = np.searchsorted(own_key, parents)
        there = np.zeros(len(parents), bool)
        inside = place < len(own_key)
        there[inside] = own_key[place[inside]] == parents[inside]
        own = np.zeros(len(parents), np.int64)
        own[there] = pc[place[there]]
        up = pair + own <= most[parents >> (BITS + 1)]
        stay = ~up[of]
        kept.append((g[stay], v[stay], c[stay]))
        merged = np.concatenate([own_key, parents[up]])
        keys, back = np.unique(merged, return_inverse=True)
        c = _sums(back, np.concatenate([pc, pair[up]]), len(keys))
        g, v = keys >> (BITS + 1), keys & ((1 << (BITS + 1)) - 1)
    kept.append((g, v, c))
    group, node, count = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((node, group))
    return group[order], node[order], count[order]


def _sums(at: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, count)
    return out


def _build(n_keys: int, error: float):
    def rows(table: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(table).combine_chunks().to_batches()[0]
        *keys, values = whole.columns
        group, first = group_ids(keys) if keys else (np.zeros(whole.num_rows, np.int64), np.zeros(1, np.int64))
        node = quantize(values.to_numpy(zero_copy_only=False)) + (1 << BITS)
        group, node, count = compress(group, node, np.ones(len(node), np.int64), error)
        take = pa.array(first[group])
        return pa.RecordBatch.from_arrays([k.take(take) for k in keys] + [pa.array(node.astype(np.int32)), pa.array(count)], [*whole.schema.names[:n_keys], "node", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    return of


def _whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups, from a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 50_000:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        last = int(run_starts(whole.columns[:n_keys])[-1]) if n_keys else 0
        if last:
            yield whole.slice(0, last)
        held = [whole.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _groups(batch: pa.RecordBatch, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    starts = run_starts(batch.columns[:n_keys]) if n_keys else np.zeros(1, np.int64)
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows))), starts


def _compressor(n_keys: int, error: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, n_keys):
            group, starts = _groups(batch, n_keys)
            group, node, count = compress(group, batch.column(n_keys).to_numpy().astype(np.int64), batch.column(n_keys + 1).to_numpy(), error)
            take = pa.array(starts[group])
            yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(n_keys)] + [pa.array(node.astype(np.int32)), pa.array(count)], batch.schema.names)

    return of


def _reader(n_keys: int, percents: Sequence[int]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, n_keys):
            group, starts = _groups(batch, n_keys)
            node = batch.column(n_keys).to_numpy().astype(np.int64)
            count = batch.column(n_keys + 1).to_numpy()
            depth = np.frexp(node.astype(np.float64))[1] - 1
            left = (node - (np.int64(1) << depth)) << (BITS - depth)
            right = left + (np.int64(1) << (BITS - depth)) - 1
            n = _sums(group, count, len(starts))
            begin = np.cumsum(n) - n
            ends = {}
            for name, end in (("lower", left), ("upper", right)):
                order = np.lexsort((end, group))
                ends[name] = end[order], np.cumsum(count[order])
            rows = []
            for q in percents:
                rank = np.maximum(1, (n * q + 99) // 100) + begin
                low, high = (e[np.searchsorted(total, rank)] for e, total in (ends["lower"], ends["upper"]))
                rows.append((np.arange(len(starts)), np.full(len(starts), q, np.int32), n, code_bounds(low)[0], code_bounds(high)[1]))
            at, q, n, low, high = (np.concatenate(x) for x in zip(*rows, strict=True))
            take = pa.array(starts[at])
            yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(n_keys)] + [pa.array(x) for x in (q, n, low, high)], [*batch.schema.names[:n_keys], "q", "n", "lower", "upper"])

    return of


def _kinds(df: DataFrame, k: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(x, df.schema[x].dataType) for x in k]


def _renamed(df: DataFrame, keys: Sequence[str], *more: Column) -> tuple[DataFrame, list[str]]:
    k = [f"k{i}" for i in range(len(keys))]
    return df.select(*[F.col(f"`{x}`").alias(y) for x, y in zip(keys, k, strict=True)], *more), k


def build_digest(df: DataFrame, keys: Sequence[str], value: Column, error: float = ERROR) -> DataFrame:
    """The digest of each group: `keys`, `node`, `n`; a table to keep, with one row a tree node.

    `value` must be a whole number; null values are left out, null keys are one
    key, repeated rows count each time, other columns are ignored. No values:
    no rows.
    """
    base, k = _renamed(df, keys, value.cast("long").alias("value"))
    base = base.where("value is not null")
    nodes = T.StructType([*_kinds(base, k), T.StructField("node", T.IntegerType()), T.StructField("n", T.LongType())])
    parts = base.mapInArrow(_build(len(k), error), nodes)
    return merge_digests(parts.toDF(*keys, "node", "n"), keys=keys, error=error)


def merge_digests(*digests: DataFrame, keys: Sequence[str], error: float = ERROR) -> DataFrame:
    """One digest a group out of any number of digests with at least the columns `keys`, `node`, `n`; other columns, such as the day, are merged over."""
    added = None
    for digest in digests:
        part, k = _renamed(digest, keys, F.col("node"), F.col("n"))
        added = part if added is None else added.unionByName(part)
    added = added.groupBy(*k, "node").agg(F.sum("n").alias("n"))
    nodes = T.StructType([*_kinds(added, k), T.StructField("node", T.IntegerType()), T.StructField("n", T.LongType())])
    grouped = added.repartition(*k) if k else added.coalesce(1)
    return grouped.sortWithinPartitions(*k, "node").mapInArrow(_compressor(len(k), error), nodes).toDF(*keys, "node", "n")


def digest_percentiles(digest: DataFrame, keys: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """`keys`, `q`, `n`, `lower`, `upper`: the q-th percentile, the smallest value that at least q % do not exceed, lies in [lower, upper]."""
    base, k = _renamed(digest, keys, F.col("node"), F.col("n"))
    rows = T.StructType([*_kinds(base, k), T.StructField("q", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in ("n", "lower", "upper")]])
    grouped = base.repartition(*k) if k else base.coalesce(1)
    return grouped.sortWithinPartitions(*k, "node").mapInArrow(_reader(len(k), percents), rows).toDF(*keys, "q", "n", "lower", "upper")
