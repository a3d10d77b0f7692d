"""Continuous periods and gaps of overlapping intervals, by canonical dyadic blocks.

The number line is a binary tree: a block of level `l` covers `2**l` positions
and starts at a multiple of that. Every closed interval of integers is a
disjoint union of at most two blocks a level, its canonical blocks.

1. *Decompose*: intervals become canonical blocks, on the map side.
2. *Drop covered, merge siblings*: within a cell of `2**20` positions (and, for
   the blocks of level 20 to 39, within a cell of `2**40`, and so on) blocks
   below another block go, and two siblings become their parent, level by
   level. Inside a cell a block is one number of a binary heap, so a cell never
   holds more than `2**21` of them however many intervals fall into it: this
   bounds every group, also of an entity that owns a third of all rows.
   The step runs in each input batch, then over salted cells, then over cells,
   so that copies and nested intervals are gone before rows are shuffled.
3. *Coalesce*: adjacent blocks of a cell become runs. Runs of neighbouring
   cells are joined by carrying the furthest end from cell to cell, over one
   row a cell, never by one window over a whole entity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.arrowgroups import group_ids, run_starts
from strandwise.operators.carry import CELL_BITS, null_safe_join

#: Blocks a row, so that Arrow batches stay small.
CHUNK = 1024
SALTS = 16


def decompose(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical blocks of the closed intervals [lo, hi]: row number, level and index (start >> level)."""
    rows, levels, indices = [], [], []
    at = np.arange(len(lo))
    for level in range(64):
        mask = np.int64((1 << level) - 1)
        first, final = (lo >> level) + ((lo & mask) != 0), (hi >> level) - ((hi & mask) != mask)
        left = ((first & 1) == 1) & (first <= final)
        right = ((final & 1) == 0) & (first + left <= final)
        for emitted, index in ((left, first), (right, final)):
            if emitted.any():
                rows.append(at[emitted])
                levels.append(np.full(int(emitted.sum()), level, np.int8))
                indices.append(index[emitted].astype(np.int64))
        going = first + left <= final - right
        if not going.any():
            break
        at, lo, hi = at[going], lo[going], hi[going]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(levels), np.concatenate(indices)


def canonical(group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of heap-numbered blocks of each group, with no block below another and no two siblings; sorted."""
    if len(code) == 0:
        return group, code
    code = code.astype(np.int64)
    depth = np.frexp(code.astype(np.float64))[1] - 1
    size = np.int64(1) << (CELL_BITS - depth)
    at = (group.astype(np.int64) << CELL_BITS) + ((code - (np.int64(1) << depth)) << (CELL_BITS - depth))
    order = np.lexsort((-size, at))
    at, size = at[order], size[order]
    reach = np.maximum.accumulate(at + size)
    free = np.ones(len(at), bool)
    free[1:] = at[1:] + size[1:] > reach[:-1]
    at, size = at[free], size[free]
    for level in range(CELL_BITS):
        s = np.int64(1) << level
        left = np.flatnonzero((size[:-1] == s) & (size[1:] == s) & (at[:-1] & (2 * s - 1) == 0) & (at[1:] - at[:-1] == s))
        if len(left):
            size[left] = 2 * s
            at, size = np.delete(at, left + 1), np.delete(size, left + 1)
    depth = CELL_BITS - (np.frexp(size.astype(np.float64))[1] - 1)
    offset = at & ((np.int64(1) << CELL_BITS) - 1)
    return at >> CELL_BITS, ((np.int64(1) << depth) | (offset >> (CELL_BITS - depth))).astype(np.int32)


def coalesce_blocks(group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of adjacent blocks: group, first and last position inside the cell. The blocks must be canonical."""
    code = code.astype(np.int64)
    depth = np.frexp(code.astype(np.float64))[1] - 1
    first = (code - (np.int64(1) << depth)) << (CELL_BITS - depth)
    last = first + (np.int64(1) << (CELL_BITS - depth)) - 1
    new = np.ones(len(code), bool)
    new[1:] = (group[1:] != group[:-1]) | (first[1:] != last[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(code)) - 1 if len(head) else head
    return group[head], first[head], last[tail]


def _chunks(keys: list[pa.Array], names: list[str], group: np.ndarray, code: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Rows of at most CHUNK blocks; `first` is the row of `keys` that stands for a group."""
    if len(code) == 0:
        return pa.RecordBatch.from_arrays([k.slice(0, 0) for k in keys] + [pa.array([], pa.list_(pa.int32()))], names)
    place = np.arange(len(code))
    new = np.ones(len(code), bool)
    new[1:] = group[1:] != group[:-1]
    since = place - np.maximum.accumulate(np.where(new, place, 0))
    starts = np.flatnonzero(new | (since % CHUNK == 0))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), pa.array(code, pa.int32()))
    take = pa.array(first[group[starts]])
    return pa.RecordBatch.from_arrays([k.take(take) for k in keys] + [lists], names)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """keys..., lo, hi -> keys..., tier, cell, codes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        *keys, lo, hi = batch.columns
        names = batch.schema.names[:-2]
        row, level, index = decompose(lo.to_numpy(zero_copy_only=False), hi.to_numpy(zero_copy_only=False))
        level = level.astype(np.int64)
        tier = level // CELL_BITS
        depth = (tier + 1) * CELL_BITS - level
        cell = index >> depth
        code = ((np.int64(1) << depth) | (index & ((np.int64(1) << depth) - 1))).astype(np.int32)
        entity, _ = group_ids(keys) if keys else (np.zeros(batch.num_rows, np.int64), None)
        own = entity[row]
        order = np.lexsort((cell, tier, own))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(own[order]) != 0) | (np.diff(tier[order]) != 0) | (np.diff(cell[order]) != 0)
        first, group = order[new], np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        group, code = canonical(group, code)
        taken = [k.take(pa.array(row[first])) for k in keys] + [pa.array(tier[first].astype(np.int32)), pa.array(cell[first])]
        yield _chunks(taken, [*names, "tier", "cell", "codes"], group, code, np.arange(len(first)))


def _union(n_keys: int, runs: bool):
    """Joins the blocks of each (keys, tier, cell); rows must be sorted by these."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def emit(batch: pa.RecordBatch, codes: list[np.ndarray]) -> pa.RecordBatch:
            """`batch` has one row a group, `codes` its canonical blocks."""
            group = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            keys = batch.columns[: n_keys + 2]
            names = batch.schema.names[: n_keys + 2]
            if not runs:
                return _chunks(keys, [*names, "codes"], group, code, np.arange(len(codes)))
            group, first, last = coalesce_blocks(group, code)
            tier = keys[n_keys].to_numpy(zero_copy_only=False).astype(np.int64)[group]
            cell = keys[n_keys + 1].to_numpy(zero_copy_only=False)[group]
            unit = tier * CELL_BITS
            start = ((cell << CELL_BITS) + first) << unit
            end = (((cell << CELL_BITS) + last) << unit) + ((np.int64(1) << unit) - 1)
            take = pa.array(group)
            return pa.RecordBatch.from_arrays([k.take(take) for k in keys[:n_keys]] + [pa.array(start), pa.array(end)], [*names[:n_keys], "lo", "hi"])

        def reduce(batch: pa.RecordBatch, last_too: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None]:
            """What is complete, and the rows of the last group if it may go on."""
            starts = run_starts(batch.columns[: n_keys + 2])
            lists = batch.columns[-1]
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            sizes = offsets[1:] - offsets[:-1]
            values = values[offsets[0] : offsets[-1]]
            group = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows))), sizes)
            group, code = canonical(group.astype(np.int64), values)
            bounds = np.searchsorted(group, np.arange(len(starts) + 1))
            codes = [code[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            one = batch.take(pa.array(starts))
            if last_too:
                return emit(one, codes), None
            rest = one.slice(len(starts) - 1)
            kept = _chunks(rest.columns[: n_keys + 2], batch.schema.names, np.zeros(len(codes[-1]), np.int64), codes[-1], np.zeros(1, np.int64))
            return (emit(one.slice(0, len(starts) - 1), codes[:-1]) if len(starts) > 1 else None), kept

        for batch in batches:
            if batch.num_rows == 0:
                continue
            batch = batch.select([*batch.schema.names[: n_keys + 2], "codes"])
            if held is not None:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            done, held = reduce(batch, False)
            if done is not None:
                yield done
        if held is not None:
            yield reduce(held, True)[0]

    return of


def interval_runs(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Maximal covered runs inside dyadic cells: k0.., lo, hi (longs). Runs of different cells may touch or nest."""
    kinds = [df.schema[k].dataType for k in keys]
    fields = [T.StructField(f"k{i}", kind) for i, kind in enumerate(kinds)]
    blocks = T.StructType([*fields, T.StructField("tier", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("codes", T.ArrayType(T.IntegerType()))])
    runs = T.StructType([*fields, T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    k = [f"k{i}" for i in range(len(keys))]
    a, b = _as_long(df, start), _as_long(df, end)
    base = df.select(*[F.col(f"`{x}`").alias(y) for x, y in zip(keys, k, strict=True)], F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), (a.isNotNull() & b.isNotNull()).alias("whole")).where("whole").drop("whole")
    group = [*k, "tier", "cell"]
    part = base.mapInArrow(_to_blocks, blocks).withColumn("salt", F.spark_partition_id() % SALTS)
    salted = part.repartition(*group, "salt").sortWithinPartitions(*group).mapInArrow(_union(len(k), False), blocks)
    return salted.repartition(*group).sortWithinPartitions(*group).mapInArrow(_union(len(k), True), runs)


def _as_long(df: DataFrame, name: str) -> Column:
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.IntegralType):
        return column.cast("long")
    raise TypeError(f"{name}: an interval needs integers, dates or timestamps, not {kind.simpleString()}")


def _back(df: DataFrame, name: str):
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return lambda c: F.timestamp_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    if isinstance(kind, T.DateType):
        return lambda c: F.date_from_unix_date(c.cast("int"))
    return lambda c: c


def _openings(runs: DataFrame, k: list[str]) -> DataFrame:
    """The runs that open a period: k.., lo, and `before`, the end of the period before (null for the first)."""
    before = (Window.unboundedPreceding, -1)
    runs = runs.withColumns({"c0": F.expr(f"shiftright(lo, {CELL_BITS})"), "c1": F.expr(f"shiftright(lo, {2 * CELL_BITS})")})
    cells = runs.groupBy(*k, "c1", "c0").agg(F.max("hi").alias("reach"))
    blocks = cells.groupBy(*k, "c1").agg(F.max("reach").alias("reach"))
    blocks = blocks.select(*k, "c1", F.max("reach").over(Window.partitionBy(*k).orderBy("c1").rowsBetween(*before)).alias("carry1"))
    cells = cells.withColumn("carry", F.max("reach").over(Window.partitionBy(*k, "c1").orderBy("c0").rowsBetween(*before)))
    cells = null_safe_join(cells, blocks, [*k, "c1"]).select(*k, "c0", F.greatest("carry", "carry1").alias("carry"))
    local = F.max("hi").over(Window.partitionBy(*k, "c0").orderBy("lo", F.desc("hi")).rowsBetween(*before))
    runs = runs.withColumn("local", local)
    joined = null_safe_join(runs, cells, [*k, "c0"]).select(*k, "c0", "c1", "lo", F.greatest("local", "carry").alias("before"))
    return joined.where("before is null or (lo > before and coalesce(try_subtract(lo, before) > 1, true))")


def period_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The uncovered stretches between the covered positions of each entity.

    Columns: `keys`, `gap_start`, `gap_end` (both inside the gap). Intervals are
    closed; ends in the wrong order are swapped; touching intervals leave no
    gap. Rows with a null coordinate do not count; null keys are a key of their
    own. No rows in, or one period only: no rows out. Other columns are ignored.
    """
    k = [f"k{i}" for i in range(len(keys))]
    back = _back(df, start)
    gaps = _openings(interval_runs(df, keys, start, end), k).where("before is not null")
    return gaps.select(*[F.col(x).alias(y) for x, y in zip(k, keys, strict=True)], back(F.expr("before + 1")).alias("gap_start"), back(F.expr("lo - 1")).alias("gap_end"))


def continuous_periods(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The maximal covered periods of each entity: `keys`, `period_start`, `period_end`; rules as in `period_gaps`."""
    k = [f"k{i}" for i in range(len(keys))]
    back = _back(df, start)
    runs = interval_runs(df, keys, start, end)
    opened = _openings(runs, k)
    after = (1, Window.unboundedFollowing)
    cells = opened.groupBy(*k, "c1", "c0").agg(F.min_by("before", "lo").alias("closes"))
    blocks = cells.groupBy(*k, "c1").agg(F.min_by("closes", "c0").alias("closes"))
    lasts = runs.groupBy(*k).agg(F.max("hi").alias("furthest"))
    blocks = blocks.withColumn("next1", F.first("closes", True).over(Window.partitionBy(*k).orderBy("c1").rowsBetween(*after)))
    blocks = null_safe_join(blocks, lasts, k).select(*k, "c1", F.coalesce("next1", "furthest").alias("next1"))
    cells = cells.withColumn("next0", F.first("closes", True).over(Window.partitionBy(*k, "c1").orderBy("c0").rowsBetween(*after)))
    cells = null_safe_join(cells, blocks, [*k, "c1"]).select(*k, "c0", F.coalesce("next0", "next1").alias("next"))
    opened = opened.withColumn("lead", F.lead("before").over(Window.partitionBy(*k, "c0").orderBy("lo")))
    joined = null_safe_join(opened, cells, [*k, "c0"]).select(*k, "lo", F.coalesce("lead", "next").alias("hi"))
    return joined.select(*[F.col(x).alias(y) for x, y in zip(k, keys, strict=True)], back(F.col("lo")).alias("period_start"), back(F.col("hi")).alias("period_end"))
