"""Splitting oversized items at natural boundaries, with overlap, by agglomerative merging.

An item is a stretch of positions with atomic segments: the ranges from one
record start to the next. Between two segments stands a boundary; it is strong
where the label of the records changes, weak where it does not, and weakest
inside a record that is larger than a piece may be. Adjacent pairs wait in a
heap; the weakest boundary goes first (of equal ones the pair that is smallest
together, then the one further left) as long as the joined piece with the
overlap before it fits.

An item of any length is worked on in chunks of `2**24` positions, so no task
ever holds more than a chunk's records. Chunks meet at a strong boundary: the
records before the first label change of a chunk go with the chunk before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.arrowgroups import run_starts
from strandwise.runtime import checkpointed, small_side

CHUNK_BITS = 24
# Strength of a boundary.
INSIDE, SAME, CHANGE = 0, 1, 2


def merge_segments(begins: Sequence[int], overlap: Sequence[int], strength: Sequence[int], end: int, limit: int) -> list[int]:
    """Which segments begin a piece.

    Segment i covers [begins[i], begins[i + 1]) or up to `end`; a piece that
    begins with it needs `overlap[i]` more; `strength[i]` is of the boundary
    before it. A segment with its overlap must fit the limit.
    """
    n = len(begins)
    after = [*begins[1:], end]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours, by the first segment of a group
    reach = list(after)
    alive = [True] * n

    # A heap entry is one whole number: the strength of the boundary before group i, the joined size, its place.
    wide = n.bit_length()
    high = wide + (limit + 1).bit_length()
    size_mask, place_mask = (1 << (high - wide)) - 1, (1 << wide) - 1
    heap = [(strength[i] << high) | (size << wide) | i for i in range(1, n) if (size := reach[i] - begins[i - 1] + overlap[i - 1]) <= limit]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i = entry & place_mask
        first = left[i]
        if not alive[i] or (entry >> wide) & size_mask != reach[i] - begins[first] + overlap[first]:
            continue
        next_ = right[i]
        alive[i] = False
        end_ = reach[first] = reach[i]
        right[first] = next_
        if next_ < n:
            left[next_] = first
            if (size := reach[next_] - begins[first] + overlap[first]) <= limit:
                heapq.heappush(heap, (strength[next_] << high) | (size << wide) | next_)
        before = left[first]
        if before >= 0 and (size := end_ - begins[before] + overlap[before]) <= limit:
            heapq.heappush(heap, (strength[first] << high) | (size << wide) | first)
    return [i for i in range(n) if alive[i]]


def cut_oversized(begins: Sequence[int], overlap: Sequence[int], strength: Sequence[int], end: int, limit: int) -> tuple[list[int], list[int], list[int]]:
    """Segments that alone are too large, cut to the limit; such a cut has no record start close before it, so no overlap."""
    b, o, s = [], [], []
    for i, at in enumerate(begins):
        stop = begins[i + 1] if i + 1 < len(begins) else end
        b.append(at)
        o.append(overlap[i])
        s.append(strength[i])
        at += limit - overlap[i]
        while at < stop:
            b.append(at)
            o.append(0)
            s.append(INSIDE)
            at += limit
    return b, o, s


def _pieces(limit: int, n_keys: int):
    """keys.., chunk, at, overlap, strength, chunk_end, sorted by keys, chunk and at -> keys.., piece_start, piece_end, strength."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(whole: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            columns = [c.to_pylist() for c in whole.columns[n_keys + 1 :]]
            row, begin, end, kind = [], [], [], []
            for a, b in zip(starts, [*starts[1:], whole.num_rows], strict=True):
                at, over, strong, stop = (c[a:b] for c in columns)
                begins, overlap, strength = cut_oversized(at, over, strong, stop[0], limit)
                heads = merge_segments(begins, overlap, strength, stop[0], limit)
                row += [a] * len(heads)
                begin += [begins[i] - overlap[i] for i in heads]
                end += [*[begins[i] for i in heads[1:]], stop[0]]
                kind += [strength[i] for i in heads]
            take = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays([*[k.take(take) for k in whole.columns[:n_keys]], pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(kind, pa.int32())], [*whole.schema.names[:n_keys], "piece_start", "piece_end", "strength"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            starts = run_starts(whole.columns[: n_keys + 1])
            last = int(starts[-1])
            if last:
                yield cut(whole.slice(0, last), starts[:-1])
            held = [whole.slice(last)]
        if held:
            yield cut(held[0], np.zeros(1, np.int64))

    return of


def split_items(items: DataFrame, records: DataFrame, keys: Sequence[str], start: str, end: str, at: str, label: str, limit: int, overlap: int) -> DataFrame:
    """The pieces of every item: `keys`, `piece_start`, `piece_end` (not in the piece), `cut`.

    `items` has one row a key with the half-open range [start, end); `records`
    has the same keys, the position `at` of a record start and its `label`.
    Every piece is at most `limit` long. Each but an item's first begins at the
    earliest record start at most `overlap` positions before the end of the
    piece before, or at that end if there is none. `cut` says what stands at
    the end of the piece before: `start` (nothing, it is the first), `change`
    (the label changes), `same` (a record start of the same label) or `inside`
    (a record larger than a piece).

    Items of at most `limit` are one piece; of no length or less, or with a null
    bound, they have none. Records outside their item's range, without an item
    or with a null position do not count; repeated starts count once, with the
    least known label. Null labels equal each other and differ from all others.
    Null keys are keys of their own. An item without records is cut anywhere.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be less than half of the limit")
    if 2 * limit > 1 << CHUNK_BITS:
        raise ValueError(f"the limit can't exceed {1 << (CHUNK_BITS - 1)}")
    k = [f"k{i}" for i in range(len(keys))]
    named = [F.col(f"`{x}`").alias(y) for x, y in zip(keys, k, strict=True)]
    whole = items.select(*named, F.col(f"`{start}`").cast("long").alias("lo"), F.col(f"`{end}`").cast("long").alias("hi")).where("hi > lo")
    whole = checkpointed(whole)
    one = whole.where(f"hi - lo <= {limit}").select(*k, F.col("lo").alias("piece_start"), F.col("hi").alias("piece_end"), F.lit("start").alias("cut"))
    large = whole.where(f"hi - lo > {limit}")

    found = records.select(*named, F.col(f"`{at}`").cast("long").alias("at"), F.col(f"`{label}`").alias("label")).where("at is not null")
    side = small_side(large).withColumnsRenamed({x: f"r_{x}" for x in k})
    same = F.lit(True)
    for x in k:
        same &= F.col(x).eqNullSafe(F.col(f"r_{x}"))
    # The start of an item is a boundary too, with the label of the record there, if any.
    marks = found.join(side, same).where("at >= lo and at < hi").select(*k, "at", "label", "lo", "hi")
    marks = marks.unionByName(large.select(*k, F.col("lo").alias("at"), F.lit(None).cast(marks.schema["label"].dataType).alias("label"), "lo", "hi"))
    starts_at = checkpointed(marks.groupBy(*k, "at", "lo", "hi").agg(F.min("label").alias("label")))

    # A chunk's view has its records and those of the chunk before that its overlap may reach.
    cell = F.shiftright(F.col("at") - F.col("lo"), CHUNK_BITS)
    own = starts_at.withColumns({"cell": cell, "ghost": F.lit(False)})
    near = own.where((F.col("at") - F.col("lo") + overlap).bitwiseAND((1 << CHUNK_BITS) - 1) < overlap).withColumns({"cell": F.col("cell") + 1, "ghost": F.lit(True)})
    view = own.unionByName(near)
    here = Window.partitionBy(*k, "cell").orderBy("at")
    view = view.withColumns({"reach": F.min("at").over(here.rangeBetween(-overlap, 0)), "prior": F.lag("label").over(here)}).where("not ghost").drop("ghost")
    view = checkpointed(view.withColumn("no", F.row_number().over(here)))
    # What comes before the first record of a chunk: one row a chunk, so a window over an item is short.
    inner = F.max((F.col("no") > 1) & ~F.col("label").eqNullSafe(F.col("prior")))
    cells = view.groupBy(*k, "cell").agg(F.max_by("label", "at").alias("last_label"), F.min_by("label", "at").alias("first_label"), inner.alias("changes"))
    along = Window.partitionBy(*k).orderBy("cell")
    cells = cells.withColumn("label_before", F.lag("last_label").over(along))
    # Whether a run of one label begins in the cell: then what goes on in the next one can be left with it.
    cells = cells.withColumn("begins", F.col("changes") | (F.col("cell") == 0) | ~F.col("first_label").eqNullSafe(F.col("label_before")))
    cells = cells.select(*k, "cell", "label_before", F.lag("cell").over(along).alias("cell_before"), F.lag("begins").over(along).alias("begins_before"))
    other = cells.withColumnsRenamed({x: f"r_{x}" for x in [*k, "cell"]})
    view = view.join(other, same & (F.col("cell") == F.col("r_cell"))).drop(*[f"r_{x}" for x in [*k, "cell"]])
    prior = F.when(F.col("no") > 1, F.col("prior")).otherwise(F.col("label_before"))
    view = view.withColumn("strength", F.when(F.col("label").eqNullSafe(prior), SAME).otherwise(CHANGE))
    changes = F.max(F.when(F.col("strength") == CHANGE, 1).otherwise(0)).over(Window.partitionBy(*k, "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    back = (changes == 0) & F.col("cell_before").isNotNull() & F.col("begins_before")
    view = view.withColumn("chunk", F.when(back, F.col("cell_before")).otherwise(F.col("cell")))
    bounds = view.groupBy(*k, "chunk").agg(F.min("at").alias("chunk_start"))
    bounds = bounds.withColumn("next_start", F.lead("chunk_start").over(Window.partitionBy(*k).orderBy("chunk")))
    bounds = bounds.withColumnsRenamed({x: f"r_{x}" for x in [*k, "chunk"]})
    view = view.join(bounds, same & (F.col("chunk") == F.col("r_chunk"))).select(*k, "chunk", "at", F.when(F.col("at") == F.col("lo"), 0).otherwise(F.col("at") - F.col("reach")).alias("overlap"), F.when(F.col("at") == F.col("lo"), -1).otherwise(F.col("strength")).alias("strength"), F.coalesce("next_start", "hi").alias("chunk_end"))
    schema = T.StructType([*[T.StructField(x, large.schema[x].dataType) for x in k], T.StructField("piece_start", T.LongType()), T.StructField("piece_end", T.LongType()), T.StructField("strength", T.IntegerType())])
    # The heap is the longest step: a number of tasks of its own keeps a few rows from being put into one.
    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    view = view.select(*k, "chunk", "at", "overlap", F.col("strength").cast("long").alias("strength"), "chunk_end")
    pieces = view.repartition(tasks, *k, "chunk").sortWithinPartitions(*k, "chunk", "at").mapInArrow(_pieces(limit, len(k)), schema)
    cut = F.when(F.col("strength") == CHANGE, "change").when(F.col("strength") == SAME, "same").when(F.col("strength") == INSIDE, "inside").otherwise("start")
    out = one.unionByName(pieces.select(*k, "piece_start", "piece_end", cut.alias("cut")))
    return out.select(*[F.col(x).alias(y) for x, y in zip(k, keys, strict=True)], "piece_start", "piece_end", "cut")

