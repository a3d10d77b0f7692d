"""Filling containers of fixed capacity: bulk-synchronous best fit.

Documents are range-sorted by size and ranked inside their size, which moves an
id and a size a document once. From there on equal sizes are interchangeable, so
both sides of the matching are tables of runs: so many documents of a size from
a rank on, so many containers with a gap from a container on. A round is one
job over these tables:

1. *Range-sort*: runs of documents and of gaps go to ranges of `SPAN` sizes and
   are sorted downward, gaps before documents of their size.
2. *Successor sweep*, in all ranges at once: the successor of a document is the
   smallest gap that holds it. Going down, gaps are stacked and a document takes
   the gap on top; conflicts go by rank, larger documents and lower ranks first.
   What stays unmatched in a range meets in ranges sixteen times as wide, and so
   on up to one range over all; the matches are those of one sweep over
   everything, as gaps and documents are matched like brackets.
3. *Update*: gaps that got a document shrink and take part in the next round.
4. A round that places nothing opens containers: one for each document above
   half of the capacity at first, then as many as the rest of the tokens needs
   at least, for the largest documents left.

There are never more runs of documents than sizes, and the driver sees three
numbers a round. The matches, runs of ranks to runs of containers, are joined
back to the ranked documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.arrowgroups import run_starts
from strandwise.runtime import checkpointed, small_side

#: Sizes in a range of the first sweep of a round, and how much wider the ranges of each further sweep are.
SPAN, WIDER = 256, 16
GAP, DOC, MATCH = 0, 1, 2
#: `value` is the gap or size, `first` the container or rank, `n` the length of a run; a match has its container in `other` and what is left of the gap in `rest`.
RUNS = T.StructType([T.StructField("kind", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("value", "first", "n", "other", "rest")]])


def match_downward(rows: Iterator[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Sweep over runs (kind, value, first, n), largest value first, gaps first: the matches (size, rank, n, container, rest of the gap) and the runs that are left."""
    open_: list[tuple[int, int, int]] = []
    matches, left = [], []
    for kind, value, first, n in rows:
        if kind == GAP:
            open_.append((value, first, n))
            continue
        while n and open_:
            gap, container, free = open_.pop()
            taken = min(n, free)
            matches.append((value, first, taken, container, gap - value))
            if free > taken:
                open_.append((gap, container + taken, free - taken))
            first, n = first + taken, n - taken
        if n:
            left.append((DOC, value, first, n))
    return matches, left + [(GAP, *x) for x in open_]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by range, value downward, kind and first; matches of sweeps before go through."""
    held: list[tuple] = []
    at = None

    def emit() -> pa.RecordBatch:
        matches, left = match_downward([r[:4] for r in held if r[0] != MATCH])
        out = [r for r in held if r[0] == MATCH] + [(MATCH, *m) for m in matches] + [(*x, None, None) for x in left]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], RUNS.names)

    for batch in batches:
        for *row, range_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and range_ != at:
                yield emit()
                held = []
            at = range_
            held.append(tuple(row))
    if held:
        yield emit()


def _round(runs: DataFrame, capacity: int) -> DataFrame:
    """One successor sweep over all runs, in wider and wider ranges."""
    span = SPAN
    while True:
        ranged = runs.select(*RUNS.names, F.expr(f"(value - 1) div {span}").alias("range"))
        runs = ranged.repartition("range").sortWithinPartitions("range", F.desc("value"), "kind", "first").mapInArrow(_sweep, RUNS)
        if (capacity - 1) // span == 0:
            return runs
        span *= WIDER


def _opened(docs: DataFrame, most: int, made: int, capacity: int) -> DataFrame:
    """Runs after `most` containers, from number `made` on, were opened for the largest documents. The window is over no more rows than there are sizes."""
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    docs = docs.withColumn("before", before).withColumn("taken", F.greatest(F.lit(0), F.least("n", F.lit(most) - F.col("before"))))
    none = F.lit(None).cast("long")
    run = lambda kind, value, first, n, other, rest: F.struct(F.lit(kind).alias("kind"), *[c.alias(x) for x, c in zip(RUNS.names[1:], (value, first, n, other, rest), strict=True)])
    container = F.lit(made) + F.col("before")
    made_of = F.array(
        run(MATCH, F.col("value"), F.col("first"), F.col("taken"), container, F.lit(capacity) - F.col("value")),
        run(DOC, F.col("value"), F.col("first") + F.col("taken"), F.col("n") - F.col("taken"), none, none),
    )
    return docs.select(F.explode(F.filter(made_of, lambda x: x.n > 0)).alias("x")).select("x.*").select(*[F.col(f.name).cast(f.dataType) for f in RUNS.fields])


def plan_packing(sizes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """`sizes` has `item` (from 1 to the capacity, each once) and `n`. The plan (item, rank, n, container): so many documents of that size from that rank on go to containers from that one on; and how many containers there are."""
    none = F.lit(None).cast("long")
    state = checkpointed(sizes.select(F.lit(DOC).alias("kind"), F.col("item").alias("value"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), none.alias("other"), none.alias("rest")))
    doc = F.col("kind") == DOC
    left, large, tokens = state.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(2 * F.col("value") > capacity, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.col("value") * F.col("n")), F.lit(0))).first()
    gaps = state.where("false")
    made, matches, open_for = 0, [], large
    while left:
        if open_for:
            state = checkpointed(_opened(state.where(doc), open_for, made, capacity).unionByName(gaps))
            made, left = made + open_for, left - open_for
        else:
            state = checkpointed(_round(state.where(doc).unionByName(gaps), capacity))
        placed, tokens = state.agg(F.coalesce(F.sum(F.when(F.col("kind") == MATCH, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(doc, F.col("value") * F.col("n"))), F.lit(0))).first()
        if placed:
            matches.append(state.where(F.col("kind") == MATCH))
        left = left if open_for else left - placed
        open_for = 0 if placed else -(-tokens // capacity)
        shrunk = state.where((F.col("kind") == MATCH) & (F.col("rest") > 0)).select(F.lit(GAP).alias("kind"), F.col("rest").alias("value"), F.col("other").alias("first"), "n", none.alias("other"), none.alias("rest"))
        gaps = state.where(F.col("kind") == GAP).unionByName(shrunk)
    plan = reduce(DataFrame.unionByName, matches) if matches else state.where("false")
    return plan.select(F.col("value").alias("item"), F.col("first").alias("rank"), "n", F.col("other").alias("container")), made


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, size, item, part of a partition sorted by item: the place in the partition and among the equal items."""
    done, last, since = 0, None, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        item = batch.column(2)
        starts = run_starts([item])
        place = np.arange(done, done + n)
        head = np.zeros(n, np.int64)
        head[starts] = place[starts]
        if last is not None and item[0].as_py() == last:
            head[0] = since
        head = np.maximum.accumulate(head)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(place - head)], [*batch.schema.names, "place", "along"])
        done, last, since = done + n, item[n - 1].as_py(), int(head[-1])


def pack(df: DataFrame, id: str, size: Column, capacity: int) -> DataFrame:
    """Where every item goes: `id`, `piece_no` (from 0), `container_id`, `n_tokens`; the pieces of a container never exceed the capacity.

    An item is divided only if it exceeds the capacity: into full containers of
    its own and one rest, which is packed like any other item. A null size, or
    one of 0 or less, takes no room; such items are spread over the containers.
    Repeated ids are items of their own. Equal sizes are ranked by id, so the
    result does not depend on how the input is partitioned. Container ids are
    dense up to the packed ones; those of full pieces lie above, with holes. No
    items: no rows. Other columns are ignored.
    """
    sized = df.select(F.col(f"`{id}`").alias("id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    whole = F.when(F.col("size") > capacity, F.expr(f"size div {capacity}")).otherwise(F.lit(0))
    sized = sized.select("id", "size", (F.col("size") - whole * capacity).alias("item"))
    ranged = checkpointed(sized.repartitionByRange("item", "id").sortWithinPartitions("item", "id").withColumn("part", F.spark_partition_id()))

    numbered = ranged.mapInArrow(_numbered, T.StructType([*ranged.schema.fields, T.StructField("place", T.LongType()), T.StructField("along", T.LongType())]))
    # One row a partition and size; a size lies in neighbouring partitions, so these are no more than sizes and partitions together.
    counts = checkpointed(ranged.groupBy("part", "item").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest")))
    before = (Window.unboundedPreceding, -1)
    along = Window.partitionBy("item").orderBy("part").rowsBetween(*before)
    bases = counts.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("base_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))  # one row a partition
    places = counts.withColumn("offset", F.coalesce(F.sum("n").over(along), F.lit(0))).join(bases, F.col("part") == F.col("base_part")).select("part", "item", "offset", "base")
    most = (counts.agg(F.max("largest")).first()[0] or 0) // capacity + 1
    plan, containers = plan_packing(counts.where("item > 0").groupBy("item").agg(F.sum("n").alias("n")), capacity)

    places, plan = small_side(checkpointed(places)), small_side(checkpointed(plan))
    ranked = numbered.join(places, ["part", "item"]).select("id", "size", "item", (F.col("offset") + F.col("along")).alias("at"), (F.col("base") + F.col("place")).alias("row_no"))
    rest = F.col("size") - F.col("item")
    packed = ranked.where("item > 0").alias("d").join(plan.alias("p"), (F.col("d.item") == F.col("p.item")) & (F.col("at") >= F.col("rank")) & (F.col("at") < F.col("rank") + F.col("n")))
    packed = packed.select("id", F.expr(f"cast((size - d.item) div {capacity} as int)").alias("piece_no"), (F.col("container") + F.col("at") - F.col("rank")).alias("container_id"), F.col("d.item").alias("n_tokens"))
    full = ranked.where(rest > 0).select("id", "row_no", F.explode(F.expr(f"sequence(0, cast((size - item) div {capacity} - 1 as int))")).alias("piece_no"))
    full = full.select("id", "piece_no", (F.lit(containers) + F.col("row_no") * most + F.col("piece_no")).alias("container_id"), F.lit(capacity).cast("long").alias("n_tokens"))
    empty = ranked.where("size = 0").select("id", F.lit(0).alias("piece_no"), F.pmod("row_no", F.lit(max(1, containers))).alias("container_id"), F.lit(0).cast("long").alias("n_tokens"))
    return packed.unionByName(full).unionByName(empty).withColumnRenamed("id", id)


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers with tokens, tokens, the least number of containers there could be, and the share of room used."""
    used = packed.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    one = used.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.max("used").alias("fullest"), F.max("pieces").alias("most_pieces"))
    return one.withColumns({"least_containers": F.ceil(F.col("n_tokens") / capacity), "fill": F.expr(f"try_divide(n_tokens, n_containers * {capacity})")})

