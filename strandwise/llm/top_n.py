"""The N best items of every group, by a SQL row_number window with a rank filter.

The filter on the rank makes the optimiser place a group limit on both sides of
the shuffle: each task keeps at most N rows a group before they are sent, so a
group of any size arrives as N rows a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def distinct_items(df: DataFrame, same: Sequence[str], item: str) -> DataFrame:
    """Rows equal in all columns of `same` are one item, named by its smallest `item`; nulls equal each other."""
    columns = ", ".join(f"`{c}`" for c in same)
    return df.sparkSession.sql(f"SELECT {columns}, min(`{item}`) AS `{item}` FROM {{src}} GROUP BY {columns}", src=df)


def distinct_by_digest(df: DataFrame, kept: Sequence[str], rest: Sequence[str], item: str) -> DataFrame:
    """As `distinct_items` over `kept` and `rest`, but of `rest` only a digest of 128 bits is shuffled, and `kept` and `item` come out.

    Two items that differ in `rest` alone are taken for one with a chance of
    2**-128. Nulls in `rest` are part of the digest.
    """
    columns = [F.col(f"`{c}`") for c in rest]
    whole = [F.array(*[c.isNull() for c in columns]), *columns] if columns else []
    halves = {free_name(df, f"digest_{i}"): F.xxhash64(F.lit(i), *whole) for i in (1, 2)}
    narrow = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{item}`"), *[c.alias(n) for n, c in halves.items()])
    return distinct_items(narrow, [*kept, *halves], item).select(*[F.col(f"`{c}`") for c in [*kept, item]])


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, str]], n: int, rank: str = "rank_no", only_larger: bool = False) -> DataFrame:
    """The first `n` rows of each group with their `rank`, from 1.

    `order` has (column, "asc" or "desc"); nulls come after every known value
    either way. The last column should identify a row: among rows equal in all
    of `order` the choice is open. Null group values are one group. With
    `only_larger`, groups of at most `n` rows are left out; for that, n + 1
    rows of a group are ranked, never the whole group. An empty table gives no
    rows. A column that has the name of `rank` makes an error.
    """
    if rank.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{rank} is a column already")
    keys = ", ".join(f"`{c}`" for c in group)
    by = ", ".join(f"`{c}` {'ASC' if way == 'asc' else 'DESC'} NULLS LAST" for c, way in order)
    ranked = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {by}) AS `{rank}` FROM {{src}}) WHERE `{rank}` <= {n + only_larger}"
    kept = df.sparkSession.sql(ranked, src=df)
    if not only_larger:
        return kept
    size = free_name(kept, "group_size")
    counted = f"SELECT * FROM (SELECT *, max(`{rank}`) OVER (PARTITION BY {keys}) AS `{size}` FROM {{src}}) WHERE `{size}` > {n} AND `{rank}` <= {n}"
    return df.sparkSession.sql(counted, src=kept).drop(size)
