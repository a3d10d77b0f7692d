"""Values that stand for nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the tables write where there is no insert size.
NO_SIZE = (0, -1, 9223372036854775807)


def size_or_null(size: Column | str) -> Column:
    """The absolute insert size; null where the stored one is null or stands for none. The least long, which has no absolute value, is none too."""
    column = F.col(size) if isinstance(size, str) else size
    return F.when(column.isin(*NO_SIZE) | (column == F.lit(-9223372036854775808)), None).otherwise(F.abs(column))


def known_or_null(value: Column | str) -> Column:
    """Null where -1 stands for an unknown measure."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(column == -1, None).otherwise(column)
