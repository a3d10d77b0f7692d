"""Canonical spellings of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_contig(name: Column | str) -> Column:
    """Spaces around a contig name and one leading `chr`, in any case, do not count. Null stays null."""
    return F.regexp_replace(F.trim(name), "^[cC][hH][rR]", "")


def norm_name(name: Column | str) -> Column:
    """Read group, repeat and gene names: spaces around and letter case do not count. Null stays null."""
    return F.upper(F.trim(name))


def norm_source(name: Column | str) -> Column:
    """Source names: spaces around and case do not count; runs of space, hyphen and underscore are one underscore."""
    return F.regexp_replace(F.lower(F.trim(name)), "[ _-]+", "_")
