"""Seeded draws that depend on keys alone, so that they are the same on any partitioning and in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*keys: Column | str | int) -> Column:
    """A whole number from 0 to 2**32 - 1: the first 8 hexadecimal digits of md5(key|key|...)."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")
