"""Ranking, sampling and splitting. Order keys decide; none of them is random."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import draw


def first_n(rows: DataFrame, by: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group, with their place as ``rn``."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= n)


def top(rows: DataFrame, by: Column, tie: str, n: int) -> DataFrame:
    """The n rows with the highest value, ties by the least key: partial top-n in each task."""
    return rows.orderBy(by.desc(), tie).limit(n)


def even_sample(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """At most n rows of each group, evenly spaced in its order: those at floor(i * size / n)."""
    w = W.partitionBy(*by)
    out = rows.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    i, size = F.col("__i"), F.col("__n")
    # i is floor(j * size / n) for a whole j exactly if ceil(i * n / size) * size / n, rounded down, is i
    j = F.expr(f"(__i * {n} + __n - 1) div __n")
    return out.filter((size <= n) | ((j < n) & (F.floor(j * size / F.lit(n)) == i))).drop("__i", "__n")


def round_robin(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows, one of each group in turn."""
    out = rows.withColumn("__i", F.row_number().over(W.partitionBy(by).orderBy(order)))
    return out.orderBy("__i", by).limit(n).drop("__i")


def seeded_sample(rows: DataFrame, by: Sequence[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows of each group in an order that seed and key decide."""
    return first_n(rows.withColumn("__d", draw(seed, F.col(key))), by, ["__d", key], n).drop("__d", "rn")


def half_split(clusters: DataFrame) -> DataFrame:
    """(role, work, split) of (role, work): the first half of each role's works, rounded up, is for discovery.

    A role with one work stays in discovery; a work that would be on both sides is for discovery in every role.
    """
    pairs = clusters.select("role", "work").distinct()
    w = W.partitionBy("role")
    side = pairs.withColumn("__first", F.row_number().over(w.orderBy("work")) * 2 <= F.count("*").over(w) + 1)
    found = side.filter("__first").select("work").distinct().withColumn("__d", F.lit(True))
    return side.join(found, "work", "left").select("role", "work", F.when(F.col("__d"), "discovery").otherwise("replication").alias("split"))


def modulo_split(key: Column) -> Column:
    """train for 0, 1, 2, dev for 3, test for 4, by the number at the key's end, modulo 5."""
    m = F.pmod(F.element_at(F.split(key.cast("string"), "-"), -1).cast("long"), F.lit(5))
    return F.when(m <= 2, "train").when(m == 3, "dev").otherwise("test")


def dedup_keep_first(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    return first_n(rows, key, [order], 1).drop("rn")
