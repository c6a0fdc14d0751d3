"""Resampling of very many clusters: draws are split down a binary tree, so that each task draws for its own clusters.

Clusters lie in 2^h buckets. How many of all draws fall to the left half of the buckets is binomial (with replacement) or
hypergeometric (without), and so on down to a bucket; each node's draws come from a generator of its own, keyed by the
seed and the node, for all replicates at once. Every task walks from the root to its bucket and gets the same numbers on
the way; no cluster is numbered, sent or sorted, and only sums leave a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import percentile_ci

#: Clusters that a bucket is to have, levels of the tree at most, and numbers that a task draws at a time.
BUCKET, LEVELS, DRAWN = 4096, 16, 1 << 22


def _generator(*key) -> np.random.Generator:
    digest = hashlib.sha256("|".join(map(str, key)).encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest[:16], "little")))


def split_draws(sizes: np.ndarray, bucket: int, draws: np.ndarray, seed: str, replace: bool) -> np.ndarray:
    """How many of each replicate's draws fall into a bucket, given the clusters in each of the 2^h buckets."""
    low, high, node = 0, len(sizes), 1
    total = np.concatenate([[0], np.cumsum(sizes)])
    while high - low > 1:
        middle = (low + high) // 2
        left, right = int(total[middle] - total[low]), int(total[high] - total[middle])
        rng = _generator(seed, "node", node)
        if left + right == 0:
            first = np.zeros_like(draws)
        elif replace:
            first = rng.binomial(draws, left / (left + right))
        else:
            first = rng.hypergeometric(left, right, draws)
        if bucket < middle:
            draws, high, node = first, middle, 2 * node
        else:
            draws, low, node = draws - first, middle, 2 * node + 1
    return draws


def bucket_counts(size: int, draws: np.ndarray, bucket: int, seed: str, replace: bool):
    """(replicates from, to, counts of each cluster in the bucket), some replicates at a time."""
    rng = _generator(seed, "bucket", bucket)
    step = max(1, DRAWN // max(1, size))
    for at in range(0, len(draws), step):
        n = draws[at : at + step]
        if replace:
            yield at, at + len(n), rng.multinomial(n, np.full(size, 1 / size))
        else:
            rank = rng.permuted(np.tile(np.arange(size), (len(n), 1)), axis=1)
            yield at, at + len(n), (rank < n[:, None]).astype(np.int64)


def resampled_sums(clusters: DataFrame, key: Sequence[str], values: Sequence[str], n: int, seed: str, draws: int | None = None) -> DataFrame:
    """(rep, drawn, once, sum_<value>, once_<value>...) of n replicates that draw whole clusters.

    With ``draws`` None, as many clusters as there are, with replacement; else so many without. ``sum_`` counts a cluster
    as often as it is drawn, ``once_`` once if it is drawn at all. ``key`` tells clusters apart; null values count 0.
    """
    spark = clusters.sparkSession
    total = clusters.count()
    levels = min(LEVELS, max(0, (-(-total // BUCKET) - 1).bit_length()))
    rows = clusters.select(*key, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(1 << levels)).cast("int"))
    sizes = np.zeros(1 << levels, np.int64)
    for bucket, k in rows.groupBy("__bucket").count().collect():  # 2^LEVELS at most
        sizes[bucket] = k
    held = spark.sparkContext.broadcast(sizes)
    replace = draws is None
    asked = np.full(n, total if draws is None else draws, np.int64)
    names = ["drawn", "once", *[f"{kind}_{v}" for v in values for kind in ("sum", "once")]]

    def run(table: pa.Table) -> pa.Table:
        bucket = table["__bucket"][0].as_py()
        table = table.sort_by([(k, "ascending") for k in key])
        x = np.stack([np.ones(table.num_rows), *[table[v].to_numpy() for v in values]], axis=1)
        own = split_draws(held.value, bucket, asked, seed, replace)
        out = np.zeros((n, 2 * x.shape[1]))
        for a, b, counts in bucket_counts(len(x), own, bucket, seed, replace):
            out[a:b, 0::2], out[a:b, 1::2] = counts @ x, (counts > 0) @ x
        return pa.table({"rep": np.arange(n), **dict(zip(names, out.T.copy(), strict=True))})

    found = rows.groupBy("__bucket").applyInArrow(run, "rep long, " + ", ".join(f"`{c}` double" for c in names))
    return found.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names])


def split_bootstrap_ci(clusters: DataFrame, n_boot: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """(n_boot, lo, hi, point) of (arm, cluster, n, total): percentile interval of the mean when whole clusters are drawn."""
    boots = resampled_sums(clusters, ["arm", "cluster"], ["n", "total"], n_boot, seed).select((F.col("sum_total") / F.col("sum_n")).alias("m"))
    return percentile_ci(boots, "m", alpha).crossJoin(clusters.agg((F.sum("total") / F.sum("n")).alias("point")))


def split_variance_ci(moments: DataFrame, n_boot: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """Intervals of between_sd and within_sd of (cluster, m, v) over drawn clusters; drawn twice counts once for the former."""
    centre = moments.agg(F.avg("m")).first()[0] or 0.0
    rows = moments.select("cluster", (F.col("m") - centre).alias("m"), ((F.col("m") - centre) ** 2).alias("mm"), "v", F.col("v").isNotNull().cast("int").alias("has"))
    boots = resampled_sums(rows, ["cluster"], ["m", "mm", "v", "has"], n_boot, seed)
    k = F.col("once")
    between = F.sqrt(F.greatest(F.try_divide(F.col("once_mm") - F.try_divide(F.col("once_m") ** 2, k), k - 1), F.lit(0.0)))
    boots = boots.select(between.alias("b"), F.sqrt(F.try_divide(F.col("sum_v"), F.col("sum_has"))).alias("w"))
    b = percentile_ci(boots, "b", alpha).select(F.col("lo").alias("between_lo"), F.col("hi").alias("between_hi"))
    return b.crossJoin(percentile_ci(boots, "w", alpha).select(F.col("lo").alias("within_lo"), F.col("hi").alias("within_hi")))


def split_permutation(clusters: DataFrame, target: str, control: str, n_perm: int, seed: str, two_sided: bool = True, correction: int = 1) -> DataFrame:
    """(observed, p): the difference of the arms' means of cluster means, against drawing as many clusters as the target has.

    clusters: (arm, cluster, n, total). p is null where an arm has no cluster.
    """
    rows = clusters.filter(F.col("arm").isin(target, control)).select("arm", "cluster", (F.col("total") / F.col("n")).alias("m"))
    of = lambda a: F.avg(F.when(F.col("arm") == a, F.col("m")))
    seen = rows.agg((of(target) - of(control)).alias("d"), F.count_if(F.col("arm") == target).alias("k"), F.count("*").alias("n"), F.sum("m").alias("s")).first()
    if not 0 < seen.k < seen.n:
        return rows.sparkSession.createDataFrame([(seen.d, None)], "observed double, p double")
    null = resampled_sums(rows, ["arm", "cluster"], ["m"], n_perm, seed, seen.k)
    delta = F.col("sum_m") / seen.k - (F.lit(seen.s) - F.col("sum_m")) / (seen.n - seen.k)
    beyond = (F.abs(delta) if two_sided else delta) >= (abs(seen.d) if two_sided else seen.d) - 1e-12
    return null.agg(F.lit(seen.d).alias("observed"), ((F.count_if(beyond) + correction) / (F.count("*") + correction)).alias("p"))
