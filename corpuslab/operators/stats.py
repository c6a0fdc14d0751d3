"""Resampling inference over cluster sums, and other tests.

Replicates are rows: each meets the small table of cluster sums (arm, cluster, n, total), never the data. Draws depend
on seed, replicate and slot alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import ROBUSTNESS_TESTS
from ..functions.rng import draw
from ..sources.scratch import written


def cluster_sums(rows: DataFrame, arm: str | None, cluster: str, value: str) -> DataFrame:
    by = ([F.col(arm).alias("arm")] if arm else [F.lit("all").alias("arm")]) + [F.col(cluster).alias("cluster")]
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("total"))


def replicates(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").alias("rep"))


def mean_difference(rows: DataFrame, arm: str, value: str, target: str, control: str) -> DataFrame:
    m = lambda a: F.avg(F.when(F.col(arm) == a, F.col(value)))
    return rows.agg(m(target).alias("mean_target"), m(control).alias("mean_control"), (m(target) - m(control)).alias("delta"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with i, their number from 0 in that order, which must be unique: by ranges, without a task that sees all."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    before, total = [], 0
    for part, n in sorted(map(tuple, rows.groupBy("__part").count().collect())):  # a row for each range
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "__part long, __before long")
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(offsets), "__part").withColumn("i", place).drop("__at", "__part", "__before")


def drawn_clusters(clusters: DataFrame, n_boot: int, seed: str) -> DataFrame:
    """(rep, slot, all cluster columns): as many draws with replacement as there are clusters, for each replicate.

    A row for each replicate and cluster; ``splitting`` draws the same distribution without them.
    """
    rows = written(numbered(clusters, "arm", "cluster"))
    k = rows.count()
    draws = clusters.sparkSession.range(n_boot * k).select(F.expr(f"id div {max(k, 1)}").alias("rep"), F.expr(f"id % {max(k, 1)}").alias("slot"))
    return draws.withColumn("i", draw(seed, F.col("rep"), F.col("slot")) % k).join(rows, "i").drop("i")


def percentile_ci(boots: DataFrame, value: str, alpha: float) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return boots.agg(F.count("*").alias("n_boot"), q.alias("__q")).select("n_boot", F.col("__q")[0].alias("lo"), F.col("__q")[1].alias("hi"))


def cluster_bootstrap_ci(clusters: DataFrame, n_boot: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """(n_boot, lo, hi, point): percentile interval of the mean when whole clusters are drawn; point is the plain mean."""
    boots = drawn_clusters(clusters, n_boot, seed).groupBy("rep").agg((F.sum("total") / F.sum("n")).alias("m"))
    return percentile_ci(boots, "m", alpha).crossJoin(clusters.agg((F.sum("total") / F.sum("n")).alias("point")))


def permuted_deltas(clusters: DataFrame, target: str, n_perm: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, rep, delta): mean of cluster means of as many clusters as the target has, minus the others', after shuffling."""
    groups = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    base = clusters.select(*by, "arm", "cluster", (F.col("total") / F.col("n")).alias("m")).withColumn("n_t", F.count_if(F.col("arm") == target).over(groups))
    rows = replicates(clusters, n_perm).crossJoin(base)
    order = W.partitionBy(*by, "rep").orderBy(draw(seed, F.col("rep"), F.col("arm"), F.col("cluster")), "arm", "cluster")
    rows = rows.withColumn("in_t", F.row_number().over(order) <= F.col("n_t"))
    return rows.groupBy(*by, "rep").agg((F.avg(F.when(F.col("in_t"), F.col("m"))) - F.avg(F.when(~F.col("in_t"), F.col("m")))).alias("delta"))


def cluster_permutation(clusters: DataFrame, target: str, control: str, n_perm: int, seed: str, two_sided: bool = True, correction: int = 1, observed_by: str = "passage") -> DataFrame:
    """(observed, p): the observed difference of means (of passages or clusters) against shuffled cluster means."""
    if observed_by == "passage":
        m = lambda a: F.sum(F.when(F.col("arm") == a, F.col("total"))) / F.sum(F.when(F.col("arm") == a, F.col("n")))
    else:
        m = lambda a: F.avg(F.when(F.col("arm") == a, F.col("total") / F.col("n")))
    observed = clusters.agg((m(target) - m(control)).alias("observed"))
    size = F.abs if two_sided else (lambda c: c)
    null = permuted_deltas(clusters, target, n_perm, seed).crossJoin(F.broadcast(observed))
    tail = F.count_if(size(F.col("delta")) >= size(F.col("observed")) - 1e-12)
    return null.groupBy("observed").agg(((tail + correction) / (F.count("*") + correction)).alias("p"))


def leave_one_cluster_out(clusters: DataFrame, target: str, control: str) -> DataFrame:
    """(cluster, delta): the difference of means without each cluster, from totals; null if an arm is then empty."""
    own = clusters.groupBy("cluster").agg(*[F.coalesce(F.sum(F.when(F.col("arm") == a, F.col(c))), F.lit(0)).alias(f"{c}_{s}") for a, s in ((target, "t"), (control, "c")) for c in ("n", "total")])
    all_ = own.agg(*[F.sum(c).alias(f"all_{c}") for c in ("n_t", "total_t", "n_c", "total_c")])
    m = lambda s: F.try_divide(F.col(f"all_total_{s}") - F.col(f"total_{s}"), F.col(f"all_n_{s}") - F.col(f"n_{s}"))
    return own.crossJoin(F.broadcast(all_)).select("cluster", (m("t") - m("c")).alias("delta"))


def leave_one_out(items: DataFrame, key: str, value: str) -> DataFrame:
    """(key, effect): the mean minus the mean without the item."""
    all_ = items.agg(F.count(value).alias("__n"), F.sum(value).alias("__s"))
    return items.crossJoin(F.broadcast(all_)).select(key, (F.col("__s") / F.col("__n") - F.try_divide(F.col("__s") - F.col(value), F.col("__n") - 1)).alias("effect"))


def max_statistic(clusters: DataFrame, target: str, control: str, feature: str, n_perm: int, seed: str) -> DataFrame:
    """(feature, observed, p_family): each feature's difference against the largest of each replicate."""
    m = lambda a: F.avg(F.when(F.col("arm") == a, F.col("total") / F.col("n")))
    observed = clusters.groupBy(feature).agg((m(target) - m(control)).alias("observed"))
    largest = permuted_deltas(clusters, target, n_perm, seed, [feature]).groupBy("rep").agg(F.max(F.abs("delta")).alias("largest"))
    rows = largest.crossJoin(F.broadcast(observed))
    return rows.groupBy(feature, "observed").agg(F.avg((F.col("largest") >= F.abs("observed") - 1e-12).cast("double")).alias("p_family"))


def bh_fdr(tests: DataFrame, p: str, key: str, q: float) -> DataFrame:
    """Add reject: Benjamini-Hochberg at level q. A few tests at most: their order is taken in one task."""
    one = W.partitionBy(F.lit(0))
    out = tests.withColumns({"__i": F.row_number().over(one.orderBy(p, key)), "__n": F.count("*").over(one)})
    out = out.withColumn("__cut", F.max(F.when(F.col(p) <= q * F.col("__i") / F.col("__n"), F.col("__i"))).over(one))
    return out.withColumn("reject", F.coalesce(F.col("__i") <= F.col("__cut"), F.lit(False))).drop("__i", "__n", "__cut")


def variance_parts(clusters: DataFrame) -> DataFrame:
    """(n_clusters, between_sd, within_sd, icc) of (cluster, m, v): cluster means, and variances where there are two."""
    out = clusters.agg(F.count("*").alias("n_clusters"), F.stddev_samp("m").alias("between_sd"), F.sqrt(F.avg("v")).alias("within_sd"))
    b, w = F.col("between_sd") * F.col("between_sd"), F.col("within_sd") * F.col("within_sd")
    return out.withColumn("icc", F.try_divide(b, b + w))


def cluster_moments(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    return rows.groupBy(F.col(cluster).alias("cluster")).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def variance_bootstrap(moments: DataFrame, n_boot: int, seed: str, alpha: float = 0.05, collapse: bool = True) -> DataFrame:
    """Intervals of between_sd and within_sd over drawn clusters; a cluster drawn twice counts once for the former."""
    rows = drawn_clusters(moments.withColumn("arm", F.lit("all")), n_boot, seed)
    once = rows.dropDuplicates(["rep", "cluster"]) if collapse else rows
    between = once.groupBy("rep").agg(F.stddev_samp("m").alias("b"))
    within = rows.groupBy("rep").agg(F.sqrt(F.avg("v")).alias("w"))
    b = percentile_ci(between, "b", alpha).select(F.col("lo").alias("between_lo"), F.col("hi").alias("between_hi"))
    return b.crossJoin(percentile_ci(within, "w", alpha).select(F.col("lo").alias("within_lo"), F.col("hi").alias("within_hi")))


def binary_bootstrap(rows: DataFrame, by: str, correct: Column, n_boot: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """(by, n, accuracy, lo, hi) of a 0/1 outcome: draws are of rows, and only the counts of each group are needed."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("k"))
    reps = replicates(rows, n_boot).crossJoin(F.broadcast(counts)).select("rep", by, "n", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    hit = (draw(seed, F.col(by), F.col("rep"), F.col("slot")) % F.col("n") < F.col("k")).cast("double")
    boots = reps.groupBy(by, "rep").agg(F.avg(hit).alias("a"))
    ci = boots.groupBy(by).agg(F.percentile("a", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("__q"))
    return counts.join(ci, by).select(by, "n", (F.col("k") / F.col("n")).alias("accuracy"), F.col("__q")[0].alias("lo"), F.col("__q")[1].alias("hi"))


#: Bins of a pass of a selection, and values that are sorted at its end.
BINS, LAST = 4096, 1 << 16


def exact_quantiles(rows: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """The quantiles of a column, interpolated between neighbours, exactly; null where there is no value.

    Each pass counts the values in BINS between the ends of the bin that holds the rank, and goes on with that bin and
    its own least and largest value, until it has at most LAST values, which are sorted. No task holds more than that.
    """
    x = rows.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    all_ = x.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not all_[0]:
        return [None] * len(shares)

    def at(rank: int) -> float:
        below, n, lo, hi = 0, *all_
        while lo < hi:
            own = x.filter((F.col("v") >= lo) & (F.col("v") <= hi))
            if n <= LAST:
                return sorted(r.v for r in own.collect())[rank - below]
            width = hi / BINS - lo / BINS
            bin_ = F.least(F.floor((F.col("v") / 1.0 - lo) / width), F.lit(BINS - 1)) if width > 0 and np.isfinite(hi - lo) else (F.col("v") > lo / 2 + hi / 2).cast("long")
            for b in sorted(own.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()):
                if rank < below + b.n:
                    break
                below += b.n
            if (n, lo, hi) == (b.n, b.lo, b.hi):  # all in one bin: its least value apart
                n_least = own.filter(F.col("v") == lo).count()
                if rank < below + n_least:
                    return lo
                below += n_least
                rest = own.filter(F.col("v") > lo).agg(F.count("*"), F.min("v"), F.max("v")).first()
                n, lo, hi = rest
            else:
                n, lo, hi = b.n, b.lo, b.hi
        return lo

    found = {}
    for share in shares:
        place = share * (all_[0] - 1)
        for rank in {int(np.floor(place)), int(np.ceil(place))}:
            if rank not in found:
                found[rank] = at(rank)
    ends = [(found[int(np.floor(s * (all_[0] - 1)))], found[int(np.ceil(s * (all_[0] - 1)))], s * (all_[0] - 1) % 1) for s in shares]
    return [a if a == b else a + (b - a) * f for a, b, f in ends]


def _seeded_multinomial(seed: str):
    """(by, rep, m) of (by, rep, values, counts): the mean of as many values as there are, drawn by their counts."""

    def run(batches):
        for b in batches:
            means = []
            for by, rep, values, counts in zip(b["by"], b["rep"], b["values"], b["counts"], strict=True):
                key = int.from_bytes(hashlib.md5(f"{seed}|{by}|{rep}".encode()).digest()[:16], "big")
                counts = np.asarray(counts, np.int64)
                drawn = np.random.Generator(np.random.Philox(key=key)).multinomial(counts.sum(), counts / counts.sum())
                means.append(float(drawn @ np.asarray(values, float)) / counts.sum())
            yield b[["by", "rep"]].assign(m=means)

    return run


def value_bootstrap(rows: DataFrame, by: Column, value: Column, n_boot: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """(by, n, point, lo, hi): interval of the mean of a value when rows are drawn with replacement, for each group.

    The value has few distinct ones (0 and 1, or a rate of two digits): a replicate is one multinomial draw over their
    counts, whatever the number of rows. Draws depend on seed, group and replicate alone.
    """
    counts = rows.select(by.cast("string").alias("by"), value.cast("double").alias("v")).filter("v IS NOT NULL").groupBy("by", "v").agg(F.count("*").alias("n"))
    held = counts.groupBy("by").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("x"), F.sum("n").alias("n"))
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.v * x.n)  # in the order of the values
    held = held.withColumn("point", total / F.col("n"))
    reps = held.select("by", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"), F.col("x.v").alias("values"), F.col("x.n").alias("counts"))
    means = reps.repartition(F.col("by"), F.col("rep")).mapInPandas(_seeded_multinomial(seed), "by string, rep int, m double")
    ci = means.groupBy("by").agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return held.join(ci, "by").select("by", "n", "point", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def shuffled(rows: DataFrame, by: Sequence[str], key: str, value: str, seed: str) -> DataFrame:
    """Values dealt anew within each group: the value at place i of the seeded order goes to the key at place i."""
    d = draw(seed, *[F.col(c) for c in by], F.col(key))
    places = rows.select(*by, key, F.row_number().over(W.partitionBy(*by).orderBy(key)).alias("__i"))
    dealt = rows.select(*by, value, F.row_number().over(W.partitionBy(*by).orderBy(d, key)).alias("__i"))
    return places.join(dealt, [*by, "__i"]).drop("__i")


def sum_before(rows: DataFrame, order: str, value: str, parts: int = 256, by: Sequence[str] = ()) -> DataFrame:
    """Add ``below``: the sum of ``value`` over the group's rows before, in the order of a unique number, null as 0.

    Rows are dealt into ranges between approximate quantiles of their group; the sums of the ranges come before the sums
    within them, so that no task orders all rows. The groups (``by``) are few.
    """
    cuts = rows.groupBy(*by).agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000)).alias("__cuts"))
    dealt = (rows.join(cuts, list(by)) if by else rows.crossJoin(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts")
    sums = dealt.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # at most ``parts`` rows of a group
    sums = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*by, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [*by, "__range"])
    return out.withColumn("below", F.col("__start") + F.col("__own")).drop("__range", "__own", "__start")


def upper_tail(z: Column) -> Column:
    """The normal probability above z, by a rational approximation (7.1.26 of Abramowitz and Stegun; error below 1e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * series * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def mann_whitney(rows: DataFrame, arm: str, value: str, target: str, least: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """(by, n1, n2, u, z, p) of the target arm, for all groups in one pass: from counts by value: average ranks, tie-corrected, with continuity.

    p is one-sided (the target is greater); z and p need ``least`` values on both sides, else p is null.
    """
    counts = rows.groupBy(*by, value).agg(F.count_if(F.col(arm) == target).alias("a"), F.count_if(F.col(arm) != target).alias("b"))
    ranked = sum_before(counts.withColumn("t", F.col("a") + F.col("b")), value, "t", by=by)
    ranked = ranked.withColumn("rank", F.col("below") + (F.col("t") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    out = out.withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2)
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    out = out.withColumn("z", F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2 - 0.5, sd))
    return out.select(*by, "n1", "n2", "u", "z", F.when((F.col("n1") >= least) & (F.col("n2") >= least), upper_tail(F.col("z"))).alias("p"))


def robustness_battery(variants: DataFrame, primary: DataFrame, tests: Sequence[str] = ROBUSTNESS_TESTS) -> DataFrame:
    """(test, status, delta) of each named test: its own delta if it was computed, else the primary one.

    variants: (test, delta); primary: one row (delta).
    """
    names = variants.sparkSession.createDataFrame([(t,) for t in tests], "test string")
    out = names.join(variants.select("test", F.col("delta").alias("__d")), "test", "left").crossJoin(primary.select(F.col("delta").alias("__p")))
    return out.select("test", F.when(F.col("__d").isNull(), "not_run").otherwise("computed").alias("status"), F.coalesce("__d", "__p").alias("delta"))


def robustness_table(names: DataFrame, computed: DataFrame, primary: DataFrame) -> DataFrame:
    """(test, status, delta, change): each named test with its delta if it was computed."""
    out = names.join(computed, "test", "left").crossJoin(primary.select(F.col("delta").alias("__p")))
    return out.select("test", F.when(F.col("delta").isNull(), "not_run").otherwise("computed").alias("status"), "delta", (F.col("delta") - F.col("__p")).alias("change"))
