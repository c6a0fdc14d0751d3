"""Connected components by contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b), whole numbers: label is the smallest node it is connected to.

    Each round, every node points to the smallest of itself and its neighbours; pointers are followed to their roots
    by doubling, and the edges between roots go on to the next round. At least half of the connected roots go in a
    round, so rounds are logarithmic in the nodes, as are the doublings within one.
    """
    spark, held = edges.sparkSession, []
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    live = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), held)
    labels = None
    while not live.isEmpty():
        parent = live.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("node"), F.least("a", "up").alias("up"))
        parent = materialize(parent, held)
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialize(parent.join(above, "up").selectExpr("node", "top AS up", "top <> up AS moved"), held)
            parent = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("node", F.col("up").alias("label"))
        else:
            step = parent.select(F.col("node").alias("label"), F.col("up").alias("next"))
            labels = labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        labels = materialize(labels, held)
        roots = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        live = live.join(roots, "a").join(roots.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        live = materialize(live.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), held)
    if labels is None:
        labels = spark.createDataFrame([], "node long, label long")
    labels = materialize(labels)
    release(spark, held)
    return labels
