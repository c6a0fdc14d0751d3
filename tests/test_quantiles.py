"""Exact quantiles by selection, and numbers by ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import stats as I


@pytest.mark.parametrize(
    "values",
    [
        [3.0], [2.0, 2.0, 2.0], [None, float("nan"), 1.0, 4.0], list(map(float, range(500))), [5.0] * 300 + [7.0] * 2,
        [10.0**k for k in range(-300, 300, 3)] + [-(10.0**k) for k in range(-300, 300, 7)], [random.Random(1).gauss(0, 1) for _ in range(400)],
        [1.0] + [1e300] * 20 + [-1.7e308, 1.7e308], [0.0, 5e-324, 1e-323] * 9, [1.0, 1.0 + 2**-52] * 30,
    ],
)
def test_exact_quantiles(spark, monkeypatch, values):
    monkeypatch.setattr(I, "BINS", 8)
    monkeypatch.setattr(I, "LAST", 4)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    real = sorted(v for v in values if v is not None and v == v)
    for share, got in zip((0, 0.3, 0.95, 1), I.exact_quantiles(df, "v", [0, 0.3, 0.95, 1]), strict=True):
        place = share * (len(real) - 1)
        a, b = real[int(np.floor(place))], real[int(np.ceil(place))]
        assert got == pytest.approx(a if a == b else a + (b - a) * (place % 1), rel=1e-12)
    assert I.exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_numbers_by_ranges(spark):
    df = spark.range(1000).select(F.col("id").alias("cluster"), F.md5(F.col("id").cast("string")).alias("arm")).repartition(7)
    got = [r.i for r in I.numbered(df, "arm", "cluster").orderBy("arm", "cluster").collect()]
    assert got == list(range(1000)) and I.numbered(df.limit(0), "arm", "cluster").count() == 0
