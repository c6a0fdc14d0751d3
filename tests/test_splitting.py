"""Split resampling: exact totals, distributions, and p by enumeration on small tables."""

import itertools

import numpy as np
import pytest

from corpuslab.operators import splitting as SP
from corpuslab.operators.splitting import bucket_counts, resampled_sums, split_bootstrap_ci, split_draws, split_permutation, split_variance_ci


def counts(sizes, draws, seed, replace, reps):
    out = []
    for b, k in enumerate(sizes):
        own = split_draws(np.array(sizes), b, np.full(reps, draws), seed, replace)
        if k:
            out.append(np.concatenate([c for _, _, c in bucket_counts(k, own, b, seed, replace)]))
        else:
            assert not own.any()
    return np.concatenate(out, axis=1)


@pytest.mark.parametrize("sizes", [[7], [3, 0, 5, 2], [0, 0, 4, 0, 1, 1, 0, 6]])
def test_counts_are_multinomial(monkeypatch, sizes):
    monkeypatch.setattr(SP, "DRAWN", 1000)
    k = sum(sizes)
    n = counts(sizes, k, "s", True, 20_000)
    assert (n.sum(1) == k).all() and (n >= 0).all()
    p = 1 / k
    cov = np.cov(n.T)
    assert abs(n.mean(0) - 1).max() < 0.05 and abs(np.diag(cov) - k * p * (1 - p)).max() < 0.05
    assert abs(cov[~np.eye(k, dtype=bool)] + k * p * p).max() < 0.05
    assert abs((n == 0).mean(0) - (1 - p) ** k).max() < 0.02
    assert not (counts(sizes, k, "t", True, 50) == n[:50]).all() and (counts(sizes, k, "s", True, 20_000) == n).all()


@pytest.mark.parametrize("sizes", [[6], [3, 0, 2, 1]])
def test_subsets_are_equally_likely(sizes):
    n = counts(sizes, 2, "s", False, 30_000)
    assert (n.sum(1) == 2).all() and n.max() == 1
    freq = {s: 0 for s in itertools.combinations(range(6), 2)}
    for row in n:
        freq[tuple(np.flatnonzero(row))] += 1
    assert max(abs(f / 30_000 - 1 / 15) for f in freq.values()) < 0.01


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(1)
    rows = [("target" if i < 4 else "control", f"c{i}", 10 + i, float(rng.normal(12 if i < 4 else 10, 2) * (10 + i))) for i in range(9)]
    return rows, spark.createDataFrame(rows, "arm string, cluster string, n long, total double")


def test_p_by_enumeration(clusters):
    rows, df = clusters
    m = np.array([t / n for _, _, n, t in rows])
    delta = lambda s: m[list(s)].mean() - np.delete(m, list(s)).mean()
    seen = delta(range(4))
    every = [delta(s) for s in itertools.combinations(range(9), 4)]
    for two in (True, False):
        want = np.mean([(abs(d) >= abs(seen) - 1e-12) if two else (d >= seen - 1e-12) for d in every])
        got = split_permutation(df, "target", "control", 20_000, "p", two, 0).first()
        assert got.observed == pytest.approx(seen) and abs(got.p - want) < 0.012
    assert split_permutation(df.filter("arm = 'target'"), "target", "control", 20, "p").first().p is None


def test_intervals_and_buckets(spark, clusters, monkeypatch):
    rows, df = clusters
    n, t = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    rng = np.random.default_rng(0)
    boots = np.array([t[i].sum() / n[i].sum() for i in rng.integers(0, 9, (20_000, 9))])
    for bucket in (4096, 2):  # one bucket, and some, a few of them empty
        monkeypatch.setattr(SP, "BUCKET", bucket)
        got = split_bootstrap_ci(df.repartition(3), 20_000, "b").first()
        assert got.n_boot == 20_000 and got.point == pytest.approx(t.sum() / n.sum())
        assert abs(got.lo - np.quantile(boots, 0.025)) < 0.06 and abs(got.hi - np.quantile(boots, 0.975)) < 0.06
        a = resampled_sums(df, ["arm", "cluster"], ["n"], 30, "x").orderBy("rep").collect()
        assert [r.drawn for r in a] == [9] * 30 and a == resampled_sums(df.repartition(5), ["arm", "cluster"], ["n"], 30, "x").orderBy("rep").collect()
    assert resampled_sums(df.limit(0), ["arm", "cluster"], ["n"], 5, "x").count() == 0


def test_variance_intervals(spark):
    rng = np.random.default_rng(3)
    m, v = rng.normal(5, 1, 12), rng.uniform(1, 2, 12)
    df = spark.createDataFrame([(f"c{i}", float(a), float(b) if i else None) for i, (a, b) in enumerate(zip(m, v, strict=True))], "cluster string, m double, v double")
    v[0] = np.nan
    draws = np.random.default_rng(0).integers(0, 12, (8000, 12))
    between = [m[np.unique(d)].std(ddof=1) for d in draws]
    within = [np.sqrt(np.nanmean(v[d])) for d in draws]
    got = split_variance_ci(df, 8000, "v").first()
    want = [np.quantile(x, q) for x in (between, within) for q in (0.025, 0.975)]
    assert np.abs(np.array(got) - want).max() < 0.04
