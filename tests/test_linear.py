"""Hashed linear classifiers: folds fitted together equal folds fitted alone; minima; held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import linear as LN
from corpuslab.operators.linear import fit_folds, fold_summary, hashed_terms, leave_group_out_linear, predict_folds


def rows(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    words = {"a": "red green blue amber".split(), "b": "one two three four".split(), "c": "cat dog cow hen".split()}
    data = []
    for i in range(n):
        label = "abc"[i % 3]
        own = [str(rng.choice(words[label])) if rng.random() < 0.5 else f"w{rng.integers(40)}" for _ in range(12)]
        data.append((i, label, f"g{i % 7}", " ".join(own)))
    data += [(900, "a", "alone", "red blue"), (901, None, "g1", "red"), (902, "b", None, "one"), (903, "b", "g2", None), (904, "c", "g3", "")]
    return spark.createDataFrame(data, "key long, label string, fold string, text string")


def test_folds_together_and_alone(spark):
    slots = hashed_terms(rows(spark)).filter("label IS NOT NULL AND fold IS NOT NULL").cache()
    both = fit_folds(slots, ["g1", "g4"])
    for i, f in enumerate(("g1", "g4")):
        alone = fit_folds(slots, [f])
        assert np.allclose(both.weights[i], alone.weights[0], atol=1e-6) and np.allclose(both.idf[i], alone.idf[0])
        # a fold does not depend on the rows that it leaves out
        without = fit_folds(slots.filter(F.col("fold") != f), [f])
        assert np.allclose(alone.idf, without.idf)
    assert fit_folds(slots, [None]).weights.shape == (1, 3, LN.WIDTH)


@pytest.mark.parametrize("part", [1024, 16])
def test_held_out_groups(spark, monkeypatch, part):
    monkeypatch.setattr(LN, "PART_ROWS", part)  # the second averages over many parts, in a tree of two levels
    monkeypatch.setattr(LN, "FAN", 4)
    monkeypatch.setattr(LN, "FOLDS", 3)
    got = leave_group_out_linear(rows(spark))
    found = got.collect()
    assert {r.fold for r in found} == {f"g{i}" for i in range(7)} and len(found) == 122  # "alone" has one row
    assert np.mean([r.truth == r.predicted for r in found]) > 0.85
    s = fold_summary(got).first()
    assert s.n_folds == 7 and 0.8 < s.mean_top1 <= 1 and 0.8 < s.mean_macro_f1 <= 1
    assert leave_group_out_linear(rows(spark), least_train=10_000).count() == leave_group_out_linear(rows(spark).limit(0)).count() == 0


def test_one_model(spark):
    slots = hashed_terms(rows(spark, 150, 1), bigrams=False)
    model = fit_folds(slots.filter("key < 100"), [None])
    found = predict_folds(model, slots.filter("key >= 100 AND key < 900"), [None]).collect()
    assert len(found) == 50 and np.mean([r.truth == r.predicted for r in found]) > 0.85
