"""What a query does grows with its input: each of these took the square, or a row for each pair, before."""

import itertools
import random
import time

import numpy as np
from pyspark.sql import Row

import __spark_entry__ as entry
from corpuslab.operators import graph as G
from corpuslab.operators import linear as Ln
from corpuslab.operators import score as X
from corpuslab.operators import setjoin as SJ


def documents(spark, folder, rows):
    """A folder with documents of (doc_id, lang, source, text), for a query."""
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_records_of_a_long_text(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "en", "s", "x" * 120_000), (2, "en", "s", "one | two. And three. A four| B | five. Bye")])
    start = time.time()
    got = sorted(entry.queries()["parse_records"](spark, d).collect())
    assert time.time() - start < 10
    assert got == [Row(passage_id=2, record_id="A", body="three"), Row(passage_id=2, record_id="B", body="five")]


def test_a_pair_meets_by_some_group_of_items():
    for t in (0.9, 0.6, 0.5, 2 / 7, 0.2):
        for a, b in itertools.product(range(1, 10), repeat=2):
            x = list(range(a))
            for shared in range(1, min(a, b) + 1):
                y = x[a - shared :] + list(range(100, 100 + b - shared))  # the last items: the prefixes just reach
                if shared / (a + b - shared) >= t - 1e-9:
                    groups = lambda s, size: {(other, tuple(g)) for other, found in SJ._shared(len(s), s, t, 64) for g in found if other == size}
                    assert {g for _, g in groups(x, b)} & {g for _, g in groups(y, a)}
    assert all(len(p) == 4 for p in SJ._picks(7, 7, 0.6))  # not by one item, which nearly all share


def test_copies_are_their_own_nearest(spark, monkeypatch):
    rows = spark.createDataFrame([(10 * i + j, x) for i, x in enumerate("abc") for j in range(5)], "graph_id long, item string")
    classes, members = SJ.set_classes(rows, "graph_id", ["item"])
    asked, join = [], SJ.similar_classes
    monkeypatch.setattr(SJ, "similar_classes", lambda left, *more, **named: asked.append(left.count()) or join(left, *more, **named))
    got = sorted(map(tuple, SJ.nearest_sets(classes, members, "graph_id", 2).collect()))
    assert got[:4] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (1, 1, 0, 1.0), (1, 2, 2, 1.0)] and len(got) == 30
    assert not any(asked)


def test_small_graphs_are_shuffled_once(spark):
    rng = random.Random(3)
    nodes = [(g, f"n{i}", rng.choice(["x", "y", None])) for g in range(20) for i in range(4)]
    edges = sorted({(g, f"n{rng.randrange(5)}", rng.choice(["n1", "n2", None]), rng.choice("kl")) for g in range(22) for _ in range(6)}, key=str)
    n = spark.createDataFrame(nodes, "graph_id long, id string, kind string").repartition(3, "graph_id")
    e = spark.createDataFrame(edges, "graph_id long, source string, target string, kind string").repartition(3, "graph_id")
    got = G.typed_multiset_small(e, n)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, G.typed_multiset(e, n).select(got.columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM")


def test_templates_meet_without_a_join_of_relations(spark):
    d = "/root/testdata/sf0.001"
    plan = lambda q: entry.queries()[q](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(least(" not in plan("typed_similarity") and "array_union" not in plan("graph_overlap")


def test_steps_of_all_folds():
    """The steps give what they gave when each slot's weights lay apart, in less time."""
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, Ln.WIDTH, 400), int(rng.integers(4)), int(rng.integers(-1, 16))) for _ in range(60)]
    idf, start = 1 + rng.random((16, Ln.WIDTH)), np.zeros((16, 4, Ln.WIDTH))

    def apart(rows, idf, weights, passes):
        w, steps, lag = weights.copy(), 0, np.zeros_like(weights)
        prepared = [(*Ln._row(slots, idf), y, out) for slots, y, out in rows]
        sign = -np.ones((4, 4)) + 2 * np.eye(4)
        for _ in range(passes):
            for own, x, y, out in prepared:
                part = w[:, :, own]
                loss = np.maximum(0, 1 - sign[y] * np.einsum("fcs,fs->fc", part, x))
                if out >= 0:
                    loss[out] = 0
                change = (np.minimum(1, loss) * sign[y])[:, :, None] * x[:, None, :]
                w[:, :, own] = part + change
                lag[:, :, own] += steps * change
                steps += 1
        return w - lag / steps

    times = []
    for f in (apart, Ln.fit_part):
        best = []
        for _ in range(3):
            at = time.process_time()
            got = f(rows, idf, start, 3)
            best.append(time.process_time() - at)
        times.append((min(best), got))
    assert np.allclose(times[0][1], times[1][1], atol=1e-4)
    assert times[1][0] < 0.75 * times[0][0]


def test_frequent_words_are_drawn_once():
    """Between ever new words, the words of all texts are not drawn again; each vector is the word's own."""
    drawn = []
    draw = X.token_vectors(8, "s")
    held = X.Remembered(lambda t: drawn.append(t) or draw(t), 8, 64)
    for i in range(50):
        words = ["the", "of"] + [f"w{i}.{j}" for j in range(20)]
        assert np.array_equal(held.rows(words), np.stack([X.token_vector(w, 8, "s") for w in words]))
    assert drawn.count("the") == drawn.count("of") == 1 and len(drawn) == 2 + 50 * 20


def test_vectors_of_labelled_texts_only(spark):
    """The labels meet the texts, not 256 rows of each vector."""
    plan = entry.queries()["random_projection_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("MapInArrow") < plan.index("Join Inner")
