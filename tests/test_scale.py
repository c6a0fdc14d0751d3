"""Steps whose cost must not grow faster than their input: their bounds, and results as before."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import discover as D
from corpuslab.operators import graph as G
from corpuslab.operators import learn as L


@pytest.mark.parametrize("kind", ["svc", "logreg"])
def test_text_classifier_has_a_size_of_its_own(spark, monkeypatch, kind):
    monkeypatch.setattr(L, "SLOTS", 256)
    rows = spark.createDataFrame([(f"{'red green' if i % 2 else 'one two'} own{i} word{i * 7}", "ab"[i % 2]) for i in range(400)], "text string, label string")
    model = L.text_classifier(rows, kind, bigrams=True)  # more than 2000 terms
    assert {r.features.size for r in model.transform(rows).select("features").limit(5).collect()} == {256}
    found = L.predict(model, rows.withColumn("key", F.lit(1)), "key").collect()
    assert sum(r.truth == r.predicted for r in found) > 380


def test_owners_are_counted_by_signature(spark):
    rng = random.Random(3)
    items = [(i, sorted(rng.sample("abcde", rng.choice((2, 3))))) for i in range(200)]
    df = spark.createDataFrame(items, "passage_id long, signature array<string>")
    meta = df.select("passage_id", F.when(F.col("passage_id") % 7 != 0, (F.col("passage_id") % 3).cast("string")).alias("work"), *[F.when(F.col("passage_id") % 5 != 0, F.col("passage_id") % 13 + k).alias(c) for k, c in enumerate(("date_lo", "date_hi"))])
    sets = D.frequent_sets(df, "passage_id", 3)
    held = {tuple(s.signature): [i for i, own in items if set(s.signature) <= set(own)] for s in sets.collect()}
    counts = D.owner_counts(sets, df, meta, "passage_id", "work")
    assert {(tuple(r.signature), r.work): r.n for r in counts.collect()} == {(s, w): n for s, ids in held.items() for w, n in Counter(str(i % 3) if i % 7 else None for i in ids).items()}
    mid = lambda i: i % 13 + 0.5 if i % 5 else None
    dated = {s: sorted(mid(i) for i in ids if i % 5) for s, ids in held.items()}
    for r in D.motif_dates(sets, df, meta).collect():
        ms = dated[tuple(r.signature)]
        assert (r.n_dated, r.earliest, r.latest, r.middle) == (len(ms), ms[0], ms[-1], ms[len(ms) // 2])
    for r in D.motif_ranges(sets, df, meta, 4).collect():
        assert [x[0] + 0.5 for x in r.ranges] == [mid(i) for i in held[tuple(r.signature)] if i % 5][:4]


def test_alignment_once_for_each_class(spark, monkeypatch):
    rng = random.Random(5)
    nodes = [(g, f"n{i}", rng.choice("xy")) for g in range(40) for i in range(rng.randint(1, 4))]
    edges = [(g, f"n{rng.randrange(4)}", f"n{rng.randrange(4)}", rng.choice("AB")) for g in range(40) for _ in range(3)]
    nodes += [(g + 100, i, k) for g, i, k in nodes]  # a copy of each graph
    edges += [(g + 100, s, t, k) for g, s, t, k in edges]
    p = G.node_profiles(spark.createDataFrame(nodes, "graph_id long, id string, kind string"), spark.createDataFrame(edges, "graph_id long, source string, target string, kind string")).cache()
    right = p.filter("graph_id < 5")
    assert G.profile_classes(p)[0].count() <= 40
    want = {(r.a, r.b): round(r.alignment, 9) for r in G.alignment(G.node_distances(p, right)).collect()}
    assert {(r.a, r.b): round(r.alignment, 9) for r in G.profile_alignment(p, right).collect()} == want and len(want) == 400


def test_atlas_names_the_motifs(spark):
    """Which motifs a group has alone, which with others, and in what themes: not their numbers alone."""
    owned = {("E:e", "N:matter"): {"x": 2, "y": 1}, ("N:observer", "N:p"): {"x": 3}, ("N:p", "N:q"): {None: 4}, ("E:pervades", "N:space"): {"y": 5, None: 1}}
    family = {("E:e", "N:matter"): "classical", ("E:pervades", "N:space"): "field_like"}
    themes = {("E:e", "N:matter"): ["atomistic", "relational"], ("N:observer", "N:p"): ["observer"], ("E:pervades", "N:space"): ["field_like", "relational"]}
    motifs = spark.createDataFrame([(list(s), family.get(s, "unrelated")) for s in owned], "signature array<string>, family string")
    counts = spark.createDataFrame([(list(s), g, n) for s, of in owned.items() for g, n in of.items()], "signature array<string>, tradition string, n long")
    got = {(r.tradition, tuple(r.signature)): tuple(r)[2:] for r in D.atlas(motifs, counts, "tradition").collect()}
    want = {}
    for s, of in owned.items():
        for g, n in of.items():
            own = [t for t, x in owned.items() if g in x]
            alone = sum(len(owned[t]) == 1 for t in own)
            want[g, s] = (n, len(of), "unique" if len(of) == 1 else "shared", themes.get(s, []), len(own), alone, len(own) - alone)
    assert got == want
