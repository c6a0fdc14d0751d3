"""Small cases with known answers."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.dims import FEATURE_GRAPH
from corpuslab.functions import text as T
from corpuslab.operators import annotate as A
from corpuslab.operators import audit, discover, graph, learn, passages, score, segments, select, stats
from corpuslab.plans.pipeline import score_passages
from corpuslab.sources import io
from corpuslab.streaming.screen import screen


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "passage_id long, text string")


def test_nulls_are_in_neither_sum(spark):
    v = spark.createDataFrame([(1, "A", 1.0), (1, "B", None), (1, "C", 0.0)], "passage_id long, feature_id string, value double")
    fp = spark.createDataFrame([("T", f, 1, 1.0) for f in "ABC"], "theory_id string, feature_id string, t int, w double")
    assert one(score.theory_scores(v, fp)).score == 0.5


def test_binary_jaccard(spark):
    fp = spark.createDataFrame([("x", "a", 1), ("x", "b", 0), ("y", "a", 1), ("y", "b", 1)], "theory_id string, feature_id string, t int")
    assert one(score.binary_pairs(fp)).jaccard == 0.5


CUES = [A.Cue("Q06", "cannot be (written|represented) as independent component"), A.Cue("Q06", "everything is (one|interconnected)|all is one", False)]


def test_unity_is_not_nonseparability(spark):
    rows = texts(spark, "Everything is one. All things are interconnected.", "The joint state cannot be represented as independent component states. Then more.", "")
    got = {r.passage_id: r for r in A.annotate(rows, CUES).collect()}
    assert [got[i].label for i in range(3)] == ["0", "1", "NA"]
    assert got[1].evidence == "The joint state cannot be represented as independent component states"


def test_masking(spark):
    row = one(texts(spark, "Cosmic energy permeates the Field of vibration.").select(T.mask(F.col("text"), ["energy", "field", "vibration"]).alias("m"), T.neutralize(F.col("text"), {"energy": "principle", "field": "entity"}).alias("n")))
    assert row.m.count("[MASKED]") == 3
    assert row.n == "Cosmic principle permeates the Entity of vibration."
    again = one(spark.createDataFrame([(row.m,)], "text string").select(T.mask(F.col("text"), ["energy", "field"]).alias("m")))
    assert again.m == row.m


def test_mean_difference_and_fdr(spark):
    rows = spark.createDataFrame([("t", 1.0), ("t", 1.0), ("c", 0.0), ("c", 0.0)], "arm string, v double")
    assert one(stats.mean_difference(rows, "arm", "v", "t", "c")).delta == 1.0
    p = spark.createDataFrame([("a", 0.001), ("b", 0.01), ("c", 0.2), ("d", 0.5)], "test string, p double")
    got = {r.test: r.reject for r in stats.bh_fdr(p, "p", "test", 0.05).collect()}
    assert got["a"] and not got["d"]


def test_enrichment_is_three(spark):
    counts = spark.createDataFrame([(["x", "y"], "t", 3), (["x", "y"], "c", 1)], "signature array<string>, tradition string, n long")
    totals = spark.createDataFrame([("t", 10), ("c", 10)], "tradition string, n long")
    row = one(discover.enrichment(counts, totals, ["t"], ["c"], "tradition"))
    assert row.enrichment == pytest.approx(3.0) and row.lo < 3 < row.hi


def test_contamination(spark):
    rows = passages.anachronism_rows(texts(spark, "electrons orbit", "the self is immortal").withColumn("tradition", F.lit("x")))
    row = one(audit.contamination_summary(rows, "tradition"))
    assert (row.n, row.n_contaminated, row.terms) == (2, 1, ["electron=1"])


def test_frequent_sets_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, sorted(rng.sample("abcdef", rng.randint(0, 5)))) for i in range(40)]
    rows = spark.createDataFrame(data, "passage_id long, signature array<string>")
    got = {tuple(r.signature): r.support for r in discover.frequent_sets(rows, "passage_id", 3, 4, longer=False).collect()}
    want = {}
    for _, items in data:
        for k in (2, 3, 4):
            for c in itertools.combinations(items, k):
                want[c] = want.get(c, 0) + 1
    assert got == {c: n for c, n in want.items() if n >= 3}


def test_owners_and_replication_against_brute_force(spark):
    rng = random.Random(4)
    data = [(i, sorted(rng.sample("abcdef", rng.randint(0, 5)))) for i in range(60)]
    sets = [list(c) for k in (1, 2, 3) for c in itertools.combinations("abcdefg", k)]
    rows, motifs = spark.createDataFrame(data, "passage_id long, signature array<string>"), spark.createDataFrame([(x, 1) for x in sets], "signature array<string>, support long")
    got = {(tuple(r.signature), r.passage_id) for r in discover.owners(motifs, rows, "passage_id").collect()}
    assert got == {(tuple(x), i) for x in sets for i, own in data if set(x) <= set(own)}
    got = {tuple(r.signature): (r.exact, r.recovered) for r in discover.replication(motifs, rows).collect()}
    assert got == {tuple(x): (any(own == x for _, own in data), any(set(x) <= set(own) for _, own in data)) for x in sets}


def test_whole_motifs_lose_no_frequent_set(spark, monkeypatch):
    from corpuslab.plans import discover_queries as Q

    long, data = list("abcdefgh"), [(i, list("abcdefgh")) for i in range(3)] + [(i, list("abcde")) for i in range(3, 7)]
    want = {c: 7 if set(c) <= set("abcde") else 3 for k in range(2, 7) for c in itertools.combinations(long, k)} | {tuple(long): 3}
    rows = spark.createDataFrame(data, "passage_id long, signature array<string>")
    monkeypatch.setattr(Q, "_sig", lambda *_: rows)
    assert {tuple(r.signature): r.support for r in Q.QUERIES["motif_mining"](spark, "").collect()} == want
    features = rows.withColumnRenamed("signature", "f").select("passage_id", F.explode("f").alias("feature_id"))
    monkeypatch.setattr(Q, "_pos", lambda *_: features)
    got = {tuple(r.signature): r.support for r in Q.QUERIES["feature_combos"](spark, "").collect()}
    assert got == {c: n for c, n in want.items() if len(c) <= 4}


def test_feature_graph(spark):
    pos = spark.createDataFrame([(1, "F01", "it pervades all"), (1, "O01", "")], "passage_id long, feature_id string, evidence string")
    assert {r.node_type for r in graph.feature_nodes(pos).collect()} == {"substrate", "space"}
    assert one(graph.feature_edges(pos)).edge_type == "pervades"
    assert FEATURE_GRAPH["F01"][1][1] == "pervades"


def nodes_edges(spark, graphs):
    nodes = [(g, i, k) for g, (ns, _) in graphs.items() for i, k in ns]
    edges = [(g, *e) for g, (_, es) in graphs.items() for e in es]
    return spark.createDataFrame(nodes, "graph_id string, id string, kind string"), spark.createDataFrame(edges, "graph_id string, source string, target string, kind string")


def test_renamed_graphs_are_alike_and_size_costs(spark):
    small = ([("1", "A"), ("2", "B")], [("1", "2", "E")])
    renamed = ([("x", "A"), ("y", "B")], [("x", "y", "E")])
    large = (renamed[0] + [(f"z{i}", "C") for i in range(18)], renamed[1])
    n, e = nodes_edges(spark, {"s": small, "r": renamed, "l": large})
    m = graph.typed_multiset(e, n)
    sizes = n.groupBy("graph_id").agg(F.count("*").alias("n_nodes")).join(e.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id")
    got = {(r.a, r.b): r for r in graph.typed_similarity(m, m, sizes, sizes).collect()}
    assert got["s", "r"].adjusted == 1.0 and got["s", "l"].raw == 1.0 and got["s", "l"].adjusted < 0.2
    p = graph.node_profiles(n, e)
    al = {(r.a, r.b): r.alignment for r in graph.alignment(graph.node_distances(p, p)).collect()}
    assert al["s", "r"] == 1.0 and al["s", "l"] < 0.25


def test_assignment_against_brute_force():
    rng = np.random.default_rng(1)
    for n in range(1, 6):
        for _ in range(20):
            cost = rng.integers(0, 9, (n, n)).astype(float)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            got = graph.assignment(cost)
            assert sorted(got) == list(range(n)) and sum(cost[i, got[i]] for i in range(n)) == best


def test_packs_against_a_loop(spark):
    rng = random.Random(5)
    said = [" ".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 30))) + rng.choice(".!?") for _ in range(rng.randint(0, 12))) for _ in range(30)]
    got = {}
    for r in segments.pack_sentences(texts(spark, *said), 60, 40).orderBy("passage_id", "n").collect():
        got.setdefault(r.passage_id, []).append(r.pack)
    import re

    for i, t in enumerate(said):
        packs, buf, n = [], [], 0
        for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+", t.strip()) if x.strip()]:
            buf.append(s)
            n += len(s.split())
            if n >= 60:
                packs.append(" ".join(buf))
                buf, n = [], 0
        if n >= 40:
            packs.append(" ".join(buf))
        assert got.get(i, []) == packs


def test_propositions_have_ids_of_their_own(spark):
    n = 1011
    got = segments.propositions(texts(spark, " ".join(f"s{i} is said." for i in range(1, n + 1)))).collect()
    assert {r.proposition_id: r.sentence for r in got} == {f"0::P{i:03d}": f"s{i} is said." for i in range(1, n + 1)}


def test_carve_takes_whole_texts_by_the_rules(spark, tmp_path):
    import re

    from corpuslab.plans import text_queries

    rng = random.Random(7)
    tail = lambda: rng.choice([".", "!", "?", " JavaScript.", " mw-parser-output."])
    said = [" ".join(" ".join(rng.choice(["word", "longer", "a"]) for _ in range(rng.choice([3, 9, 30, 55, 230]))) + tail() for _ in range(200)) for _ in range(6)]
    said.append("\n\t" + " ".join(["word"] * 8) + "\n. " + " ".join(["word"] * 70) + ".")
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(said)], "doc_id long, text string, lang string, source string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in text_queries.QUERIES["carve_sentences"](spark, str(tmp_path)).orderBy("passage_id", "n").collect():
        got.setdefault(r.passage_id, []).append(r.pack)
    for i, t in enumerate(said):
        packs, buf, n = [], [], 0
        for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+", t) if len(x.strip()) > 40]:
            if any(x in s.lower() for x in ("mw-parser-output", ".wst-", "login-button", "javascript")):
                continue
            buf.append(s)
            n += len(s.split())
            if n >= 60:
                packs += [" ".join(buf)] if n <= 220 else []
                buf, n = [], 0
        assert got.get(i, []) == packs
    assert max(map(len, got.values())) > 8


def test_windows_reach_the_end_of_a_long_text(spark):
    got = segments.word_windows(texts(spark, " ".join(f"w{i}" for i in range(5000))), 120, 100, 40).orderBy("start").collect()
    assert [r.start for r in got] == list(range(0, 4961, 100))
    assert [r.window.split() for r in got] == [[f"w{i}" for i in range(s, min(s + 120, 5000))] for s in range(0, 4961, 100)]


def test_registered_forms_lose_nothing(spark, tmp_path):
    from corpuslab.plans import discover_queries, text_queries

    text = " ".join(discover_queries._LABELS) + " w" * 4993
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert text_queries.QUERIES["word_windows"](spark, str(tmp_path)).agg(F.max("start")).first()[0] == 4900
    got = discover_queries.QUERIES["lexical_proxy_graph"](spark, str(tmp_path)).orderBy("n").collect()
    labels = sorted(discover_queries._LABELS)
    assert [(r.label, r.next_label) for r in got] == list(zip(labels, labels[1:] + [None], strict=True))


def test_overlaps_of_splits(spark):
    rows = spark.createDataFrame([("A", "train"), ("A", "development"), ("B", "train")], "work string, split string")
    assert one(audit.overlaps(rows, "work")).key_value == "A"


def test_kappa_edges(spark):
    same = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert one(learn.cohens_kappa(same)).kappa == 1.0
    assert one(learn.cohens_kappa(same.limit(0))).kappa is None


def test_half_split_keeps_a_lone_work(spark):
    rows = spark.createDataFrame([("t", "a"), ("t", "b"), ("c", "b"), ("c", "c"), ("s", "z")], "role string, work string")
    got = {(r.role, r.work): r.split for r in select.half_split(rows).collect()}
    assert got["s", "z"] == "discovery" and got["t", "b"] == "discovery" == got["c", "b"] and got["c", "c"] == "replication"


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", float("nan"), "train"), (2, "b", 1.0, "confirmatory")], "passage_id long, text string, score double, dataset_split string")
    io.write_passages(rows, str(tmp_path / "p"))
    got = one(io.read_passages(spark, str(tmp_path / "p")))
    assert got.passage_id == 1 and got.score is None
    with pytest.raises(PermissionError):
        io.read_passages(spark, str(tmp_path / "confirmatory"))
    io.write_splits(rows.withColumnRenamed("dataset_split", "split"), str(tmp_path / "j"))
    assert io.read_split(spark, str(tmp_path / "j"), "train", rows.select("passage_id", "text").schema).count() == 1
    with pytest.raises(PermissionError):
        io.read_split(spark, str(tmp_path / "j"), "confirmatory", rows.schema)
    io.write_csv(rows, str(tmp_path / "c"))
    assert io.read_manifest(spark, str(tmp_path / "c")).count() == 2
    (tmp_path / "t.txt").write_bytes(b"ab\xffc\nd")
    assert one(io.read_whole_texts(spark, str(tmp_path / "t.txt"))).text == "abc\nd"
    admitted, refused = io.registry_admit(rows.filter("passage_id = 1"), rows, "passage_id")
    assert (one(admitted).passage_id, one(refused).passage_id) == (2, 1)


def test_pipeline_prefers_the_right_side(spark):
    fp = spark.createDataFrame([("QM", "Q06", 1, 1.0), ("CM", "Q06", 0, 1.0)], "theory_id string, feature_id string, t int, w double")
    out = score_passages(texts(spark, "It cannot be represented as independent component states.", "All is one."), cues=CUES, fingerprints=fp, quantum=["QM"], classical=["CM"], exclusive=["Q06"], fields=(["F01"], ["F07"], ["O01"]))
    got = {r.passage_id: r for r in out["passage_scores"].collect()}
    assert got["0"].qs > got["1"].qs and got["0"].qef == 1.0 and set(out) == {"annotations", "theory_scores", "passage_scores", "field_ontology"}


def test_stream_equals_batch(spark, tmp_path):
    rows = texts(spark, "electrons and quantum fields", "nothing here", None)
    rows.write.parquet(str(tmp_path / "in"))
    args = (("electron",), ("field",), (r"\bquantum\b",))
    stream = screen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), *args)
    query = stream.writeStream.format("memory").queryName("screened").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("screened")) == key(screen(rows, *args))


def test_order_and_partitioning_do_not_matter(spark):
    rows = texts(spark, *[f"text {i % 7} of source {i % 3}" for i in range(50)]).withColumn("work", (F.col("passage_id") % 3).cast("string"))
    a = select.seeded_sample(rows, ["work"], "passage_id", 4, "s")
    b = select.seeded_sample(rows.orderBy(F.desc("passage_id")).repartition(7), ["work"], "passage_id", 4, "s")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_cue_packs(spark):
    texts = [
        (1, "Everything is one. All things are interconnected."),
        (2, "Here the joint state cannot be represented as independent component states. So it is."),
        (3, "The first-beginnings fall through the void."),
        (4, "The absolute appears as many."),
    ]
    rows = spark.createDataFrame(texts, "passage_id long, text string")
    got = {(r.passage_id, r.feature_id): r for r in A.annotate(rows).collect()}
    assert len(got) == 4 * 36
    assert got[1, "Q06"].label == "0" and got[2, "Q06"].label == "1" and "cannot be represented" in got[2, "Q06"].evidence
    assert got[3, "O01"].label == "1" and got[3, "O04"].label == "1" and got[4, "O01"].label == "1" and got[4, "O05"].label == "1"
    base = {(r.passage_id, r.feature_id): r.label for r in A.annotate(rows, A.cue_packs(classical=False, metaphysical=False)).collect()}
    assert base[3, "O01"] == base[4, "O01"] == "NA" and base[2, "Q06"] == "1"
    assert len(A.cue_packs(base=False, metaphysical=False)) == 13 and not any(c.feature_id.startswith("Q") for c in A.cue_packs(base=False))


def test_dimension_readers(spark, tmp_path):
    def write(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / name)

    features = [{"id": f"X{i:02}", "name": "n", "family": "O", "level": "I", "quantum_specific": i == 0, "field_like": False} for i in range(30)]
    assert io.read_features(spark, write("f.json", features)).filter("quantum_specific").count() == 1
    for bad in (features[:29], features + features[:1], [{**features[0], "id": None}, *features[1:]]):
        with pytest.raises(ValueError):
            io.read_features(spark, write("bad.json", bad))
    path = write("t.json", [{"theory_id": "a", "classical": True, "features": {"X01": 1, "X02": 0}, "weights": {"X01": 2.0}}, {"theory_id": "b", "features": {"X01": 1}}])
    assert {tuple(r) for r in io.read_fingerprints(spark, path, ["a"]).collect()} == {("a", "X01", 1, 2.0, True, False), ("a", "X02", 0, 1.0, True, False)}
    with pytest.raises(ValueError):
        io.read_fingerprints(spark, path, ["a", "c"])
    assert io.read_claims(spark, write("c.json", [{"claim_id": "C1", "required_features": ["X01"], "quantum_features": []}])).first().required_features == ["X01"]
    assert io.read_vocabulary(spark, write("v.json", [{"term": "wave", "replacement": "x"}])).count() == 1
    (tmp_path / "m.csv").write_text("source_id,availability_status\na,available\nb,pointer\nc,available\n")
    assert {tuple(r) for r in io.manifest_by_availability(io.read_manifest(spark, str(tmp_path / "m.csv"))).collect()} == {("available", 2), ("pointer", 1)}


def test_value_bootstrap_is_a_bootstrap(spark):
    rows = spark.range(4000).selectExpr("id % 2 AS g", "id % 5 < 2 AS hit", "(id % 100) / 100 AS rate")
    for r in stats.value_bootstrap(rows, F.col("g"), F.col("hit"), 400, "s").collect():
        assert r.n == 2000 and abs(r.point - 0.4) < 1e-9
        sd = (0.4 * 0.6 / 2000) ** 0.5
        assert abs(r.lo - (0.4 - 1.96 * sd)) < 0.4 * sd and abs(r.hi - (0.4 + 1.96 * sd)) < 0.4 * sd
    again = stats.value_bootstrap(rows.repartition(7), F.col("g"), F.col("rate"), 400, "s").orderBy("by")
    assert again.collect() == stats.value_bootstrap(rows, F.col("g"), F.col("rate"), 400, "s").orderBy("by").collect()


def test_retrieval_scores(spark):
    typed = spark.createDataFrame([(1, 1, 1.0, 0.5), (1, 2, 0.4, 0.2), (2, 1, None, None)], "a long, b long, raw double, adjusted double")
    aligned = spark.createDataFrame([(1, 1, 0.8), (2, 1, 0.4)], "a long, b long, alignment double")
    got = {(r.a, r.b): round(r.score, 9) for r in graph.retrieval_scores(typed, aligned, 0.25, 0.75).collect()}
    assert got == {(1, 1): 0.725, (1, 2): 0.05, (2, 1): 0.3}


def test_random_projection(spark):
    from corpuslab.operators.score import random_projection, token_vector

    texts_ = [(1, "The cat the CAT dog"), (2, ""), (3, None), (4, "dog  cat\tthe")]
    df = spark.createDataFrame(texts_, "passage_id long, text string")
    got = {r.passage_id: np.array(r.vector) for r in random_projection(df.repartition(3), "passage_id", 64, "s").collect()}
    for i, t in texts_:
        want = sum((token_vector(w, 64, "s") for w in (t or "").lower().split()), np.zeros(64))
        want = want / np.linalg.norm(want) if want.any() else want
        assert np.allclose(got[i], want)
    many = np.stack([token_vector(str(i), 256, "s") for i in range(400)])
    gram = many @ many.T / 256
    assert abs(np.diag(gram) - 1).max() < 0.5 and abs(gram - np.diag(np.diag(gram))).mean() < 0.08
