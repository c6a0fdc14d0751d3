"""Toxicity: the grammar on clauses, learned terms and weights, odd rows, held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from corpuslab.llm import toxicity as TX
from corpuslab.llm.queries import QUERIES
from corpuslab.llm.toxicity import DENIED, EVENTS, HINT, INSULT, PLAIN, REPORTED, THREAT, Scorer, choose_terms, fit_weights, grammar, sketches, tokens, toxicity, train_toxicity

SF = "/root/testdata/sf0.01"


def events(text, learned=()):
    n = Scorer(learned).counts([text])[0]
    return {EVENTS[i]: int(k) for i, k in enumerate(n) if k}


def test_clauses():
    assert events("You are an idiot.") == {(INSULT, True, PLAIN): 1}
    assert events("What an idiot, I think. You know") == {(INSULT, False, PLAIN): 1}
    assert events("an idiot like you") == {(INSULT, True, PLAIN): 1}
    assert events("You are not an idiot") == {(INSULT, True, DENIED): 1}
    assert events("Not today. You idiot") == {(INSULT, True, PLAIN): 1}
    assert events("The paper said that the clown was late") == {(INSULT, False, REPORTED): 1}
    assert events("They wrote it. Pure trash") == {(INSULT, False, PLAIN): 1}
    assert events('"You moron! Idiot" was the title') == {(INSULT, True, REPORTED): 1, (INSULT, False, REPORTED): 1}
    assert events("I will kill you") == {(THREAT, True, PLAIN): 1} and events("They kill time") == {(THREAT, True, PLAIN): 1}
    assert events("never kill it") == {(THREAT, False, DENIED): 1}
    assert events("tu n'es pas un idiot") == {(INSULT, True, DENIED): 1} and events("du Trottel") == {(INSULT, True, PLAIN): 1}
    assert events("idiot moron") == {(INSULT, False, PLAIN): 2}
    assert events("gramblot and gramble", ["gram", "=and"]) == {(HINT, False, PLAIN): 2, (INSULT, False, PLAIN): 1}
    assert events("") == events(None) == events("quiet words only; nothing else\n") == {}


def test_the_table_is_the_composition():
    following, out = grammar().table(range(10))
    rng = np.random.default_rng(3)
    machine, state, at = grammar(), grammar().start, 0
    for x in rng.integers(0, 10, 5000).tolist():
        state, said = machine.step(state, x)
        assert said == out[at][x]
        at = following[at][x]
    assert len(following) < 3000


def test_pieces_change_nothing(monkeypatch):
    text = ("You really are an idiot. He said no trash \n" + "word " * 50) * 40
    whole = Scorer().counts([text])
    monkeypatch.setattr(TX, "PIECE", 17)
    assert (Scorer().counts([text]) == whole).all() and sum(len(p) for p in tokens(text)) == 40 * 61


def test_choice_of_terms():
    found = [("=vile", 30, 0), ("vil", 33, 1), ("zor", 20, 0), ("zork", 12, 0), ("the", 80, 700), ("=rare", 2, 0), ("abc", 25, 5), ("abcd", 15, 0)]
    assert choose_terms(found, 90, 900) == ["=vile", "abcd", "zor"] or choose_terms(found, 90, 900) == ["abcd", "vil", "zor"]
    assert choose_terms([], 0, 0) == []


def test_weights_are_at_their_optimum():
    rng = np.random.default_rng(0)
    n = rng.poisson(0.4, (300, len(EVENTS)))
    toxic, times = (rng.random(300) < 0.3).astype(float), rng.integers(1, 5, 300).astype(float)
    w = fit_weights(n, toxic, times)
    x = np.concatenate([np.ones((300, 1)), np.log1p(n)], axis=1)
    firm = np.array([TX.FIRM[1], *[TX.FIRM[0]] * len(EVENTS)])
    slope = x.T @ (times * (1 / (1 + np.exp(-x @ w)) - toxic)) + firm * (w - np.array([TX.BIAS, *TX.PRIOR]))
    assert abs(slope).max() < 1e-6
    assert (fit_weights(np.zeros((0, len(EVENTS))), np.zeros(0), np.zeros(0)) == np.array([TX.BIAS, *TX.PRIOR])).all()


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "You idiot."), (3, "You idiot."), (3, "calm"), (None, "You idiot"), (5, "calm " * 300_000), (6, "퟿ é 1234")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "toxic", "n", "s0", "score")})
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, None), (3, 0), (None, 1), (5, 0), (99, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    for given in (labels, labels.limit(0)):
        got = toxicity(df, given).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 5, 6)}) == 1 and min(r.score for r in got if r.doc_id == 3) < max(r.score for r in got if r.doc_id == 3)
    assert toxicity(df.limit(0), labels).count() == 0


def test_a_sample_of_the_labels_is_enough(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(TX, "MAX_LABELS", 100)
    few = train_toxicity(docs, labels).weights
    monkeypatch.setattr(TX, "MAX_LABELS", 1 << 18)
    assert not np.array_equal(few, train_toxicity(docs, labels).weights)


def test_learned_stems_and_copies(spark):
    rng = np.random.default_rng(5)
    say = lambda k: " ".join("".join(rng.choice(list("bcdfg")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(k))
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        docs.append((i, say(40) + (f" zork{say(1)} zork{say(1)} " if toxic else " ") + say(20)))
        labels.append((i, int(toxic)))
    copy = say(60)
    docs += [(1000 + i, copy + " " + say(1)) for i in range(300)]
    labels += [(1000 + i, 1) for i in range(300)]
    model = train_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.stems == {"zor"} or model.stems == {"zork"}
    assert not [w for w, k in model.words.items() if k == INSULT and w in copy.split()]
    assert len({tuple(sketches(copy)), tuple(sketches(copy + " "))}) == 1 and len(sketches("")) == 3


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in QUERIES["op12_toxicity"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, _, t in rows if t], [s for s, _, t in rows if not t]
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / len(toxic) / len(clean) > 0.8
    assert sum(p == t for _, p, t in rows) / len(rows) > 0.93
