"""Lexicons in one pass and ids inside texts, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslab.dims import BOOK_RULES, FEATURE_KEYWORDS, MASK_TERMS, MODERN_LEXICON, NEIGHBOUR_TERMS, OTHER_PAGES, PAGE_RULES
from corpuslab.operators import lexicon as X
from corpuslab.operators.lexicon import Lexicon, find_terms, ids_in_texts, keyword_features, neighbour_flag, page_class, term_mentions, whole_word_density


def test_counts_overlaps_and_whole_words():
    terms = ["aa", "a", "space", "space-time", "field", "ħ", ""]
    for text in ("aaaa a aa", "space-time, space; spaces _space field9 ħ", "", None, "the fields", "field"):
        want = [(t, (text or "").count(t), len(re.findall(rf"(?<!\w)(?={re.escape(t)}(?!\w))", text or "")), (text or "").find(t)) for t in terms if t and t in (text or "")]
        assert Lexicon(terms).find(text) == want
    assert Lexicon([]).find("text") == []


def passages(spark):
    rng = random.Random(8)
    words = ["Quantum", "field", "maxwell", "entropy", "photon", "law", "heat", "flows", "waves", "spacetime", "space-time", "orbit", "plain", "word", "thermal", "newtonian", "ħ", "eigenvalue", "ethereal", "matter"]
    rows = [(i, rng.choice([n for n, _ in NEIGHBOUR_TERMS] + [None, "other"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, "relativity", None)]
    return rows, spark.createDataFrame(rows, "passage_id long, label string, text string").withColumn("found", F.lit("clash")).withColumn("n", F.lit(1))


def test_packaged_tables(spark):
    rows, df = passages(spark)
    low = {i: (t or "").lower() for i, _, t in rows}
    assert {tuple(r) for r in term_mentions(df, MODERN_LEXICON).collect()} == {(i, w, t.count(w)) for i, t in low.items() for w in MODERN_LEXICON if w in t}
    got = {r.passage_id: r.density for r in whole_word_density(df.filter("text IS NOT NULL"), MASK_TERMS).collect()}
    assert got == {i: pytest.approx(sum(bool(re.search(rf"\b{re.escape(w)}\b", t)) for w in MASK_TERMS) / max(len(t.split()), 1)) for i, t in low.items() if i != 60}
    got = keyword_features(df, FEATURE_KEYWORDS).collect()
    assert len(got) == len(rows) * 17 and {tuple(r) for r in got} == {(i, f, int(any(k in t for k in ks))) for i, t in low.items() for f, ks in FEATURE_KEYWORDS}
    near = dict(NEIGHBOUR_TERMS)
    assert {tuple(r) for r in neighbour_flag(df, "label", NEIGHBOUR_TERMS).collect()} == {(i, label, any(k in low[i] for k in near.get(label, ()))) for i, label, _ in rows}
    assert find_terms(df.limit(0), F.col("text"), MASK_TERMS).count() == 0


def test_page_classes(spark):
    rows = [
        ("11-2-quarks", None, "", "quantum_field_theory"), ("chapter-11-", None, "", "newtonian"), ("5-special-relativity", "newtonian", "", "relativity"), ("Quantum-Fields", None, "", "quantum_field_theory"),
        ("the-quantum-atom", None, "", "quantum_mechanics"), ("Heat-and-light", None, "", "thermodynamics"), ("light-waves", None, "", "classical_em"), ("the-nucleus", None, "", "atomistic_corpuscular"),
        ("intro", "thermodynamics", "volume-3", "thermodynamics"), ("intro", "unknown", "physics-volume-3", "quantum_mechanics"), (None, None, "x-volume-2", "classical_em"), ("intro", None, None, "newtonian"),
    ]
    df = spark.createDataFrame(rows, "page string, hint string, book string, want string")
    assert df.filter(~page_class(F.col("page"), F.col("hint"), F.col("book"), PAGE_RULES, BOOK_RULES, OTHER_PAGES).eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_ids_as_substrings(spark, monkeypatch, small):
    if small:  # several rounds, hot ids in parts, texts in pieces
        monkeypatch.setattr(X, "MOST_BITS", 1 << 10)
        monkeypatch.setattr(X, "_CHUNK", 1 << 9)
        monkeypatch.setattr(X, "PART", 3)
        monkeypatch.setattr(X, "PIECE", 7)
    rng = random.Random(2)
    ids = ["A-12", "x:7", "7", "A-1", "", None, "é.ü", "\U0001f600", "a b", "x" * 40, "x" * 41, "0123456789abcdef", "0123456789abcdefg", "(.*)", "no such id"] + [f"S{i:03d}/{i % 7}" for i in range(80)]
    ids += ["A-12"]
    pieces = [i for i in ids if i] + [" ", "word", "A-", "x" * 39, "0123456789abcde"]
    texts = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for i in range(70)] + [(70, None), (71, ""), (72, "x" * 60)]
    want = {(i, x) for i, t in texts for x in ids if x and x in (t or "")}
    got = ids_in_texts(spark.createDataFrame(texts, "anonymous_id long, text string"), spark.createDataFrame([(x,) for x in ids], "passage_id string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert ids_in_texts(spark.createDataFrame(texts, "anonymous_id long, text string"), spark.createDataFrame([], "passage_id string")).count() == 0


def test_numeric_ids(spark):
    texts = spark.createDataFrame([(1, "in 1931, no. 12"), (2, "none")], "anonymous_id long, text string")
    got = ids_in_texts(texts, spark.createDataFrame([(12,), (93,), (5,)], "passage_id long"))
    assert {tuple(r) for r in got.collect()} == {(1, "12"), (1, "93")}


@pytest.mark.parametrize("bounds", [{}, {"SHORT": 5, "PART": 3}, {"SHORT": 0}, {"NODES": 1 << 9, "_SENT": 2}, {"BYTES": 1 << 10}])
def test_short_and_long_ids(spark, monkeypatch, bounds):
    for name, value in bounds.items():  # windows for some or all, several automata
        monkeypatch.setattr(X, name, value)
    rng = random.Random(3)
    ids = ["".join(rng.choice("ab,é ") for _ in range(rng.choice([1, 3, 5, 6, 9, 17, 64, 65, 130]))) for _ in range(60)] + ["b\0a", "\U0001f600b", "", None]
    texts = [(i, "".join(rng.choice(ids) or "\0" for _ in range(rng.randint(0, 6)))) for i in range(50)] + [(50, None), (None, "aab, "), (None, "b\0a")]
    want = {(i, x) for i, t in texts for x in ids if x and x in (t or "")}
    frame, wanted = spark.createDataFrame(texts, "anonymous_id long, text string"), spark.createDataFrame([(x,) for x in ids], "passage_id string")
    got = ids_in_texts(frame, wanted).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    same = ids_in_texts(frame.withColumn("anonymous_id", F.col("anonymous_id") % 2), wanted).collect()
    want = {(i if i is None else i % 2, x) for i, x in want}
    assert len(same) == len(want) and {tuple(r) for r in same} == want


def test_bounds_of_an_automaton(spark, monkeypatch):
    ids = spark.createDataFrame([(f"{i:05d}",) for i in range(2000)], "found_id string")
    assert X._dealt(ids, 2000, 10_000)[1] == 1
    monkeypatch.setattr(X, "NODES", 1200)
    dealt, rounds = X._dealt(ids, 2000, 10_000)
    heads = {}
    for r in dealt.collect():
        heads.setdefault(r["round"], set()).update(r.found_id[:k] for k in range(1, 6))
    assert 1 < rounds == len(heads) and max(map(len, heads.values())) <= 1.1 * 1200


def test_short_ids_need_no_join(spark):
    texts = spark.createDataFrame([(i, f"the end. So {i}") for i in range(30)], "anonymous_id long, text string")
    found = ids_in_texts(texts, spark.createDataFrame([("end. So",), ("d. S",), ("a long id of more than sixteen characters",)], "passage_id string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 60 and plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan
