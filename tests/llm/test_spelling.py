"""Spelling variants: odd rows, hot groups and long words against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import spelling as SP
from corpuslab.llm.spelling import near_counts, spelling_variants, word_counts

from . import brute


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "  \t"), (4, "abcdefg " * 30), (4, "abcdefg " * 30), (5, "abcdefgh abcdefh ABCDEFH"), (None, "abcdefgh abcdefh"),
        (6, "éabcdefg Éabcdefg éabcdefg Éabcdefg"), (7, "x" * 5000 + " " + "x" * 5000 + "y " + "x" * 5001 + " " + "x" * 5000), (8, ("x" * 5000 + "y ") * 40), (9, "short seven77x"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "key", "m", "size", "root", "best")})
    want = brute.spelling(brute.word_counts(docs))
    assert rows(spelling_variants(df)) == want and want["abcdefh"][0] == "abcdefg"
    assert spelling_variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [1 << 17, 40])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(SP, "GROUP", group)  # the second splits hot groups, several times over
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 11))) for _ in range(700)}
    words |= {"prefix" + "".join(rng.choice("abc\U0001f600") for _ in range(rng.randint(1, 5))) for _ in range(300)}
    n = {w: rng.choice((2, 3, 30, 500)) for w in words}
    want = {w: x for w, x in brute.spelling(n).items() if x[3]}
    got = near_counts(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r.word: r.n_near for r in got} == {w: x[3] for w, x in want.items()}
    assert {r.word: r.best.word for r in got if -r.best.minus >= 10 * n[r.word]} == {w: x[0] for w, x in want.items() if x[0]}


def test_words_of_any_length(spark):
    n = {"": 5, "a": 3, "b": 9, "ab": 2, "abc": 4, "ba": 7}
    got = near_counts(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert {r.word: r.n_near for r in got.collect() if r.word} == {"a": 3, "b": 3, "ab": 3, "abc": 1, "ba": 2}


def test_forms_are_followed_to_the_last(spark):
    docs = [(None, " ".join(["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200 + ["abcdefghij"] * 2000))]
    got = rows(spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {w: x[1] for w, x in got.items()} == dict.fromkeys(("abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"), "abcdefghij")
    assert word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
