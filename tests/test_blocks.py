"""TF-IDF by blocks of texts: rows as in SQL on odd tables, and a term is sent to a block once."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from corpuslab.operators import blocks as B

from .oracle import rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null ids, works, languages and texts, empty texts, ids that several rows share, labels without a text."""
    d, rng = str(tmp_path_factory.mktemp("odd")), random.Random(8)
    docs = [(i, rng.choice(["en", "fr", "de"]), f"s{i % 4}", " ".join(f"{rng.choice('ab')}{rng.randrange(30)}, X{rng.randrange(9)}" for _ in range(rng.randrange(30)))) for i in range(60)]
    docs += [(None, "en", "s1", "a1 a2 zz zz b3"), (78, None, "s1", "a1 a2"), (71, "fr", None, "a3 b4 b5"), (72, "en", "s2", None), (73, "en", "s2", ", a"), (5, docs[5][1], docs[5][2], "b1 b2 own own"), (74, "xx", "only", "a1 b2 q9")]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{d}/documents.parquet")
    labels = [(i, i % 3 % 2, 0) for i in range(0, 90, 2)] + [(4, 0, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("name", ["tfidf_similarity", "centroid_predict", "logo_centroid"])
def test_odd_rows(spark, odd, monkeypatch, name, small):
    if small:
        for k, v in {"WORDS": 40, "TEXTS": 5, "ROWS": 3, "PRODUCTS": 7}.items():
            monkeypatch.setattr(B, k, v)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    df, want = entry.queries()[name](spark, odd), con.sql(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_a_block_has_a_term_once(spark):
    texts = spark.createDataFrame([(i, "the same words " * 3 + f"w{i}") for i in range(500)], "k long, text string").coalesce(1)
    blocks = B.tfidf_blocks(B.whole_texts(texts.selectExpr("k", "text", "k % 2 AS side"), "k", ["side"]), "k").collect()
    assert len(blocks) == 1 and len(blocks[0].terms) == 503 and len(blocks[0].codes) == 2000
    sums = B.tag_sums(spark.createDataFrame(blocks, B.tfidf_blocks(B.whole_texts(texts.selectExpr("k", "text", "k % 2 AS side"), "k", ["side"]), "k").schema), ["side"])
    assert sums.count() == 506  # 2 x 3 common terms and 500 own ones, in place of 2000 rows


def test_pairs_of_words_are_terms_too(spark, tmp_path):
    """The mean cosine of TF-IDF vectors of words and of two that follow each other, from each text alone."""
    texts = {1: "Red house a red door", 2: "red  house, red house", 3: "a", 4: "door; house red", 5: "blue red"}
    spark.createDataFrame([(i, "en", "s", t) for i, t in texts.items()], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 0, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    words = {i: [w for w in re.findall(r"\w+", t.lower()) if len(w) > 1] for i, t in texts.items()}
    tf = {i: Counter([*w, *map(" ".join, zip(w, w[1:], strict=False))]) for i, w in words.items() if w}
    assert tf[1]["house red"] == 1 and tf[2]["red house"] == 2
    raw = {i: {t: n * (math.log((1 + len(tf)) / (1 + sum(t in x for x in tf.values()))) + 1) for t, n in c.items()} for i, c in tf.items()}
    cosine = lambda a, b: sum(v * raw[b].get(t, 0) for t, v in raw[a].items()) / math.hypot(*raw[a].values()) / math.hypot(*raw[b].values())
    got = entry.queries()["tfidf_similarity"](spark, str(tmp_path)).first().mean_similarity
    assert abs(got - (cosine(1, 2) + cosine(1, 4)) / 2) < 1e-6


def test_terms_of_one_text_are_in_no_product(spark):
    """Only terms that two texts have, or a text of two tags, are summed; the product is that of all terms."""
    rows = [(i, f"own{i} words{i % 7} of{i} both", side) for i in range(40) for side in ("AB" if i == 5 else "AB"[i % 2])]
    texts = B.whole_texts(spark.createDataFrame(rows, "k long, text string, side string"), "k", ["side"])
    blocks = B.tfidf_blocks(texts, "k", pairs=True)
    shared = {t: s for r in blocks.collect() for t, s in zip(r.terms, r.shared, strict=True)}
    assert shared["both"] and shared["words3"] and not shared["own3"] and not shared["own3 words3"]
    sums = {m: {(r.side, r.term): r.weight for r in B.tag_sums(blocks, ["side"], met=m).groupBy("side", "term").agg({"weight": "sum"}).toDF("side", "term", "weight").collect()} for m in (False, True)}
    dot = lambda s: sum(v * s.get(("B", t), 0.0) for (side, t), v in s.items() if side == "A")
    assert abs(dot(sums[True]) - dot(sums[False])) < 1e-9 and ("A", "own5") in sums[True] and ("A", "own4") not in sums[True]
