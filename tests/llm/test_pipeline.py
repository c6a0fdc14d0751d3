"""The pipeline on the smallest tables, against plain versions of its stages."""

import base64

import duckdb
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from corpuslab.llm.common import materialize
from corpuslab.llm.queries import mix_sql

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for i, (_, stage) in enumerate(C.STAGES):
        docs = materialize(stage(spark, docs, SF))
        counts.append(docs.count())
        if i < len(C.STAGES) - 1:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert docs.filter("NOT exact OR exact IS NULL").count() == 0


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r.asDict() for r in docs}
    said = brute.language_id([(r.doc_id, r.text, r.lang) for r in docs])
    rows = {i: r for i, r in rows.items() if said[i][1] != "und" and said[i][2] >= C.LEAST_LANGUAGE_SCORE}
    kept = brute.line_dedup([(i, r["text"]) for i, r in rows.items()])
    rows = {i: r | {"text": kept[i], "n_chars": len(kept[i])} for i, r in rows.items()}
    classes = brute.near_classes([(i, r["text"]) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if classes[i] == i}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(list(rows.values())))
    taken = {i for i, n in con.sql(f"SELECT doc_id, copies FROM ({mix_sql(C.MIX_SHARE, C.MIX_EPOCHS)})").fetchall() if n > 0}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i in taken:
        ids = library.encode_ordinary(rows[i]["text"])
        want[i] = rows[i]["lang"], rows[i]["source"], len(ids), ids, True
    got = C.run(spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: tuple(r)[1:] for r in got} == want


ODD = [
    (1, None, None, None, None), (None, "a text of some words", "en", "src0", 20), (None, "a text of some words", "en", "src0", 20), (2, "", "en", "src1", 0), (2, "", "en", "src1", 0),
    (3, "word " * 50_000, "en", "src0", 9), (4, "zz " * 30, "en", "src1", 90), (4, "aa " * 30, "en", "src1", 90), (5, "aa " * 30, None, "src1", 90), (6, "123", "en", None, 3),
]


def test_odd_rows_of_each_stage(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "key", "drops", "kept", "label", "bands", "copies", "part", "head", "ids", "decoded", "fp"):
        df = df.withColumn(name, df["source"])
    out = {name: stage(spark, df, SF).collect() for name, stage in C.STAGES}
    ids = lambda name: sorted(r.doc_id if r.doc_id is not None else 0 for r in out[name])
    # no letters, no text: no language; what is clear stays, with or without an id
    assert set(ids("language_id")) <= {0, 3, 4, 5} and 3 in ids("language_id")
    assert ids("line_dedup") == [0, 0, 1, 2, 2, 3, 4, 4, 5, 6] and {r.n_chars for r in out["line_dedup"] if r.doc_id == 1} == {None}
    # of id 4 the greater text stands, so that row 5 resembles nothing that is kept; rows without an id stay
    assert ids("near_dedup") == [0, 0, 1, 2, 3, 4, 5, 6] and {r.text for r in out["near_dedup"] if r.doc_id == 4} == {"zz " * 30}
    assert 0 not in ids("mixing") and set(ids("mixing")) <= {1, 2, 3, 4, 5, 6}
    assert ids("byte_bpe") == [0, 0, 1, 2, 2, 3, 4, 4, 5, 6] and all(r.exact for r in out["byte_bpe"])
    for name in ("language_id", "line_dedup", "near_dedup", "mixing"):
        assert all(r.__fields__ == df.columns for r in out[name])
    for name, stage in C.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0, name
