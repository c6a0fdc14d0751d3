"""The registered queries that SQL cannot express, over whole tables, against plain versions and the libraries."""

import base64
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from corpuslab.llm.bpe import Splitter
from corpuslab.llm.queries import ORACLE_SQL, QUERIES
from corpuslab.llm.token_counts import LATER_MARKS, normal_form

from . import brute

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def documents(spark, sf, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *columns).collect()]


def test_every_query_has_sql_or_a_test_here():
    assert set(QUERIES) - set(ORACLE_SQL) == {"op4_suffix_dedup", "op6_token_counts", "op7_language_id", "op8_near_dedup", "op10_byte_bpe", "op12_toxicity", "op13_spelling_variants"}


def test_op4(spark):
    want = {i: (*x[:3], brute.sha(x[3])) for i, x in brute.suffix_dedup(documents(spark, SF, "text")).items()}
    got = QUERIES["op4_suffix_dedup"](spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_op6(spark):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_token_counts"](spark, LARGER).collect()}
    for i, t in documents(spark, LARGER, "text"):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got.pop(i) == (len((t or "").encode()), n, n > 2048)
    assert not got


def test_op7(spark):
    want = brute.language_id(documents(spark, SF, "text", "lang"))
    got = QUERIES["op7_language_id"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        held, lang, score = want[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held, lang) and abs(r.score - score) < 1e-6


def test_op8(spark):
    docs = documents(spark, LARGER, "text")
    want = brute.near_classes(docs)
    got = QUERIES["op8_near_dedup"](spark, LARGER).collect()
    size = Counter(want.values())
    assert {r.doc_id: (r.class_id, r.class_size, r.n_shingles, r.kept) for r in got} == {i: (want[i], size[want[i]], brute.multiset(t).total(), want[i] == i) for i, t in docs}


def test_op10(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_byte_bpe"](spark, LARGER).collect()}
    for i, t in documents(spark, LARGER, "text"):
        ids = library.encode_ordinary(t or "")
        assert got.pop(i) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or ""))
    assert not got


EVERY = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@pytest.mark.parametrize("name", [r"\p{L}", r"\p{N}", r"\s"])
def test_classes_are_those_of_both_libraries(name):
    own = set(Splitter(name).findall(EVERY))
    left = pre_tokenizers.Split(Regex(name), "removed").pre_tokenize_str(EVERY)
    assert own == set(EVERY) - set().union(*(x for x, _ in left))
    one_byte = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    assert own == set(one_byte.decode(one_byte.encode_ordinary(EVERY)))


def test_normal_form_is_that_of_the_library():
    library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    for c in EVERY:
        if not c.isascii():
            assert normal_form(c) == library.normalize_str(c), hex(ord(c))
    later = [chr(c) for a, b in LATER_MARKS for c in range(a, b + 1)]
    for m in [*later, "́", "̣", "ͅ"]:
        for text in (f"a{m}̣", f"á{m}̣", f"Σ{m}̴́", f"\U00011935{m}\U00011930́"):
            assert normal_form(text) == library.normalize_str(text)


def test_op13(spark):
    want = brute.spelling(brute.word_counts(documents(spark, LARGER, "text")))
    got = QUERIES["op13_spelling_variants"](spark, LARGER).collect()
    assert len(got) == len(want) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
