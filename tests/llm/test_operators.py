"""The training-data operators against brute force, exact round trips and the libraries that they must equal."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslab.llm import line_dedup as LD
from corpuslab.llm import minhash as MH
from corpuslab.llm import suffix_dedup as SD
from corpuslab.llm import topk_search as TK
from corpuslab.llm.bpe import ByteBPE, PerfectHash, bpe_decode, bpe_encode
from corpuslab.llm.chat import chat_format, loss_text, parse, rows_to_events
from corpuslab.llm.components import components
from corpuslab.llm.exact_dedup import CountingQuotientFilter, exact_dedup
from corpuslab.llm.language_id import language_id
from corpuslab.llm.line_dedup import line_dedup
from corpuslab.llm.minhash import COMPONENTS, near_dedup, signatures
from corpuslab.llm.mixing import mix_sources
from corpuslab.llm.queries import ORACLE_SQL, QUERIES
from corpuslab.llm.token_counts import WordBPE, token_counts
from corpuslab.llm.topk_search import exact_top_k, whole_vectors

from ..oracle import connection, rows

SF = "/root/testdata/sf0.001"
#: Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with inner ones.
ODD = [
    (1, None, "en", "src0"), (2, "", "en", None), (3, "  \t ", None, "src0"), (4, "The same line of twenty chars\nother line that is long enough", "en", "src1"),
    (5, "the same line of twenty chars \nx", "en", "src1"), (6, "\tTHE SAME LINE OF TWENTY CHARS", "fr", "src1"), (6, "\tTHE SAME LINE OF TWENTY CHARS", "fr", "src1"),
    (None, "the same line of twenty chars", "fr", "src2"), (8, "long " * 60_000, "en", "src0"), (9, "long " * 60_000, "en", "src0"), (10, "é" * 20 + "\n" + "É" * 20, "fr", "src0"),
    (11, "one two three four five six seven eight", "en", "src3"), (12, "12345 67890", "de", "src3"), (13, "<|endoftext|> </turn>", "en", "src3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("fp", "key", "drops", "row", "cell", "raw", "kept", "n_tokens", "bands", "label", "docs", "n_chars"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def corpus(seed=1, n=120):
    """Random texts with exact copies, near copies and shared passages; ids are not in order."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [say(20) for _ in range(3)]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            text = rng.choice(out)[1]
        elif out and kind < 0.4:
            words = rng.choice(out)[1].split(" ")
            for _ in range(max(1, len(words) // rng.choice((15, 30, 80)))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = say(rng.randint(0, 120))
            if rng.random() < 0.3:
                text += "\n" + rng.choice(shared) + " " + say(5)
        out.append((i * 37 % 1009, text))
    return out


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    df = QUERIES[name](spark, SF)
    want = connection(SF).sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("most", [1 << 28, 0])
def test_line_dedup_cases(odd, monkeypatch, most):
    monkeypatch.setattr(LD, "MAX_FILTER_BITS", most)  # broadcast or partitioned
    got = {}
    for r in line_dedup(odd).collect():
        got.setdefault(r.doc_id, r)
    assert (got[1].n_lines, got[1].kept) == (1, "") and got[2].n_lines == 1
    assert (got[4].n_dropped, got[4].kept) == (1, "other line that is long enough")
    assert (got[5].n_dropped, got[5].kept) == (1, "x")
    assert got[6].n_dropped == 0 and got[None].n_dropped == 0  # the largest id that holds it; ids that are null keep all
    assert got[10].n_dropped == 0
    assert line_dedup(odd.limit(0)).count() == 0


def test_partitioned_filters_give_the_same_lines(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = line_dedup(df).collect()
    monkeypatch.setattr(LD, "MAX_FILTER_BITS", 0)
    monkeypatch.setattr(LD, "RANGE_BITS", 1 << 17)
    assert Counter(map(tuple, line_dedup(df).collect())) == Counter(map(tuple, want))


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 1 << 63, 500).astype(np.uint64) << np.uint64(1) for _ in range(3)]
    parts[1][:100] = parts[0][:100]
    parts[2][:7] = parts[0][0]
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.build(p) for p in parts])
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())
    assert len(CountingQuotientFilter.build(np.empty(0, np.uint64)).fingerprints()) == 0


def test_exact_dedup_cases(odd):
    got = [tuple(r)[:4] for r in exact_dedup(odd).collect()]
    assert Counter(got) == Counter([
        (1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 2, True), (6, 6, 2, True), (None, None, 1, True),
        (8, 8, 2, True), (9, 8, 2, False), (10, 10, 1, True), (11, 11, 1, True), (12, 12, 1, True), (13, 13, 1, True),
    ])
    assert exact_dedup(odd.limit(0)).count() == 0


def test_top_k_against_brute_force(spark):
    rng = random.Random(4)
    data = [(i, [float(rng.randint(-3, 3)) / 8 for _ in range(rng.choice((4, 4, 3)))]) for i in range(300)]
    data += [(900, None), (901, [0.1, None]), (902, [float("nan")]), (903, [float("inf"), 1.0]), (904, []), (7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0]), (40, [-9.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    items = whole_vectors(df)
    got = [tuple(r) for r in exact_top_k(items, items.filter("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect()]
    clean = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data if v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    want = []
    for q in sorted({i for i, _ in clean if i % 20 == 0}):
        own = min(v for i, v in clean if i == q)  # of rows that share an id the least asks, and every other row may be found
        s = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in clean if i != q)[:5]
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert got == want
    assert exact_top_k(items.limit(0), items.limit(0)).count() == 0


def test_top_k_cases(spark):
    data = [(i, [1.0, 0.0]) for i in range(12)] + [(50, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for name in ("v", "t", "g", "dims", "s", "n", "own", "least", "first", "block"):
        df = df.withColumn(name, F.lit("clash"))
    items = whole_vectors(df)
    got = exact_top_k(items, items.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    # ties at every rank: the smaller ids
    assert [tuple(r) for r in got] == [(0, r, r, 65536) for r in range(1, 6)] + [(50, r, r - 1, 32768) for r in range(1, 6)]
    few = items.filter("vec_id IN (0, 50)")
    assert [tuple(r) for r in exact_top_k(few, few, 5).orderBy("query_id").collect()] == [(0, 1, 50, 32768), (50, 1, 0, 32768)]


def test_top_k_rounds_over_many_groups(spark, monkeypatch):
    for name, value in {"BLOCK": 4, "GROUP": 2, "TILE": 3, "SUMMARIES": 2}.items():
        monkeypatch.setattr(TK, name, value)
    rng = random.Random(5)
    data = [(i, [float(rng.randint(-9, 9)) for _ in range(rng.choice((3, 4)))]) for i in range(90)]
    items = whole_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 1)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_top_k(items, items.filter("vec_id % 4 = 0"), 3).collect()}
    for q, v in data[::4]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in data if i != q)[:3]
        assert [got.pop((q, r)) for r in (1, 2, 3)] == [(i, -x) for x, i in best]
    assert not got


def brute_spans(docs, length):
    first = {}
    raw = sorted((i, t.encode()) for i, t in docs)
    for i, b in raw:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, b in raw:
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                m[p : p + length] = b"\1" * length
        out[i] = (len(b), sum(m), sum(1 for q in range(len(m)) if m[q] and (q == 0 or not m[q - 1])), bytes(x for x, y in zip(b, m, strict=True) if not y))
    return out


@pytest.mark.parametrize(("hot", "heavy", "fan"), [(512, 4096, 1024), (512, 60, 4), (3, 4096, 4), (1, 1, 2)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot, heavy, fan):
    for name, value in {"HEAVY": heavy, "HEAVY_CELLS": 2, "CELL": 4000, "BATCH": 500, "MOST": 2000, "BLOCK": 60, "BYTES": 700, "HOT": hot, "FAN": fan}.items():
        monkeypatch.setattr(SD, name, value)
    docs = [*corpus(7), (2000, "a" * 300), (2001, "b" + "a" * 200), (2002, "é" * 60), (2003, "x" + "é" * 50 + "y"), (2004, "\0" * 120), (2005, "\0" * 80)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in SD.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_spans(docs, 50)


def test_suffix_dedup_cases(odd):
    got = {r.doc_id: r for r in SD.suffix_dedup(odd).collect()}
    assert len(got) == 13 and got[1].n_bytes == 0 and got[9].n_removed == 300_000 and got[8].n_removed == 0 and got[None].n_removed == 0
    assert SD.suffix_dedup(odd.limit(0)).count() == 0


def test_mix_redistributes_among_siblings_first(spark):
    data = [(i, "w " * 10, "en", f"a{i % 2}") for i in range(40)] + [(100 + i, "w " * 10, "fr", "a2") for i in range(2)] + [(200 + i, "w " * 10, "en", "b0") for i in range(40)]
    df = spark.createDataFrame(data, SCHEMA)
    domain = F.substring("source", 1, 1)
    out = mix_sources(df, domain, {"a": 1, "b": 1, "a/fr": 9}, (1, 2), 1, "s").collect()
    taken = Counter()
    for r in out:
        taken[r.domain, r.lang] += r.copies * r.n_tokens
    # half of 820 tokens; domain a gets 205: French has 20 only, so English, its sibling, gets 185; domain b is as before
    assert taken["a", "fr"] == 20 and 185 <= taken["a", "en"] <= 205 and 205 <= taken["b", "en"] <= 215
    more = mix_sources(df, domain, {"a/fr": 9, "b": 0}, (1, 1), 3, "s").collect()
    assert max(r.copies for r in more if r.lang == "fr") == 3 and all(r.copies == 0 for r in more if r.domain == "b")


def test_mix_cases(odd, spark):
    out = mix_sources(odd, F.lit("d"), {}, (1, 1), 1, "s").collect()
    assert len(out) == len(ODD) and all(r.copies == 1 for r in out if r.n_tokens)
    assert {r.source for r in out} == {"src0", "src1", "src2", "src3", "unknown"}
    assert mix_sources(odd.limit(0), F.lit("d"), {}).count() == 0


ALPHABET = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), 0x3000, 0x1F600, 0x4E00, 0xAC00, 0x130, 0x3A3]]


def strange(n=400):
    rng = random.Random(6)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return out + ["x<|endoftext|>y <|startoftext|>", "ΑΣ ΑΣ.", "a" * 20_000, "İstanbul", "don't  stop\n\n 12345", " \t ", "<|endoftext|"]


def test_token_counts_equal_the_library(spark):
    path = P.path("word_bpe_49k.json")
    bpe, library = WordBPE.from_file(path), Tokenizer.from_file(path)
    texts = strange()
    got = {r.doc_id: r for r in token_counts(spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string"), bpe).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(library.encode(t, add_special_tokens=False).ids), t
        assert got[i].n_bytes == len(t.encode()) and got[i].over_limit == (got[i].n_tokens > 2048)
    assert got[len(texts)].n_tokens == 0
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), bpe).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(1000)]
    h = PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(1000))
    assert all(h.index[h.slot(k)] == i for i, k in enumerate(keys))


def test_byte_bpe_equals_the_library(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = ByteBPE.from_file(path, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = strange()
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    for r in bpe_decode(bpe_encode(df, bpe), bpe).collect():
        text = (texts + [""])[r.doc_id]
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert bpe_encode(df.limit(0), bpe).count() == 0


def test_tokens_of_odd_rows(odd):
    word, byte = WordBPE.from_file(P.path("word_bpe_49k.json")), ByteBPE.from_file(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    df = odd.withColumns({x: F.lit("clash") for x in ("ids", "decoded", "n_bytes", "over_limit")})
    counts, ids = token_counts(df, word).collect(), bpe_encode(df, byte, decoded=True).collect()
    assert len(counts) == len(ids) == len(ODD)
    texts = Counter((i, (t or "").encode()) for i, t, _, _ in ODD)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in ids) == texts and Counter((r.doc_id, r.n_bytes) for r in counts) == Counter((i, len(t)) for i, t in texts.elements())
    assert {r.doc_id: r.over_limit for r in counts}[8] and next(r for r in counts if r.doc_id == 13).n_tokens > 1


def test_language_id_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id(df).join(df.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.n >= 40]
    assert len(held) > 50 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_cases(odd):
    got = {r.doc_id: r for r in language_id(odd).collect()}
    assert len(got) == 13 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 12))
    assert got[8].lang_pred != "und" and got[None].held_out
    assert language_id(odd.limit(0)).count() == 0
    # numerals are no letters, letters of any script are
    signs = ["½", "² ³", "Ⅷ", "①②", "٣ 4", "_", "a²", "漢", "ª", "ʰ", "\u0301"]
    marks = odd.select("doc_id", "text", "lang").unionByName(odd.sparkSession.createDataFrame([(100 + i, x, None) for i, x in enumerate(signs)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language_id(marks).collect() if (r.doc_id or 0) >= 100}
    assert [got[100 + i].lang_pred == "und" and got[100 + i].score == 0 for i in range(len(signs))] == [True] * 6 + [False] * 4 + [True]
    assert {r.lang_pred for r in language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def multiset(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(docs):
    sets = {i: multiset(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = sum((sets[a] & sets[b]).values())
            if inter and 5 * inter >= 4 * sum((sets[a] | sets[b]).values()):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_family(seed=9, n=70):
    """One base text and copies with more and more changes, so that some are linked through others only."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(i // 7):
            words[rng.randrange(len(words))] = f"z{rng.randrange(3000)}"
        out.append((5000 - i, " ".join(words)))
    return out


def test_near_dedup_against_brute_force(spark):
    docs = corpus(11) + near_family()
    got = {r.doc_id: r for r in near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_classes(docs)
    assert {i: r.class_id for i, r in got.items()} == want
    size = Counter(want.values())
    assert all(r.class_size == size[want[i]] and r.kept == (want[i] == i) for i, r in got.items())


def test_near_dedup_cases(odd):
    got = {r.doc_id: r for r in near_dedup(odd).collect()}
    assert got.keys() == {None, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13}
    assert tuple(got[None])[:3] == (None, None, 1) and got[None].kept
    assert got[9].class_id == 8 and got[1].class_id == 1 and got[2].class_id == 2 and got[3].n_shingles == 0
    assert near_dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "value"), [("BROADCAST_IDS", 0), ("PART", 64)])
def test_near_dedup_branches(spark, monkeypatch, name, value):
    df = spark.createDataFrame(corpus(7, 200), "doc_id long, text string")
    want = sorted(map(tuple, near_dedup(df).collect()))
    monkeypatch.setattr(MH, name, value)  # a filter in place of the ids; many tiles around one text
    assert sorted(map(tuple, near_dedup(df).collect())) == want


def test_near_dedup_takes_one_text_of_a_shared_id(spark):
    a, b = " ".join(f"zz{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    data = [(1, a), (1, b), (2, b), (3, None), (3, ""), (None, a), (None, a)]
    got = near_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    # of id 1 the greater text stands, so that row 2 resembles nothing
    assert {(r.doc_id, r.class_id, r.class_size, r.n_shingles, r.kept) for r in got if r.doc_id} == {(1, 1, 1, 296, True), (2, 2, 1, 296, True), (3, 3, 1, 0, True)}
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, None, 1, 296, True)] * 2 and len(got) == 5


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(60):
        s = rng.integers(0, 1 << 62, 30).astype(np.uint64)
        a, b = rng.integers(1, 40, 30), rng.integers(1, 40, 30)
        sig = signatures(np.repeat([0, 1], 30), np.tile(s, 2), np.r_[a, b], 2)
        agree.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree)) < 4 * 0.5 / np.sqrt(60 * COMPONENTS)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_chat_folds_events(spark):
    log = [
        (1, 1, 1, "message", "user", "he"), (1, 2, 1, "delta", None, "llo"), (1, 3, 2, "message", "assistant", "bad"), (1, 4, 2, "regenerate", None, "go"), (1, 5, 2, "delta", None, "od </turn>\n\\b"),
        (1, 6, 3, "message", "user", "gone"), (1, 7, 1, "edit", None, "hi"), (1, 8, 2, "message", "assistant", "new<"), (2, 1, 1, "message", "assistant", None), (None, 1, 1, "delta", "user", "x"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat_format(events).select("conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in out}
    # the edit of message 1 withdraws what was said before it in later turns
    assert got[1] == ([("user", "hi"), ("assistant", "new<")], "new<") and got[2] == ([("assistant", "")], "") and got[None] == ([("user", "x")], "")
    assert chat_format(events.limit(0)).count() == 0


def test_chat_of_a_very_long_conversation(spark):
    rows = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat(concat('<', id, '> '), 50) AS text")
    out = chat_format(rows_to_events(rows)).select("n_turns", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert out.n_turns == 3000 and [t.text for t in out.turns] == [f"<{i}> " * 50 for i in range(3000)]
    assert out.loss == "".join(f"<{i}> " * 50 for i in range(1, 3000, 2))


def test_chat_round_trip_of_strange_texts(spark):
    texts = [t for t in strange(100)] + ["\\### Assistant: </turn> ok", "\\b\\l\\g", "<turn user>\nx\n</turn>\n", "", None]
    data = [(i // 3, i % 3, random.Random(i).choice(["user", "assistant", None, "a<b>\\"]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    df = df.unionByName(df.filter("conv_id = 1"))  # repeated rows are turns of their own
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format(rows_to_events(df)).select("conv_id", parse(F.col("formatted")).alias("turns")).collect()}
    want = {}
    for c, t, r, x in sorted(data + [d for d in data if d[0] == 1], key=lambda d: (d[0], d[1], d[2] is not None, d[2] or "", d[3] is not None, d[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert got == want


def test_native_operators_run_no_python(spark):
    for name in ("op5_mixing", "op9_chat"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_digest_of_the_byte_bpe_query(spark):
    got = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
