"""Row-generating operators: propositions, paragraphs, packs and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def propositions(passages: DataFrame) -> DataFrame:
    """(passage_id, proposition_id, sentence, confidence): declarative sentences, numbered before questions go.

    Confidence is 0.6 from five words on, else 0.4. A text without any gives itself, with 0.5.
    """
    declared = lambda s: (s != "") & ~F.endswith(s, F.lit("?"))
    all_ = F.filter(T.sentences(F.col("text")), lambda s: F.trim(s) != "")
    rows = passages.select("passage_id", "text", all_.alias("__s"))
    none = F.size(F.filter("__s", declared)) == 0
    rows = rows.select("passage_id", none.alias("__whole"), F.posexplode(F.when(none, F.array(F.trim("text"))).otherwise(F.col("__s"))).alias("n", "sentence"))
    rows = rows.filter("__whole OR NOT endswith(sentence, '?')").filter("sentence <> ''")
    conf = F.when(F.col("__whole"), 0.5).when(T.word_count(F.col("sentence")) >= 5, 0.6).otherwise(0.4)
    no = (F.col("n") + 1).cast("string")
    # lpad also cuts, so longer numbers stay as they are
    pid = F.concat(F.col("passage_id").cast("string"), F.lit("::P"), F.when(F.length(no) < 3, F.lpad(no, 3, "0")).otherwise(no))
    return rows.select("passage_id", pid.alias("proposition_id"), "sentence", conf.alias("confidence"))


def strip_boilerplate(text: Column, start: str, end: str) -> Column:
    """The text between a line that matches start and one that matches end, as far as they are there."""
    text = F.regexp_replace(text, f"(?is)^.*?{start}[^\\n]*\\n", "")
    return F.trim(F.regexp_replace(text, f"(?is){end}.*$", ""))


def paragraphs(passages: DataFrame, min_words: int, separator: str = r"\n\s*\n+") -> DataFrame:
    """(passage_id, n, paragraph, n_words): white space collapsed; short ones and page numbers left out."""
    rows = passages.select("passage_id", F.posexplode(F.split("text", separator)).alias("n", "paragraph"))
    rows = rows.withColumn("paragraph", F.trim(F.regexp_replace("paragraph", r"\s+", " ")))
    rows = rows.withColumn("n_words", T.word_count(F.col("paragraph")).cast("long"))
    return rows.filter((F.col("n_words") >= min_words) & ~F.col("paragraph").rlike(r"^[0-9ivxlc]+$"))


#: What sentences left over from navigation and style sheets hold.
NOISE = ("mw-parser-output", ".wst-", "login-button", "javascript")


def pack_sentences(passages: DataFrame, close_at: int, keep_tail: int, limit: int | None = None, longer_than: int = 0, noise: Sequence[str] = (), most_words: int | None = None) -> DataFrame:
    """(passage_id, n, pack): sentences joined until a pack has close_at words; a tail of keep_tail words stays.

    Sentences of at most longer_than characters, or with a term of noise, are left out; a pack of more than most_words
    words is dropped. A fold within the row, linear in the sentences; rows are independent.
    """
    state = F.struct(F.array().cast("array<string>").alias("packs"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"))

    def step(s: Column, sentence: Column) -> Column:
        n = s.n + T.word_count(sentence)
        buf = F.array_append(s.buf, sentence)
        full = n >= close_at
        fits = full if most_words is None else full & (n <= most_words)
        return F.struct(
            F.when(fits, F.array_append(s.packs, F.array_join(buf, " "))).otherwise(s.packs).alias("packs"),
            F.when(full, F.array().cast("array<string>")).otherwise(buf).alias("buf"), F.when(full, F.lit(0)).otherwise(n).alias("n"),
        )

    def finish(s: Column) -> Column:
        keep = s.n >= keep_tail
        return F.when(keep if most_words is None else keep & (s.n <= most_words), F.array_append(s.packs, F.array_join(s.buf, " "))).otherwise(s.packs)

    said = F.filter(F.transform(T.sentences(F.col("text")), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))), lambda s: F.length(s) > longer_than)
    if noise:
        said = F.filter(said, lambda s: F.size(T.containing(s, noise)) == 0)
    packs = F.aggregate(said, state, step, finish)
    if limit is not None:
        packs = F.slice(packs, 1, limit)
    return passages.select("passage_id", F.posexplode(packs).alias("n", "pack"))


def word_windows(passages: DataFrame, size: int, step: int, min_words: int, most: int | None = None) -> DataFrame:
    """(passage_id, start, window): windows of ``size`` words; a text of no more than that is one window.

    Windows cover the whole text, or the first ``most`` of them are taken.
    """
    rows = passages.select("passage_id", T.words(F.col("text")).alias("__w")).withColumn("__n", F.size("__w")).filter(F.col("__n") >= min_words)
    end = F.col("__n") - min_words
    last = F.when(F.col("__n") <= size, F.lit(0)).otherwise(end if most is None else F.least(end, F.lit(step * (most - 1))))
    rows = rows.select("passage_id", "__w", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start"))
    return rows.select("passage_id", "start", F.array_join(F.slice("__w", F.col("start") + 1, F.lit(size)), " ").alias("window"))


def parse_records(passages: DataFrame, pattern: str, first_wins: bool = False) -> DataFrame:
    """(passage_id, record_id, body) of records whose pattern has the groups body and id; the last body of an id wins.

    A pattern whose body is a run of characters should begin with what tells a run's beginning, as it is sought everywhere.
    """
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("body"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("record_id"))
    rows = passages.select("passage_id", F.posexplode(pairs).alias("n", "r")).select("passage_id", "n", F.col("r.body").alias("body"), F.col("r.record_id").alias("record_id"))
    pick = F.min_by if first_wins else F.max_by
    return rows.groupBy("passage_id", "record_id").agg(F.trim(pick("body", "n")).alias("body"))
