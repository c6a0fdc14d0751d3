"""Language identification: multinomial naive Bayes over hashed character n-grams.

Tasks count hashed 2- and 3-grams by language; the sums make a log-probability matrix of SLOTS rows and one column
for each language, which is broadcast. A batch of texts is a sparse matrix (the slots of each text's n-grams), and
its scores are the product of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, trim_memory

SLOTS = 1 << 15
#: Code points that are scored at a time, if one text alone does not have more.
CHUNK = 1 << 20
#: Languages that a model can tell apart, at 2 * (SLOTS + 1) doubles each: it bounds the broadcast matrix to 256 MB.
MAX_LANGUAGES = 480
#: Tables of counts that are summed in one group, and so the fan of the tree of sums.
FAN = 64
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t) + 2
    if start < len(texts):
        yield start, len(texts)


def _slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the 2-grams and 3-grams that begin at each code point of ' text ', and where each text begins.

    An n-gram that would pass the end of its text is in the extra slot SLOTS.
    """
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    c = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    two, three = np.full(len(c), SLOTS, np.int64), np.full(len(c), SLOTS, np.int64)
    a = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    two[:-1] = (a ^ a >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17)
    b = a[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    three[:-2] = (b ^ b >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17)
    two[ends - 1] = SLOTS
    three[ends - 1] = three[ends - 2] = SLOTS
    return two, three, ends - lengths


def _lowered(column: pa.Array) -> list[str]:
    # as many code points as before: only the few letters whose lower case has two keep their case
    return [x if len(x := t.lower()) == len(t) else t for t in column.to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in slices(batches, 0):
        texts, langs = _lowered(batch.column("text")), batch.column("lang").to_pylist()
        by: dict[str, list[str]] = {}
        for t, lang in zip(texts, langs, strict=True):
            by.setdefault(lang, []).append(t)
        for lang, own in by.items():
            docs[lang] = docs.get(lang, 0) + len(own)
            held = counts.setdefault(lang, np.zeros((2, SLOTS + 1), np.int64))
            for a, b in _chunks(own):
                two, three, _ = _slots(own[a:b])
                held[0] += np.bincount(two, minlength=SLOTS + 1)
                held[1] += np.bincount(three, minlength=SLOTS + 1)
    part = TaskContext.get().partitionId()
    for lang, n in docs.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "lang": [lang], "docs": [n], "counts": [counts[lang][:, :SLOTS].tobytes()]})
    trim_memory()


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(2 * SLOTS, np.int64)
    for x in table["counts"]:
        total += np.frombuffer(x.as_buffer(), np.int64)
    part = pa.array([table["part"][0].as_py() // FAN], pa.int32())
    return pa.table({"part": part, "lang": [table["lang"][0].as_py()], "docs": [sum(table["docs"].to_pylist())], "counts": [total.tobytes()]})


class NaiveBayes:
    """langs; prior (languages,); two, three: log-probabilities (languages, SLOTS + 1), the last column 0."""

    def __init__(self, langs: list[str], docs: list[int], counts: list[np.ndarray], alpha: float = 0.5):
        self.langs = langs
        self.prior = np.log(np.array(docs, float) / max(1, sum(docs)))
        c = np.array(counts, float).reshape(len(langs), 2, SLOTS) + alpha
        c = np.log(c / c.sum(2, keepdims=True)) if len(langs) else c
        self.two, self.three = (np.pad(c[:, i], ((0, 0), (0, 1))) for i in (0, 1))

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text and its probability."""
        best, sure = [], np.zeros(len(texts))
        for a, b in _chunks(texts):
            two, three, starts = _slots(texts[a:b])
            log = np.array([p + np.add.reduceat(x[two] + y[three], starts) for p, x, y in zip(self.prior, self.two, self.three, strict=True)])
            top = log.argmax(0)
            sure[a:b] = 1 / np.exp(log - log.max(0)).sum(0)
            best += [self.langs[i] for i in top]
        return best, sure


def train_language_id(labelled: DataFrame, max_languages: int = MAX_LANGUAGES) -> NaiveBayes:
    """A model of all rows of (text, lang); rows with a null are left out. Only the sums reach the driver.

    The tasks' tables are summed in a tree, FAN at a time. More than max_languages languages are an error, since the
    model is broadcast.
    """
    rows = labelled.select("text", "lang").dropna()
    schema = "part int, lang string, docs long, counts binary"
    found, parts = rows.mapInArrow(_count, schema), rows.rdd.getNumPartitions()
    while True:
        found = found.groupBy("lang", F.expr(f"part div {FAN}").alias("up")).applyInArrow(_sum, schema)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    with small_batches(labelled.sparkSession):
        sums = found.limit(max_languages + 1).collect()
    if len(sums) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    sums.sort(key=lambda r: r.lang)
    return NaiveBayes([r.lang for r in sums], [r.docs for r in sums], [np.frombuffer(r.counts, np.int64) for r in sums])


def predict_language(documents: DataFrame, model: NaiveBayes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row; only the text is an input.

    A text that is null or has no letter (a code point of category L; numerals like ² or Ⅷ are none) is ``und`` with score 0, as is every text if nothing was learned. Ties go to
    the first language by name. Other columns are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            there = [i for i, t in enumerate(texts) if t is not None and model.langs and _LETTER.search(t)]
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if there:
                lang[there], score[there] = model.score(_lowered(pa.array([texts[i] for i in there])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
        trim_memory()

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def language_id(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the labelled rows that are not held out, and predict all: (doc_id, held_out, lang_pred, score)."""
    labelled = documents.filter(~held_out(id_col)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out = predict_language(documents, train_language_id(labelled), id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
