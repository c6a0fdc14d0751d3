"""Scores of passages against fingerprints, vectors and texts against each other."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Metrics over a group of (x, t, w) rows without nulls.
METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "weighted_jaccard": lambda x, t, w: F.try_divide(F.sum(w * F.least(x, t)), F.sum(w * F.greatest(x, t))),
    "jaccard": lambda x, t, w: F.try_divide(F.sum(F.least(x, t)), F.sum(F.greatest(x, t))),
    "dice": lambda x, t, w: F.try_divide(2 * F.sum(x * t), F.sum(x) + F.sum(t)),
}


def theory_scores(values: DataFrame, fingerprints: DataFrame, metric: str = "weighted_jaccard") -> DataFrame:
    """(passage_id, theory_id, score): null values are in neither sum; a score without a sum is 0.

    values: (passage_id, feature_id, value); fingerprints: (theory_id, feature_id, t, w), a small dimension.
    """
    rows = values.join(F.broadcast(fingerprints), "feature_id").withColumn("x", F.col("value"))
    known = F.col("x").isNotNull()
    x, t, w = (F.when(known, F.col(c).cast("double")) for c in ("x", "t", "w"))
    return rows.groupBy("passage_id", "theory_id").agg(F.coalesce(METRICS[metric](x, t, w), F.lit(0.0)).alias("score"))


def specificity(scores: DataFrame, quantum: Sequence[str], classical: Sequence[str]) -> DataFrame:
    """(passage_id, qs): the highest quantum score minus the highest classical one; a side without scores is 0."""
    top = lambda ids: F.coalesce(F.max(F.when(F.col("theory_id").isin(*ids), F.col("score"))), F.lit(0.0))
    return scores.groupBy("passage_id").agg((top(quantum) - top(classical)).alias("qs"))


def exclusive_share(values: DataFrame, exclusive: Sequence[str]) -> DataFrame:
    """(passage_id, qef): positives among the exclusive features that have a value; 0 if none has."""
    own = F.col("feature_id").isin(*exclusive) & F.col("value").isNotNull()
    hit = F.sum(F.when(own & (F.col("value") == 1), 1).otherwise(0))
    return values.groupBy("passage_id").agg(F.coalesce(F.try_divide(hit, F.sum(own.cast("int"))), F.lit(0.0)).alias("qef"))


def field_class(values: DataFrame, core: Sequence[str], quantum: Sequence[str], substrate: Sequence[str]) -> DataFrame:
    """(passage_id, n_core, has_quantum, field_class)."""
    on = F.col("value") == 1
    some = lambda ids: F.coalesce(F.max(on & F.col("feature_id").isin(*ids)), F.lit(False))
    out = values.groupBy("passage_id").agg(F.count_if(on & F.col("feature_id").isin(*core)).alias("n_core"), some(quantum).alias("has_quantum"), some(substrate).alias("__s"))
    cls = (
        F.when((F.col("n_core") == 0) & ~F.col("__s"), "insufficient")
        .when(F.col("has_quantum") & (F.col("n_core") >= 2), "potentially_qft_like")
        .when(~F.col("has_quantum") & (F.col("n_core") >= 3), "classical_field_like")
        .when(~F.col("has_quantum") & (F.col("n_core") >= 2), "field_like")
        .otherwise("metaphor_substrate_only")
    )
    return out.withColumn("field_class", cls).drop("__s")


def ranks(scores: DataFrame, by: Sequence[str] = ("passage_id",), item: str = "theory_id") -> DataFrame:
    """Add rank from 1 by descending score, ties by item."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), item)))


def binary_pairs(fingerprints: DataFrame) -> DataFrame:
    """(a, b, jaccard, hamming) of each pair a < b of (theory_id, feature_id, t); a missing feature is 0."""
    left = fingerprints.select(F.col("theory_id").alias("a"), "feature_id", F.col("t").alias("ta"))
    right = fingerprints.select(F.col("theory_id").alias("b"), "feature_id", F.col("t").alias("tb"))
    pairs = left.join(right, "feature_id").filter("a < b")
    both = F.count_if((F.col("ta") == 1) & (F.col("tb") == 1))
    either = F.count_if((F.col("ta") == 1) | (F.col("tb") == 1))
    return pairs.groupBy("a", "b").agg(F.coalesce(F.try_divide(both, either), F.lit(0.0)).alias("jaccard"), F.count_if(F.col("ta") != F.col("tb")).alias("hamming"))


def nearest(pairs: DataFrame, least: float = 0.85) -> DataFrame:
    """(theory_id, nearest, jaccard, near_identical) from pairs a < b."""
    both = pairs.select(F.col("a").alias("theory_id"), F.col("b").alias("other"), "jaccard").unionByName(pairs.select(F.col("b").alias("theory_id"), F.col("a").alias("other"), "jaccard"))
    best = F.row_number().over(W.partitionBy("theory_id").orderBy(F.desc("jaccard"), "other"))
    return both.withColumn("r", best).filter("r = 1").select("theory_id", F.col("other").alias("nearest"), "jaccard", (F.col("jaccard") >= least).alias("near_identical"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def terms(texts: DataFrame, keys: Sequence[str], bigrams: bool = False) -> DataFrame:
    """(keys, term, tf): lower-case words of two or more word characters, and pairs of neighbours."""
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) >= 2)
    all_ = w
    if bigrams:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        all_ = F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))
    return texts.select(*keys, F.explode(all_).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, key: str, n_docs: DataFrame | None = None) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), scaled to length 1. n is the number of keys."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))  # a key has a term once
    n = n_docs if n_docs is not None else counts.agg(F.countDistinct(key).alias("n"))
    rows = counts.join(df, "term").crossJoin(F.broadcast(n))
    rows = rows.withColumn("raw", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return rows.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def mean_pair_similarity(weights: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """(mean_similarity) of all pairs of a side-A and a side-B text: the product of the two summed vectors.

    side: (key, side 'A'/'B'). No pair is built. Weights may have their text's side already, once for each of its rows.
    """
    rows = weights if "side" in weights.columns else weights.join(side, key)
    n = side.agg((F.count_if(F.col("side") == "A") * F.count_if(F.col("side") == "B")).alias("n"))
    sums = rows.groupBy("term").agg(F.coalesce(F.sum(F.when(F.col("side") == "A", F.col("weight"))), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(F.col("side") == "B", F.col("weight"))), F.lit(0.0)).alias("b"))
    return sums.agg(F.sum(F.col("a") * F.col("b")).alias("dot")).crossJoin(n).select((F.col("dot") / F.col("n")).alias("mean_similarity"))


def hash_embedding(texts: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, dim, value): each distinct word adds +1 or -1 to one dimension, by its hash; scaled to length 1."""
    w = F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: x != "")).alias("w")
    h = F.md5(F.col("w").cast("binary"))
    digits = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long")
    rows = texts.select(key, w).select(key, (digits(1, 8) % dims).cast("int").alias("dim"), F.when(digits(9, 1) < 8, 1.0).otherwise(-1.0).alias("s"))
    sums = rows.groupBy(key, "dim").agg(F.sum("s").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(key)))
    return sums.select(key, "dim", F.coalesce(F.try_divide(F.col("v"), norm), F.lit(0.0)).alias("value"))


#: Words whose vectors a task remembers, and words of a text that are summed at a time.
REMEMBERED, TOGETHER = 1 << 15, 1 << 13


def token_vector(token: str, dims: int, seed: str) -> np.ndarray:
    """The normal vector that seed and token name, the same in any task."""
    key = int.from_bytes(hashlib.sha256(f"{seed}|{token}".encode("utf-8", "surrogatepass")).digest()[:16], "little")
    return np.random.Generator(np.random.Philox(key=key)).standard_normal(dims)


def token_vectors(dims: int, seed: str) -> Callable[[str], np.ndarray]:
    """token_vector for token after token: one generator, whose key is set for each."""
    bits = np.random.Philox(key=0)
    normal, fresh = np.random.Generator(bits), bits.state

    def draw(token: str) -> np.ndarray:
        key = hashlib.sha256(f"{seed}|{token}".encode("utf-8", "surrogatepass")).digest()[:16]
        fresh["state"]["key"][:] = np.frombuffer(key, "<u8")
        bits.state = fresh
        return normal.standard_normal(dims)

    return draw


class Remembered:
    """Vectors of words, drawn where they are missed; when there is no room, the half that was asked for most stays."""

    def __init__(self, draw: Callable[[str], np.ndarray], dims: int, room: int):
        self.draw, self.room = draw, room
        self.place: dict[str, int] = {}
        self.vectors, self.asked = np.empty((room, dims)), np.zeros(room)

    def rows(self, tokens: Sequence[str]) -> np.ndarray:
        """The vectors of at most room / 2 different words."""
        if len(self.place) + sum(t not in self.place for t in tokens) > self.room:
            self._drop()
        at = np.empty(len(tokens), np.int64)
        for i, token in enumerate(tokens):
            k = self.place.get(token)
            if k is None:
                k = self.place[token] = len(self.place)
                self.vectors[k], self.asked[k] = self.draw(token), 0
            at[i] = k
        self.asked[at] += 1
        return self.vectors[at]

    def _drop(self) -> None:
        names = list(self.place)  # in the order of their places
        kept = np.sort(np.argsort(-self.asked[: len(names)], kind="stable")[: self.room // 2])
        self.vectors[: len(kept)], self.asked[: len(kept)] = self.vectors[kept], self.asked[kept] / 2
        self.place = {names[k]: i for i, k in enumerate(kept.tolist())}


def random_projection(texts: DataFrame, key: str, dims: int = 256, seed: str = "42") -> DataFrame:
    """(key, vector array<double>): the sum of the normal vectors of a text's words (between white space, in lower case),
    scaled to length 1; zeros for a text without words. Vectors are drawn in the tasks, by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Remembered(token_vectors(dims, seed), dims, REMEMBERED)
        step = min(TOGETHER, REMEMBERED // 2)
        for batch in batches:
            out = np.zeros((batch.num_rows, dims))
            for i, low in enumerate(batch.column(1).to_pylist()):
                counts = Counter((low or "").split())
                tokens, n = list(counts), np.array(list(counts.values()), float)
                for start in range(0, len(tokens), step):
                    out[i] += n[start : start + step] @ held.rows(tokens[start : start + step])
                length = np.linalg.norm(out[i])
                if length > 0:
                    out[i] /= length
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(out.ravel(), dims).cast(pa.list_(pa.float64()))], [key, "vector"])

    rows = texts.select(key, F.lower("text").alias("low"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, vector array<double>")


def attestation(required: DataFrame, records: DataFrame, pattern: str) -> DataFrame:
    """(check_id, ids_ok, pattern_ok, pass_ref) of (check_id, record_id): are all there, and does their text match?"""
    rows = required.join(records, "record_id", "left")
    out = rows.groupBy("check_id").agg((F.count("body") == F.count("*")).alias("ids_ok"), F.concat_ws(" ", F.sort_array(F.collect_list("body"))).alias("__t"))
    return out.select("check_id", "ids_ok", F.col("__t").rlike(pattern).alias("pattern_ok"), (F.col("ids_ok") & (F.trim("__t") != "")).alias("pass_ref"))
