"""Linear classifiers of texts over hashed TF-IDF features, for many left-out groups in one pass.

Terms are hashed into WIDTH slots, so that a model has a size of its own, whatever the vocabulary. Tasks take some rows
each and learn on them by averaged passive-aggressive steps, one class against the rest, for all folds at once: a row
does not count for the fold that leaves its group out, and each fold weighs terms by the documents that it sees. The
tasks' weights are averaged in a tree, and the next round begins with the mean.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .learn import classification_summary

#: Slots; folds that are fitted together; rows that a task learns on; rounds, and passes within each.
WIDTH, FOLDS, PART_ROWS, ROUNDS, PASSES = 1 << 13, 16, 1024, 2, 3
#: Tables of weights that are averaged in one group; classes at most.
FAN, MAX_CLASSES = 64, 64


def hashed_terms(texts: DataFrame, bigrams: bool = True) -> DataFrame:
    """(key, label, fold, slots array<int>) of (key, label, fold, text): a slot for each word, and each two neighbours."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)
    rows = texts.select("key", "label", "fold", words.alias("w"))
    terms = F.col("w")
    if bigrams:
        pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        terms = F.concat("w", pairs)
    return rows.select("key", "label", "fold", F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(WIDTH)).cast("int")).alias("slots"))


def _row(slots: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's slots and, for each fold, their TF-IDF weights at length 1."""
    own, n = np.unique(slots, return_counts=True)
    x = n * idf[:, own]
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return own, x / np.where(length > 0, length, 1)


def fit_part(rows: Sequence[tuple[np.ndarray, int, int]], idf: np.ndarray, weights: np.ndarray, passes: int) -> np.ndarray:
    """Mean weights (folds, classes, WIDTH) over the steps of (slots, class, fold left out or -1), from the given ones."""
    folds, classes, width = weights.shape
    # a slot's weights lie together, and single precision is what tasks send
    w = np.ascontiguousarray(weights.transpose(2, 0, 1), np.float32)
    lag, steps = np.zeros_like(w), 0  # lag: steps times what was added then; the mean is w - lag / steps
    prepared = []
    for slots, y, out in rows:
        own, x = _row(slots, idf)
        prepared.append((own, np.ascontiguousarray(x.T, np.float32)[:, :, None], y, out))
    sign = (-np.ones((classes, classes)) + 2 * np.eye(classes)).astype(np.float32)
    for _ in range(passes):
        for own, x, y, out in prepared:
            part = w[own]
            loss = np.maximum(0, 1 - sign[y] * (part * x).sum(0))
            if out >= 0:
                loss[out] = 0
            if loss.any():
                change = (np.minimum(1, loss) * sign[y]) * x
                part += change
                w[own] = part
                change *= steps
                lag[own] += change
            steps += 1
    return (w - lag / steps if steps else w).transpose(1, 2, 0).astype(float)


class HashedModel:
    """Weights of some folds: scores each row by one of them."""

    def __init__(self, classes: list[str], idf: np.ndarray, weights: np.ndarray):
        self.classes, self.idf, self.weights = classes, idf, weights

    def predict(self, slots: np.ndarray, fold: int) -> str:
        own, x = _row(slots, self.idf[fold : fold + 1])
        return self.classes[int(np.round(self.weights[fold][:, own] @ x[0], 9).argmax())]  # ties to the first by name


def _slots(column: pa.Array) -> list[np.ndarray]:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return np.split(column.flatten().to_numpy(), np.cumsum([len(x) for x in column])[:-1]) if len(column) else []


def fit_folds(rows: DataFrame, folds: Sequence[str | None]) -> HashedModel:
    """Fit some folds of (key, label, fold, slots) together; a fold is the group that it leaves out, or None for all rows.

    Rows without a label are left out. The driver gets one table of weights, of FOLDS x classes x WIDTH numbers.
    """
    spark = rows.sparkSession
    rows = rows.filter("label IS NOT NULL")
    classes = sorted(r.label for r in rows.select("label").distinct().limit(MAX_CLASSES + 1).collect())
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    place, out = {c: i for i, c in enumerate(classes)}, {f: i for i, f in enumerate(folds) if f is not None}
    n = {r.fold: r.n for r in rows.groupBy("fold").agg(F.count("*").alias("n")).filter(F.col("fold").isin(list(out)) if out else F.lit(False)).collect()}
    total = rows.count()
    seen = rows.select("fold", F.explode(F.array_distinct("slots")).alias("slot"))
    df = np.zeros(WIDTH)
    for slot, k in seen.groupBy("slot").count().collect():
        df[slot] = k
    idf = np.zeros((len(folds), WIDTH))
    own_df = np.zeros((len(folds), WIDTH))
    for fold, slot, k in seen.filter(F.col("fold").isin(list(out))).groupBy("fold", "slot").count().collect() if out else ():
        own_df[out[fold], slot] = k
    for i, f in enumerate(folds):
        idf[i] = np.log((1 + total - n.get(f, 0)) / (1 + df - own_df[i])) + 1
    parts = max(1, -(-total // PART_ROWS))
    weights = np.zeros((len(folds), len(classes), WIDTH))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    schema = "at int, part long, n long, weights binary"
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((idf, weights))

        def learn(table: pa.Table) -> pa.Table:
            idf, start = sent.value
            table = table.sort_by([("key", "ascending"), ("label", "ascending")])
            own = [(s, place[y], out.get(f, -1)) for s, y, f in zip(_slots(table["slots"]), table["label"].to_pylist(), table["fold"].to_pylist(), strict=True)]
            w = fit_part(own, idf, start, PASSES)
            return pa.table({"at": pa.array(range(len(w)), pa.int32()), "part": pa.array([table["part"][0].as_py() // FAN] * len(w), pa.int64()), "n": pa.array([len(own)] * len(w), pa.int64()), "weights": [x.astype(np.float32).tobytes() for x in w]})

        def mean(table: pa.Table) -> pa.Table:
            n = table["n"].to_numpy()
            w = sum(k * np.frombuffer(x.as_buffer(), np.float32).astype(float) for k, x in zip(n, table["weights"], strict=True)) / n.sum()
            return pa.table({"at": pa.array([table["at"][0].as_py()], pa.int32()), "part": pa.array([table["part"][0].as_py() // FAN], pa.int64()), "n": [int(n.sum())], "weights": [w.astype(np.float32).tobytes()]})

        found, left = dealt.groupBy("part").applyInArrow(learn, schema), -(-parts // FAN)
        while True:
            found = found.groupBy("at", "part").applyInArrow(mean, schema)
            if left <= 1:
                break
            left = -(-left // FAN)
        for r in found.collect():
            weights[r.at] = np.frombuffer(r.weights, np.float32).reshape(len(classes), WIDTH)
        sent.destroy()
    return HashedModel(classes, idf, weights)


def predict_folds(model: HashedModel, rows: DataFrame, folds: Sequence[str | None]) -> DataFrame:
    """(key, fold, truth, predicted): each row of (key, label, fold, slots) by the model that leaves its fold out, or by
    the only one; rows of other folds are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    one = list(folds) == [None]
    place = {f: i for i, f in enumerate(folds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [0 if one else place[f] for f in batch.column(2).to_pylist()]
            said = [sent.value.predict(s, i) for s, i in zip(_slots(batch.column(3)), at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(said, pa.string())], ["key", "fold", "truth", "predicted"])

    asked = rows if one else rows.filter(F.col("fold").isin(list(folds)))
    kinds = dict(asked.dtypes)
    return asked.select("key", "label", "fold", "slots").mapInArrow(run, f"key {kinds['key']}, fold {kinds['fold']}, truth string, predicted string")


def leave_group_out_linear(texts: DataFrame, least_test: int = 2, least_train: int = 5, bigrams: bool = True) -> DataFrame:
    """(key, fold, truth, predicted) of (key, label, fold, text): each group by a classifier trained on all the others.

    Groups of fewer than ``least_test`` rows, or with fewer than ``least_train`` rows outside, are skipped, as are rows
    whose label or fold is null. FOLDS groups are fitted in one pass over the rows.
    """
    rows = written(hashed_terms(texts.filter("label IS NOT NULL AND fold IS NOT NULL"), bigrams))
    sizes = rows.groupBy("fold").agg(F.count("*").alias("n")).collect()  # a row for each group
    total = sum(r.n for r in sizes)
    folds = sorted(r.fold for r in sizes if r.n >= least_test and total - r.n >= least_train)
    out = None
    for at in range(0, len(folds), FOLDS):
        own = folds[at : at + FOLDS]
        found = predict_folds(fit_folds(rows, own), rows, own)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], f"key {dict(rows.dtypes)['key']}, fold string, truth string, predicted string") if out is None else out


def fold_summary(predictions: DataFrame) -> DataFrame:
    """(n_folds, mean_top1, mean_macro_f1) over the folds."""
    own = classification_summary(predictions, ["fold"])
    return own.agg(F.count("*").alias("n_folds"), F.avg("top1").alias("mean_top1"), F.avg("macro_f1").alias("mean_macro_f1"))
