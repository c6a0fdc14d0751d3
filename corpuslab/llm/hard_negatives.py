"""Hard-negative mining: windows of scores, bounded along a spanning tree of the anchors.

Anchors lie in tiles of near ones, each with a minimum spanning tree. A candidate's score at an anchor is at most the
edge to the parent anchor times the candidate's norm away from its score there, and so from any bounds of it. Down the
tree, these bounds decide which candidates can be in a window of the anchor at all; only those are scored.

Candidates never move: each round broadcasts a bounded number of tiles, and every task takes its own rows past them,
keeping the first few rows of each window. What tasks keep is merged by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dense, materialize, release, scratch, trim_memory
from .topk_search import sign_code, whole_vectors

#: Anchors in a tile, candidates that a task scores together, and tiles that a round broadcasts (2^16 anchors: 32 MB at
#: 64 dimensions, and for each task as many windows).
TILE, BLOCK, TILES = 256, 4096, 256

_TILE = "part int, seq int, ids binary, labels binary, dims int, matrix binary, parent binary, edge binary"
_FAR = np.iinfo(np.int64).max


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree of the rows: parents come first and are places in the order."""
    n = len(m)
    x = m.astype(float)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    away, via, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at = 0
    for step in range(n):
        order[step], parent[step], edge[step] = at, via[at], away[at] if step else 0
        left[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        nearer = left & (d < away)
        away[nearer], via[nearer] = d[nearer], step
        at = int(np.where(left, away, np.inf).argmin()) if left.any() else 0
    return order, parent, edge * (1 + 2.0**-40)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            rows = batch.slice(at, TILE)
            m = dense(rows.column(2))
            order, parent, edge = spanning_tree(m)
            ids, labels = (rows.column(i).to_numpy()[order] for i in (0, 1))
            packed = {"ids": ids, "labels": labels, "matrix": m[order], "parent": parent.astype(np.int64), "edge": edge}
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), **{k: [v.tobytes()] for k, v in packed.items()}, "dims": pa.array([m.shape[1]], pa.int32())}).select([x.split()[0] for x in _TILE.split(", ")])
            seq += 1


class Tile:
    """Anchors in the order of their tree, and for each the windows (slot, low, high) that rows are sought for."""

    def __init__(self, row, windows: dict[int, list[tuple]] | None, k: int):
        self.ids, self.labels, self.parent = (np.frombuffer(row[x], np.int64) for x in ("ids", "labels", "parent"))
        self.edge = np.frombuffer(row["edge"], float)
        self.m = np.frombuffer(row["matrix"], np.int64).reshape(len(self.ids), row["dims"])
        # a positive: any score, the anchor's label; a negative: a window of scores, another label
        self.same = windows is None
        self.windows = [[(1, 0, 0, -_FAR, _FAR)]] * len(self.ids) if windows is None else [windows.get(i, []) for i in self.ids.tolist()]
        self.k = k

    def begin(self) -> None:
        """A task's own state: what it has found for each window, and the least score that still counts."""
        self.found = [[(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in w] for w in self.windows]
        self.least = [[x[3] for x in w] for w in self.windows]

    def scan(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, norm: np.ndarray) -> int:
        """Take a block of candidates; gives the number of scores that were computed."""
        dims = max(m.shape[1], self.m.shape[1])
        m, q = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (m, self.m))
        if dims * float(abs(q).max(initial=0)) * float(abs(m).max(initial=0)) < 2.0**53:  # sums are exact as doubles
            q, m = q.astype(float), m.astype(float)
        of_label = {x: labels == x for x in np.unique(self.labels).tolist()}
        low, high, scored = [None] * len(q), [None] * len(q), 0
        for i, up in enumerate(self.parent.tolist()):
            if up < 0:
                below = above = None
            else:
                slack = self.edge[i] * norm
                below, above = low[up] - slack, high[up] + slack
                slack = (abs(below) + abs(above)) * 2.0**-40
                below, above = below - slack, above + slack
            least, most = min(self.least[i], default=_FAR), max((x[4] for x in self.windows[i]), default=-_FAR)
            can = of_label[self.labels[i].item()]
            can = (can if self.same else ~can) & (ids != self.ids[i])
            if up >= 0:
                can &= (above >= least) & (below <= most)
            rows = np.arange(len(m)) if up < 0 else np.flatnonzero(can)
            s = (m if len(rows) == len(m) else m[rows]) @ q[i]
            scored += len(rows)
            if up < 0:
                low[i] = high[i] = s.astype(float)
                rows, s = rows[can], s[can]
            else:
                below[rows] = above[rows] = s
                low[i], high[i] = below, above
            within = (s >= least) & (s <= most)
            rows, s = rows[within], s[within].astype(np.int64)
            if len(rows):
                self._keep(i, ids[rows], s)
        return scored

    def _keep(self, i: int, ids: np.ndarray, s: np.ndarray) -> None:
        order = np.lexsort((ids, -s))
        ids, s = ids[order], s[order]
        for j, (_, _, _, _, most) in enumerate(self.windows[i]):
            at = np.searchsorted(-s, -most)
            end = min(at + self.k, np.searchsorted(-s, -self.least[i][j], "right"))
            if end > at:
                a, b = (np.concatenate(x) for x in zip(self.found[i][j], (ids[at:end], s[at:end]), strict=True))
                order = np.lexsort((a, -b))[: self.k]
                self.found[i][j] = a[order], b[order]
                if len(order) == self.k:
                    self.least[i][j] = int(b[order[-1]])

    def result(self) -> Iterator[tuple]:
        for i, anchor in enumerate(self.ids.tolist()):
            for (slot, positive, score, _, _), (ids, s) in zip(self.windows[i], self.found[i], strict=True):
                for a, b in zip(ids.tolist(), s.tolist(), strict=True):
                    yield anchor, slot, positive, score, a, b


_FOUND = "anchor_id long, slot int, positive_id long, positive_score long, vec_id long, score long"


def _pass(tiles: Callable[[], list[Tile]]) -> Callable:
    """Each task takes its rows (vec_id, label, v) past all tiles and then gives what it has kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tiles()
        for tile in own:
            tile.begin()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                m = dense(rows.column(2))
                norm = np.sqrt((m.astype(float) ** 2).sum(1)) * (1 + 2.0**-40)
                for tile in own:
                    tile.scan(rows.column(0).to_numpy(), rows.column(1).to_numpy(), m, norm)
        for tile in own:
            if found := list(tile.result()):
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])
        trim_memory()

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each anchor and slot, with their rank."""
    rank = F.row_number().over(W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score): for each anchor and each of its
    positives, the first ``negatives`` rows of other labels that score least to most percent of the positive.

    Both tables are (vec_id long, label long, v array<long>), without nulls. An anchor's positives are its first other
    rows of the same label. A row's score is its inner product with the anchor; higher scores come first, then smaller
    ids. Every row with an id other than the anchor's is a candidate, also if rows share an id; of anchors that share
    an id the least by (label, v) asks. Where the positive's score is negative there is no row between. Shorter vectors
    end in zeros. Sums must fit 64 bits. Empty tables give no rows.
    """
    spark, held = rows.sparkSession, []
    rows = rows.select("vec_id", "label", "v")
    one = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    one = materialize(one.withColumn("code", sign_code("v")), held)
    count = one.count()
    near = one.repartitionByRange(max(1, -(-count // (4 * TILE))), "label", "code", "vec_id").sortWithinPartitions("label", "code", "vec_id")
    tiles = materialize(near.select("vec_id", "label", "v").mapInArrow(_tiles, _TILE), held)
    before, total = {}, 0
    for part, n in sorted(map(tuple, tiles.groupBy("part").count().collect())):  # a row for each task that packed tiles
        before[part], total = total, total + n
    number = F.lit(0)
    if before:
        offset = spark.createDataFrame(sorted(before.items()), "part int, before long")
        tiles = tiles.join(F.broadcast(offset), "part")
        number = F.col("before") + F.col("seq")
    tiles = tiles.withColumn("round", F.floor(number / TILES))

    def rounds(k: int, known: DataFrame | None) -> DataFrame:
        path = scratch(spark)
        held.append(path)
        spark.createDataFrame([], f"{_FOUND}, rank int, round int").write.parquet(path)
        for r in range(-(-total // TILES)):
            packed = [x.asDict() for x in tiles.filter(F.col("round") == r).collect()]  # TILES rows at most
            windows = None
            if known is not None:
                windows = {}
                for x in known.filter(F.col("round") == r).collect():  # as many for each anchor as there are positives
                    low, high = -(-least * x.score // 100), most * x.score // 100
                    if low <= high:
                        windows.setdefault(x.anchor_id, []).append((x.rank, x.vec_id, x.score, low, high))
            sent = spark.sparkContext.broadcast([Tile(x, windows, k) for x in packed])
            _first(rows.mapInArrow(_pass(lambda sent=sent: sent.value), _FOUND), k).withColumn("round", F.lit(r)).write.mode("append").parquet(path)
            sent.destroy()
        return spark.read.schema(f"{_FOUND}, rank int, round int").parquet(path)

    known = rounds(positives, None)
    out = materialize(rounds(negatives, known).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    release(spark, held)
    return out


def labelled_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shift: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: none with a null id or label, nor a vector that is null or holds
    null, NaN or an infinity. Where ``shift`` divides the id, the label is first moved on by one, modulo ``labels``."""
    moved = F.when(F.col(id_col) % shift == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))
    return whole_vectors(vectors.filter(F.col(label_col).isNotNull()), id_col=id_col, vector_col=vector_col, label=moved.cast("long"))
