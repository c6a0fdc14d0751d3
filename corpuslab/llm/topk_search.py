"""Exact top-k search by inner product, block at a time.

Vectors are packed into blocks, in the order of the signs of their first dimensions and then of their ids, so that like
vectors are neighbours. Each block has a forward index (its matrix) and, for each term (dimension), the largest and
smallest weight; neighbouring blocks form groups, which have these too. For a query, the summed term
maxima bound every score in a block or group. First, each query searches the group with its highest bound, which gives
it a k-th score. From these, tiles of queries and groups are paired only where some query's bound reaches its k-th
score, before any vector moves. In a group, a query takes the blocks in the order of their bounds and stops once the
bound is below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dense, join_hot, materialize, partitions, trim_memory

#: Vectors in a block; blocks that one task scores; queries in a tile. They bound a task's memory.
BLOCK, GROUP, TILE = 512, 32, 2048
#: Groups whose summaries a task looks at together.
SUMMARIES = 4096
#: Dimensions whose signs order the vectors.
SIGNS = 12

_PACKED = "dims int, ids binary, matrix binary, up binary, down binary"


def whole_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", **others: Column) -> DataFrame:
    """(vec_id long, others, v array<long>) with floor(scale * x) of each component, of every row with an id and a
    vector that is not null and holds no null, NaN or infinity."""
    x = F.col(vector_col).cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return vectors.filter(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), *[c.alias(k) for k, c in others.items()], v.alias("v"))


def sign_code(v: str) -> Column:
    """A number of the signs of a vector's first dimensions."""
    return F.aggregate(F.slice(v, 1, SIGNS), F.lit(0), lambda a, x: a * 2 + (x > 0).cast("int"))


def _matrix(ids: pa.Array | pa.ChunkedArray, vectors: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return ids.to_numpy(), dense(vectors)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            ids, m = _matrix(rows.column(0), rows.column(1))
            yield pa.RecordBatch.from_pydict({"dims": pa.array([m.shape[1]], pa.int32()), "ids": [ids.tobytes()], "matrix": [m.tobytes()], "up": [m.max(0).tobytes()], "down": [m.min(0).tobytes()]})


def _unpack(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each packed row."""
    out = []
    for dims, ids, m in zip(table["dims"].to_pylist(), table["ids"], table["matrix"], strict=True):
        ids = np.frombuffer(ids.as_buffer(), np.int64)
        out.append((ids, np.frombuffer(m.as_buffer(), np.int64).reshape(len(ids), dims) if dims else np.zeros((len(ids), 0), np.int64)))
    return out


def _wide(m: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def _summaries(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(up, down) of each row; a vector with fewer dimensions has zeros in the others."""
    rows = [np.stack([_wide(np.frombuffer(table[x][i].as_buffer(), np.int64)[None], dims)[0] for i in range(table.num_rows)]) for x in ("up", "down")]
    return rows[0], rows[1]


def _merge_summaries(table: pa.Table) -> pa.Table:
    up, down = _summaries(table, max(table["dims"].to_pylist()))
    short = min(table["dims"].to_pylist())
    up, down = up.max(0), down.min(0)
    up[short:], down[short:] = np.maximum(up[short:], 0), np.minimum(down[short:], 0)
    return pa.table({"g": pa.array([table["g"][0].as_py()], pa.int64()), "dims": pa.array([len(up)], pa.int32()), "up": [up.tobytes()], "down": [down.tobytes()]})


def _bounds(q: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Sums of term maxima, (queries, rows): exact as whole numbers if they fit a double, rounded up a little if not."""
    q, up, down = q.astype(float), up.astype(float), down.astype(float)
    out = np.maximum(q, 0) @ up.T + np.minimum(q, 0) @ down.T
    return out + np.abs(out) * 2.0**-40


def search_blocks(queries: list, blocks: list, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, best ids, best scores) with k columns; an id of -1 with the least score is no result.

    least: for each query a score that k others reach already; what is below is not sought.
    """
    dims = max(m.shape[1] for _, m in queries + blocks)
    qid = np.concatenate([i for i, _ in queries])
    q = np.concatenate([_wide(m, dims) for _, m in queries])
    least = np.full(len(q), -np.inf) if least is None else least
    blocks = [(i, _wide(m, dims)) for i, m in blocks]
    top = max([abs(m).max(initial=0) for _, m in blocks], default=0)
    bound = _bounds(q, np.array([m.max(0) for _, m in blocks]), np.array([m.min(0) for _, m in blocks]))
    if dims * float(abs(q).max(initial=0)) * float(top) < 2.0**53:  # sums are exact as doubles, whose products are faster
        q, blocks = q.astype(float), [(i, m.astype(float)) for i, m in blocks]
    none = -np.inf if q.dtype == float else np.iinfo(np.int64).min
    order = np.argsort(-bound, axis=1, kind="stable")
    ids, scores = np.full((len(q), k), -1, np.int64), np.full((len(q), k), none, q.dtype)
    active = np.arange(len(q))
    for step in range(len(blocks)):
        block = order[active, step]
        # a bound that equals the k-th score may still hide a tie with a smaller id
        go = (bound[active, block] >= least[active]) & ((bound[active, block] >= scores[active, -1]) | (ids[active, -1] < 0))
        active, block = active[go], block[go]
        if not len(active):
            break
        for b in np.unique(block):
            own = active[block == b]
            bid, m = blocks[b]
            s = q[own] @ m.T
            s = np.where(qid[own][:, None] == bid[None, :], none, s)
            s = np.concatenate([scores[own], s], axis=1)
            i = np.concatenate([ids[own], np.where(qid[own][:, None] == bid[None, :], -1, bid[None, :])], axis=1)
            best = np.lexsort((np.where(i < 0, np.iinfo(np.int64).max, i), -s if s.dtype == float else ~s), axis=1)[:, :k]
            scores[own], ids[own] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
    return qid, ids, scores


def exact_top_k(items: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank int from 1, vec_id, score long): each query's k highest inner products with the items.

    Both tables are (vec_id, v array<long>). Every item is a candidate, also where items share an id, but those with the
    query's own id; of queries that share an id the one of the least vector asks. Ties go to the smaller id; a query has
    fewer rows where there are fewer items. Shorter vectors end in zeros. Sums must fit 64
    bits. No task holds more than TILE queries and GROUP blocks, or SUMMARIES groups' summaries.
    """
    spark = items.sparkSession

    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    ranged = items.select("vec_id", "v", sign_code("v").alias("code")).repartitionByRange(partitions(spark), "code", "vec_id").sortWithinPartitions("code", "vec_id")
    blocks = ranged.select("vec_id", "v").mapInArrow(_pack, _PACKED).withColumn("block", F.monotonically_increasing_id())
    # GROUP neighbours of a partition: its number is in the upper bits of the block's
    blocks = materialize(blocks.withColumn("g", F.shiftleft(F.shiftright("block", 33), 28) + F.expr(f"(block & {(1 << 33) - 1}) div {GROUP}")))
    count = queries.count()
    tiles = max(1, -(-count // TILE))
    asked = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int").alias("t"))
    summary = materialize(blocks.select("g", "dims", "up", "down").groupBy("g").applyInArrow(_merge_summaries, "g long, dims int, up binary, down binary"))
    groups = max(1, summary.count())
    shares = F.explode(F.sequence(F.lit(0), F.lit(-(-groups // SUMMARIES) - 1)))
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    told = summary.select(every.alias("t2"), F.pmod(F.hash("g"), F.lit(-(-groups // SUMMARIES))).alias("s2"), "g", "dims", "up", "down")

    def bounds(asked: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, q = _matrix(asked["vec_id"], asked["v"])
        dims = max(q.shape[1], *told["dims"].to_pylist())
        return ids, told["g"].to_numpy(), _bounds(_wide(q, dims), *_summaries(told, dims))

    def highest(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not asked.num_rows or not told.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "bound": pa.array([], pa.float64())})
        ids, g, b = bounds(asked, told)
        best = b.argmax(1)
        return pa.table({"vec_id": ids, "g": pa.array(g[best], pa.int64()), "bound": b[np.arange(len(ids)), best]})

    def reached(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not asked.num_rows or not told.num_rows:
            return pa.table({"t": pa.array([], pa.int32()), "g": pa.array([], pa.int64())})
        _, g, b = bounds(asked, told)
        need = (b >= asked["least"].to_numpy()[:, None]) & (asked["own"].to_numpy()[:, None] != g[None, :])
        g = g[need.any(0)]
        return pa.table({"t": pa.array([asked["t"][0].as_py()] * len(g), pa.int32()), "g": pa.array(g, pa.int64())})

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if stored.num_rows:
            asked = asked.filter(pc.or_kleene(pc.equal(asked["first"], True), pc.not_equal(asked["own"], stored["g"][0])))
        found = [np.empty(0, np.int64), *[np.empty((0, k), np.int64)] * 2]
        if asked.num_rows and stored.num_rows:
            found = search_blocks([_matrix(asked["vec_id"], asked["v"])], _unpack(stored), k, asked["least"].to_numpy())
        qid, ids, scores = found
        there = ids >= 0
        trim_memory()
        return pa.table({"query_id": np.repeat(qid, k)[there.ravel()], "vec_id": ids[there], "score": scores[there].astype(np.int64)})

    found_schema = "query_id long, vec_id long, score long"
    best = asked.withColumn("s", shares).groupBy("t", "s").cogroup(told.groupBy("t2", "s2")).applyInArrow(highest, "vec_id long, g long, bound double")
    best = materialize(best.groupBy("vec_id").agg(F.max_by("g", F.struct("bound", "g")).alias("own")))
    # a group that many queries begin with is searched in parts
    size = best.groupBy("own").agg(F.count("*").alias("n"))
    begin = join_hot(best, size, ["own"], "n", count).withColumn("t", F.pmod(F.xxhash64("vec_id"), F.expr(f"(n - 1) div {TILE} + 1")).cast("int"))
    begin = materialize(begin.select("vec_id", "own", "t"))
    low = F.lit(float("-inf"))
    one = queries.select("vec_id", "v").join(begin, "vec_id").withColumns({"least": low, "first": F.lit(True)})
    stored = blocks.join(begin.select(F.col("own").alias("g"), F.col("t").alias("t2")).distinct(), "g").select("dims", "ids", "matrix", "g", "t2")
    near = materialize(one.groupBy("own", "t").cogroup(stored.groupBy("g", "t2")).applyInArrow(search, found_schema))
    kth = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(low).alias("least"))
    asked = asked.join(best, "vec_id").join(kth, "vec_id", "left").withColumns({"least": F.coalesce("least", low), "first": F.lit(False)})
    asked = materialize(asked)
    pairs = materialize(asked.withColumn("s", shares).groupBy("t", "s").cogroup(told.groupBy("t2", "s2")).applyInArrow(reached, "t int, g long"))
    again = asked.join(pairs, "t")
    stored = blocks.join(pairs.withColumnRenamed("t", "t2"), "g").select("dims", "ids", "matrix", "g", "t2")
    more = again.groupBy("t", "g").cogroup(stored.groupBy("t2", "g")).applyInArrow(search, found_schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.unionByName(more).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
