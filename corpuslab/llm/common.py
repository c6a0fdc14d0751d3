"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_KEYS of all rows (and LEAST_HOT rows), so at most HOT_KEYS keys are hot,
#: and no other key has more rows than that.
HOT_KEYS, LEAST_HOT = 50_000, 1000

#: ASCII white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of text that go through Python at a time, if one text alone does not have more.
ROWS, BYTES = 1000, 4 << 20

_OWN: dict[str, str] = {}  # scratch folders of local applications without a checkpoint folder


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a temporary one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _OWN[context.applicationId]
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, held: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    The files go when the JVM ends, or with ``release(held)``, whichever is first.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, held: list[str]) -> None:
    """Delete materialised tables that nothing reads any more."""
    for path in held:
        p, fs = _path(spark, path)
        fs.delete(p, True)
    held.clear()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """While it lasts, Spark hands Python at most so many rows at a time; for actions inside an operator."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and ``size`` bytes of the column, one row at least."""
    for batch in batches:
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        start = held = 0
        for i, n in enumerate(length.tolist()):
            if i - start >= rows or held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def dense(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of whole numbers as a matrix; shorter rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat, size = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to groups (one narrow row for each key, with the key's number of rows in ``size``) without a hot task.

    Keys that hold at least 1/HOT_KEYS of ``total`` rows are at most HOT_KEYS many, whatever the input: they are
    joined by broadcast, of some megabytes at most. No other key brings a task more than total / HOT_KEYS rows.
    """
    least = max(total // HOT_KEYS, LEAST_HOT)
    hot = groups.filter(F.col(size) >= least)
    cold = groups.filter(F.col(size) < least)
    a = rows.join(F.broadcast(hot), on, "inner")
    b = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return a.unionByName(b)


def without_hot(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """The rows whose key is not among groups, as ``join_hot`` would find them."""
    least = max(total // HOT_KEYS, LEAST_HOT)
    rest = rows.join(F.broadcast(groups.filter(F.col(size) >= least).select(*on)), on, "left_anti")
    return rest.join(groups.filter(F.col(size) < least).select(*on), on, "left_anti").select(*rows.columns)


def one_row_per_id(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, but of those that share an id only one: the one with the greatest text, then the greatest row.

    Rows whose id is null all stay. Only the ids are shuffled where none is shared.
    """
    held = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col)
    shared = materialize(held)
    if shared.isEmpty():
        return rows
    names = rows.columns
    ordered = F.struct(F.col(text_col), F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
    most = F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), ordered).alias("row")
    several = rows.join(shared, id_col, "left_semi").groupBy(F.col(id_col).alias("__id")).agg(most).select("row.*")
    return rows.join(shared, id_col, "left_anti").select(*names).unionByName(several.select(*names))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def trim_memory() -> None:
    """Give freed memory back to the system. A worker that takes group after group else keeps its allocators' peaks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
