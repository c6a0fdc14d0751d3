"""Tables that cut a lineage: written to the folder that executors and driver share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Bytes from which large rows are written, and read, as a group of their own; else a task holds a hundred of them, or all.
GROUP = 1 << 24
_OWN: dict[str, str] = {}  # folders of local applications that name none


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a Parquet table below ``spark.checkpoint.dir``; its files go when the JVM ends. While it is written, Spark
    hands Python at most ``rows`` rows at a time; its own rows are then taken to be large, and few of them are held together.

    Where the setting is empty, a temporary folder is made for a local application; elsewhere it is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows or before)
    large = {"parquet.block.size": GROUP, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1} if rows else {}
    try:
        df.write.options(**large).parquet(path)
    finally:
        spark.conf.set(name, before)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
