"""Readers and writers. Schemas are explicit; nothing is inferred from data but for CSV headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN_SPLITS = ("train", "development")


def _nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.withColumns(floats) if floats else df


def read_passages(spark: SparkSession, path: str, schema: T.StructType | None = None, locked: Sequence[str] = ("confirmatory",)) -> DataFrame:
    """Passages from Parquet, NaN as null. A path that names a locked split is refused, as are its rows."""
    if any(x in path for x in locked):
        raise PermissionError(f"locked: {path}")
    df = _nan_to_null((spark.read.schema(schema) if schema else spark.read).parquet(path))
    return df.filter(~F.coalesce(F.col("dataset_split").isin(*locked), F.lit(False))) if "dataset_split" in df.columns else df


def write_passages(passages: DataFrame, path: str) -> None:
    passages.write.mode("overwrite").parquet(path)


def write_fan_out(tables: dict[str, DataFrame], base: str) -> None:
    """Each table as Parquet below base, under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")


def read_split(spark: SparkSession, root: str, split: str, schema: T.StructType) -> DataFrame:
    """One split of a JSON-lines corpus; only open splits are read."""
    if split not in OPEN_SPLITS:
        raise PermissionError(f"split {split!r} is not open")
    return spark.read.schema(schema).json(f"{root}/split={split}")


def write_splits(corpus: DataFrame, root: str) -> None:
    corpus.write.mode("overwrite").partitionBy("split").json(root)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def manifest_by_availability(manifest: DataFrame) -> DataFrame:
    """(availability_status, n) of a manifest of sources."""
    return manifest.groupBy("availability_status").agg(F.count("*").alias("n"))


FEATURES = "id string, name string, family string, level string, definition string, quantum_specific boolean, field_like boolean, version string"
FINGERPRINTS = "theory_id string, name string, version string, classical boolean, quantum boolean, features map<string,int>, weights map<string,double>"
CLAIMS = "claim_id string, claim string, kind string, required_features array<string>, quantum_features array<string>, notes string"
VOCABULARY = "term string, replacement string"


def _dimension(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A small table from JSON lines; keys must be there and unique."""
    rows = spark.read.schema(schema).json(path)
    bad = rows.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"{path}: null or repeated {key}: {bad[0][key]!r}")
    return rows


def read_features(spark: SparkSession, path: str, least: int = 30) -> DataFrame:
    """The features of an ontology, one JSON object a line; fewer than ``least`` are refused."""
    rows = _dimension(spark, path, FEATURES, "id")
    if (n := rows.count()) < least:
        raise ValueError(f"{path}: only {n} features")
    return rows.withColumnRenamed("id", "feature_id")


def read_fingerprints(spark: SparkSession, path: str, index: Sequence[str] | None = None) -> DataFrame:
    """(theory_id, feature_id, t, w, classical, quantum), of the theories in the index; one that is missing is an error."""
    rows = _dimension(spark, path, FINGERPRINTS, "theory_id")
    if index is not None:
        rows = rows.filter(F.col("theory_id").isin(*index))
        if missing := set(index) - {r.theory_id for r in rows.select("theory_id").collect()}:
            raise ValueError(f"{path}: no fingerprint of {sorted(missing)}")
    long = rows.select("theory_id", "classical", "quantum", "weights", F.explode("features").alias("feature_id", "t"))
    weight = F.coalesce(F.try_element_at("weights", F.col("feature_id")), F.lit(1.0))
    return long.select("theory_id", "feature_id", "t", weight.alias("w"), F.coalesce("classical", F.lit(False)).alias("classical"), F.coalesce("quantum", F.lit(False)).alias("quantum"))


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return _dimension(spark, path, CLAIMS, "claim_id")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return _dimension(spark, path, VOCABULARY, "term")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; bytes that are no UTF-8 are dropped."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.select("path", F.replace(F.expr("make_valid_utf8(cast(content as string))"), F.lit("�"), F.lit("")).alias("text"))


def registry_admit(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """New rows whose key is not registered, to append; and the refused ones."""
    known = existing.select(key).distinct()
    return new.join(known, key, "left_anti"), new.join(known, key, "left_semi")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, fingerprint) of a table, whatever the order of its rows: the sum of 32 bits of each row's SHA-256."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long")).alias("fingerprint"))
