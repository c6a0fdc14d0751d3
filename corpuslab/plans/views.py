"""The driver's tables as inputs of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(passage_id, tradition, work, text) from documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.col("lang").alias("tradition"), F.col("source").alias("work"), "text")


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(passage_id, role) from labels: quality 1 is target, 0 is control."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("passage_id"), F.when(F.col("quality") == 1, "target").otherwise("control").alias("role"))


def role_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).join(roles(spark, sf_dir), "passage_id")


PASSAGES = "SELECT doc_id AS passage_id, lang AS tradition, source AS work, text FROM documents"
ROLES = "SELECT doc_id AS passage_id, CASE WHEN quality = 1 THEN 'target' ELSE 'control' END AS role FROM labels"

#: Words of the driver's invented texts, and words of the packaged lexicons in their place.
SUBJECT = (
    (" is ", " Quantum "), (" to ", " heat flows "), (" with ", " electromagnetic field "), (" by ", " photon "), (" from ", " space-time "), (" be ", " newtonian "),
    (" und ", " Entropy "), (" der ", " force "), (" que ", " matter "), (" una ", " thermodynamic "), (" les ", " ethereal "), (" une ", " maxwell equation "), (" dans ", " ħ "),
)


def subject_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with the packaged words in the place of some of their own."""
    text = F.col("text")
    for old, new in SUBJECT:
        text = F.replace(text, F.lit(old), F.lit(new))
    return passages(spark, sf_dir).select("passage_id", "tradition", "work", text.alias("text"))


SUBJECT_TEXT = "text"
for _old, _new in SUBJECT:
    SUBJECT_TEXT = f"replace({SUBJECT_TEXT}, '{_old}', '{_new}')"
SUBJECT_PASSAGES = f"SELECT passage_id, tradition, work, {SUBJECT_TEXT} AS text FROM ({PASSAGES})"
