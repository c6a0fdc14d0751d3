"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.bpe import ByteBPE, bpe_encode
from corpuslab.llm.common import hex_sha256, materialize, one_row_per_id
from corpuslab.llm.language_id import UNKNOWN, held_out, predict_language, train_language_id
from corpuslab.llm.line_dedup import line_dedup
from corpuslab.llm.minhash import near_dedup
from corpuslab.llm.mixing import mix_sources
from corpuslab.llm.queries import MIX_SEED, MIX_WEIGHTS, mix_domain

#: A document goes if no language reaches this probability.
LEAST_LANGUAGE_SCORE = 0.5
#: The mix takes so much of all tokens, and no document twice: copies would undo the stages before.
MIX_SHARE, MIX_EPOCHS = (4, 5), 1


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and a clear language."""
    model = train_language_id(docs.filter(~held_out()).select("text", "lang"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text")
    found = predict_language(rows, model, id_col="row")
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("doc_id.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across them; n_chars follows the text."""
    out = line_dedup(docs, carry=True)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept")), "n_chars": F.when(F.col("row.text").isNotNull(), F.length("kept")).cast(docs.schema["n_chars"].dataType)}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates. Of rows that share an id the one that stands for them is taken
    (``one_row_per_id``); documents without an id are not compared and stay."""
    docs = one_row_per_id(docs, "doc_id", "text")
    gone = near_dedup(docs).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; those without an id are not taken."""
    mix = mix_sources(docs, mix_domain(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return docs.join(mix.filter("copies > 0").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): exact says that the ids decode to the text's own bytes."""
    bpe = ByteBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    row = F.struct("doc_id", "lang", "source", hex_sha256(F.coalesce("text", F.lit(""))).alias("sha256")).alias("row")
    out = bpe_encode(docs.select(row, "text"), bpe, id_col="row", decoded=True)
    return out.select("doc_id.doc_id", "doc_id.lang", "doc_id.source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("doc_id.sha256")).alias("exact"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("byte_bpe", bpe_stage),
]

#: The first stage's model cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
