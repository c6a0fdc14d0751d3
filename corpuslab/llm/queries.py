"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteBPE, bpe_encode
from .chat import chat_format, loss_text, parse, rows_to_events
from .common import hex_sha256, materialize
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives, labelled_vectors
from .language_id import language_id
from .line_dedup import line_dedup
from .minhash import near_dedup
from .mixing import mix_sources
from .spelling import spelling_variants
from .suffix_dedup import suffix_dedup
from .token_counts import WordBPE, token_counts
from .topk_search import exact_top_k, whole_vectors
from .toxicity import toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("kept")).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = materialize(whole_vectors(_read(spark, sf_dir, "embeddings")))
    return exact_top_k(items, items.filter("vec_id % 50 = 0"), 5)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_read(spark, sf_dir, "documents"), 50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Production parameters of the mix. The domain of a source is a rule, and the weights are whole numbers.
MIX_WEIGHTS = {"web": 3, "books": 5, "code": 2} | {f"{d}/{k}": v for d in ("web", "books", "code") for k, v in (("en", 6), ("fr", 2), ("de", 2), ("es", 1))}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (3, 5), 4, "mix"


def mix_domain() -> Column:
    return F.when(F.col("source") == "src0", "web").when(F.md5(F.col("source").cast("binary")) < "8", "books").otherwise("code")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"), mix_domain(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_read(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_read(spark, sf_dir, "documents"))


#: A conversation whose texts hold what looks like control strings.
TRICKY_ID, TRICKY_TEXT = -7, "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(TRICKY_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY_TEXT).alias("text"))
    out = chat_format(rows_to_events(rows.unionByName(tricky)))
    turns, loss = parse(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), hex_sha256(said).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        hex_sha256(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), WordBPE.from_file(public_tokenizers.path("word_bpe_49k.json")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = ByteBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = bpe_encode(_read(spark, sf_dir, "documents"), bpe, decoded=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join("ids", ",")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(labelled_vectors(_read(spark, sf_dir, "embeddings")))
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_exact_dedup, op3_topk_search, op4_suffix_dedup, op5_mixing, op6_token_counts, op7_language_id, op8_near_dedup, op9_chat, op10_byte_bpe, op11_hard_negatives, op12_toxicity, op13_spelling_variants)}

def mix_sql(share: tuple[int, int] = MIX_SHARE, epochs: int = MIX_EPOCHS) -> str:
    """SQL for the mix of the table ``documents``."""
    weight = lambda depth: "CASE " + " ".join(f"WHEN path = '{k}' THEN {v}" for k, v in MIX_WEIGHTS.items() if k.count("/") == depth) + " ELSE 1 END" if depth < 2 else "1"

    def fill(name: str, source: str, parent: str, child: str, budget: str, weights: str) -> str:
        return f"""
{name}_w AS (SELECT *, ({weights})::BIGINT AS w FROM ({source})),
{name}_o AS (
  SELECT *, coalesce(sum(cap) OVER before, 0)::BIGINT AS cb, coalesce(sum(w) OVER before, 0)::BIGINT AS wb, (sum(w) OVER (PARTITION BY {parent}))::BIGINT AS wa
  FROM {name}_w WINDOW before AS (PARTITION BY {parent} ORDER BY cap::DOUBLE / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_f AS (SELECT *, cap * (wa - wb) <= ({budget} - cb) * w AS fits FROM {name}_o),
{name} AS (
  SELECT *, CASE WHEN fits THEN cap ELSE ({budget} - coalesce(sum(cap) FILTER (fits) OVER (PARTITION BY {parent}), 0)::BIGINT) * w
         // (sum(w) FILTER (NOT fits) OVER (PARTITION BY {parent}))::BIGINT END AS {name}_budget FROM {name}_f)"""

    return f"""
WITH base AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' WHEN md5(source) < '8' THEN 'books' ELSE 'code' END AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS avail, (sum(n_tokens) * {epochs})::BIGINT AS cap FROM base GROUP BY ALL),
{fill("dom", f"SELECT domain, domain AS path, sum(cap)::BIGINT AS cap, 0 AS root, (SELECT sum(avail) * {share[0]} // {share[1]} FROM leaf)::BIGINT AS b FROM leaf GROUP BY domain", "root", "domain", "b", weight(0))},
{fill("lng", "SELECT domain, lang, domain || '/' || lang AS path, sum(leaf.cap)::BIGINT AS cap, any_value(dom_budget) AS b FROM leaf JOIN (SELECT domain, dom_budget FROM dom) USING (domain) GROUP BY domain, lang", "domain", "lang", "b", weight(1))},
{fill("src", "SELECT leaf.*, b FROM leaf JOIN (SELECT domain, lang, lng_budget AS b FROM lng) USING (domain, lang)", "domain, lang", "source", "b", weight(2))},
picked AS (
  SELECT base.*, src_budget // avail AS epochs, src_budget % avail AS rest,
         md5('{MIX_SEED}:' || (src_budget // avail) || ':' || doc_id) AS key
  FROM base JOIN src USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens,
       epochs + (coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest)::BIGINT AS copies
FROM picked"""


ORACLE_SQL = {
    "op1_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, coalesce(r.last <> k.doc_id, false) AS drop_it FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop_it) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_it), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op2_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)""",
    "op3_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
    "op5_mixing": mix_sql(),
    "op9_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, role = 'assistant' AS own,
         replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS er,
         replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS et FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (own), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (own), '')) AS loss_sha256,
       sum(length(er) + length(et) + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""".replace("\\\\", "\\"),
}
