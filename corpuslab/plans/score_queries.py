"""Queries of annotation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import blocks as B
from ..operators import passages as P
from ..operators import score as X
from ..operators.lexicon import keyword_features
from . import Registry
from ..dims import MASK_TERMS
from ..functions import text as T
from ..operators.select import first_n
from .text_queries import _subst, _words
from .views import PASSAGES, ROLES, SUBJECT_TEXT, passages, role_passages, roles, subject_passages, table

q = Registry()

#: Cues that occur in the driver's invented texts: (feature, positive patterns, negative pattern).
CUES = (
    ("O01", ("license",), None), ("O02", ("tion the", "ther"), None), ("O04", ("ing of",), None), ("D01", (" une ",), None), ("D02", ("ment",), None),
    ("Q01", ("heit|ung",), None), ("Q06", ("released",), "mit license"), ("F01", ("ción|ther",), None), ("F07", ("the th",), None), ("M03", ("ou le",), None),
)
FEATURES = [f for f, _, _ in CUES]
CUE_ROWS = [A.Cue(f, p) for f, ps, _ in CUES for p in ps] + [A.Cue(f, n, False) for f, _, n in CUES if n]
#: Fingerprints by rule: (theory, feature, t, w); T1 and T2 are the quantum ones.
FINGERPRINTS = [(f"T{i}", f, int((i * 3 + j * j) % 4 < 2), 1.0 + (i + j) % 3) for i in range(1, 5) for j, f in enumerate(FEATURES)]
QUANTUM, CLASSICAL = ("T1", "T2"), ("T3", "T4")
CORE, FIELD_QUANTUM, SUBSTRATE = ("F01", "O04", "D02"), ("F07",), ("O01",)
EXCLUSIVE = ("Q01", "Q06", "F07")

_m = lambda col, p: f"regexp_matches({col}, '(?i){p}')"


def _feature_sql(f, ps, neg) -> str:
    match = "CASE " + " ".join(f"WHEN {_m('text', p)} THEN regexp_extract(text, '(?i){p}')" for p in ps) + " END"
    label = "CASE " + (f"WHEN {_m('text', neg)} THEN '0' " if neg else "") + f"WHEN {' OR '.join(_m('text', p) for p in ps)} THEN '1' ELSE 'NA' END"
    return f"SELECT passage_id, tradition, work, text, '{f}' AS feature_id, {label} AS label, {match} AS m FROM p"


ANN = f"""p AS ({PASSAGES}), a0 AS ({" UNION ALL ".join(_feature_sql(*c) for c in CUES)}),
ann AS (SELECT passage_id, tradition, work, text, feature_id, label, CASE label WHEN '1' THEN 0.8 WHEN '0' THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence,
  CASE WHEN label = '1' THEN trim(reverse(split_part(reverse(substr(text, 1, strpos(text, m) - 1)), '.', 1)) || split_part(substr(text, strpos(text, m)), '.', 1)) ELSE '' END AS evidence,
  CASE label WHEN '1' THEN 1.0 WHEN '0' THEN 0.0 END::DOUBLE AS value FROM a0)"""
FP = "fp(theory_id, feature_id, t, w) AS (VALUES " + ", ".join(f"('{a}', '{b}', {t}, {w})" for a, b, t, w in FINGERPRINTS) + ")"
SCORES = f"""{ANN}, {FP}, sc AS (SELECT passage_id, theory_id, coalesce(sum(w * least(value, t)) FILTER (value IS NOT NULL) / nullif(sum(w * greatest(value, t)) FILTER (value IS NOT NULL), 0), 0)::DOUBLE AS score
FROM ann JOIN fp USING (feature_id) GROUP BY ALL)"""
QS = f"{SCORES}, qs AS (SELECT passage_id, coalesce(max(score) FILTER (theory_id IN {QUANTUM}), 0) - coalesce(max(score) FILTER (theory_id IN {CLASSICAL}), 0) AS qs FROM sc GROUP BY passage_id)"


def annotations(spark, d):
    return A.annotate(passages(spark, d), CUE_ROWS, FEATURES)


def values(spark, d):
    return annotations(spark, d).select("passage_id", "tradition", "work", "feature_id", A.label_value(F.col("label")).alias("value"))


def fingerprints(spark):
    return spark.createDataFrame(FINGERPRINTS, "theory_id string, feature_id string, t int, w double")


def scores(spark, d, metric="weighted_jaccard"):
    return X.theory_scores(values(spark, d), fingerprints(spark), metric)


def qs(spark, d):
    return X.specificity(scores(spark, d), QUANTUM, CLASSICAL)


def _r(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@q(f"WITH {ANN} SELECT passage_id, feature_id, label, evidence, confidence FROM ann")
def annotate_features(spark, d):
    return annotations(spark, d).select("passage_id", "feature_id", "label", "evidence", "confidence")


_ev = "CASE WHEN passage_id % 7 = 0 THEN '' WHEN passage_id % 5 = 0 THEN 'zzzz qqqq ' || passage_id WHEN passage_id % 11 = 0 THEN 'all is one' ELSE evidence END"
_METAPHOR, _TECH, _UNITY, _EXC = "tion|ung", "state|ment", "all is one|released", "joint state"


@q(f"""
WITH {ANN}, e AS (SELECT * REPLACE (CASE WHEN label = '1' THEN {_ev} ELSE evidence END AS evidence, CASE WHEN passage_id % 11 = 0 AND label = '1' THEN text || ' all is one' ELSE text END AS text) FROM ann),
t AS (SELECT *, list_filter(regexp_split_to_array(lower(evidence), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 3) AS ws FROM e),
f AS (SELECT *, CASE WHEN label <> '1' THEN NULL WHEN trim(evidence) = '' THEN 'missing_evidence'
  WHEN NOT contains(lower(text), lower(trim(evidence))) AND NOT (len(ws) > 0 AND len(list_filter(ws, lambda w: contains(lower(text), w))) >= 0.8 * len(ws)) THEN 'evidence_span_not_found'
  WHEN feature_id = 'Q06' AND {_m('evidence', _UNITY)} AND NOT {_m('evidence', _EXC)} THEN 'unity_not_nonseparability'
  WHEN feature_id IN ('Q01', 'Q06') AND {_m('evidence', _METAPHOR)} AND NOT {_m('evidence', _TECH)} THEN 'metaphor_only' END AS flag FROM t)
SELECT passage_id, feature_id, flag, CASE flag WHEN 'metaphor_only' THEN 'U' WHEN 'unity_not_nonseparability' THEN '0' ELSE CASE WHEN flag IS NOT NULL THEN 'NA' ELSE label END END AS final_label, flag IS NULL AS verified FROM f""")
def verify_evidence(spark, d):
    rows = annotations(spark, d)
    rows = rows.withColumn("evidence", F.when(F.col("label") == "1", F.expr(_ev)).otherwise(F.col("evidence")))
    rows = rows.withColumn("text", F.expr("CASE WHEN passage_id % 11 = 0 AND label = '1' THEN text || ' all is one' ELSE text END"))
    out = A.verify_evidence(rows, ("Q01", "Q06"), _METAPHOR, _TECH, _UNITY, "Q06", _EXC)
    return out.select("passage_id", "feature_id", "flag", "final_label", "verified")


@q(f"WITH {ANN} SELECT passage_id, feature_id FROM ann WHERE label = '1' AND passage_id % 7 = 0")
def annotation_violations(spark, d):
    rows = annotations(spark, d).withColumn("evidence", F.when(F.col("passage_id") % 7 == 0, "").otherwise(F.col("evidence")))
    return A.violations(rows).select("passage_id", "feature_id")


_code = "CASE passage_id % 6 WHEN 0 THEN label WHEN 1 THEN CASE label WHEN '1' THEN 'YES' WHEN '0' THEN 'NO' ELSE 'U' END WHEN 2 THEN label || '.0' WHEN 3 THEN lower(CASE label WHEN '1' THEN 'TRUE' ELSE 'NA' END) ELSE label END"


@q(f"WITH {ANN}, c AS (SELECT passage_id, feature_id, upper({_code}) AS c FROM ann) SELECT passage_id, feature_id, CASE WHEN c IN ('1', '1.0', 'YES', 'TRUE') THEN 1.0 WHEN c IN ('0', '0.0', 'NO', 'FALSE') THEN 0.0 END::DOUBLE AS value FROM c")
def label_recode(spark, d):
    return annotations(spark, d).select("passage_id", "feature_id", A.label_value(F.expr(_code)).alias("value"))


@q(f"WITH {ANN} SELECT passage_id, feature_id, CASE WHEN label = 'NA' THEN NULL ELSE value END AS value FROM ann UNION ALL SELECT passage_id, 'Z99', NULL FROM p")
def feature_vector(spark, d):
    feats = spark.createDataFrame([(f,) for f in [*FEATURES, "Z99"]], "feature_id string")
    return A.feature_vector(annotations(spark, d).filter("label <> 'NA'"), passages(spark, d), feats)


_reply = "'Sure: {\"labels\": [{\"feature_id\": \"Q01\", \"label\": \"' || CASE WHEN passage_id % 3 = 0 THEN 'YES' ELSE 'no' END || '\", \"evidence\": \"the\", \"confidence\": 1.7}, {\"feature_id\": \"Q06\", \"label\": \"maybe\", \"evidence\": \"qqq\", \"confidence\": 0.4}]}'"


@q(f"""
SELECT passage_id, 'Q01' AS feature_id, CASE WHEN passage_id % 3 = 0 AND contains(lower(text), 'the') THEN '1' WHEN passage_id % 3 <> 0 THEN '0' ELSE 'NA' END AS label, CASE WHEN contains(lower(text), 'the') THEN 'the' ELSE '' END AS evidence, 1.0::DOUBLE AS confidence FROM ({PASSAGES})
UNION ALL SELECT passage_id, 'Q06', 'NA', CASE WHEN contains(lower(text), 'qqq') THEN 'qqq' ELSE '' END, 0.4::DOUBLE FROM ({PASSAGES})
UNION ALL SELECT passage_id, 'M03', 'NA', '', 0.0::DOUBLE FROM ({PASSAGES})""")
def parse_label_json(spark, d):
    return A.parse_labels(passages(spark, d).withColumn("raw", F.expr(_reply)), ["Q01", "Q06", "M03"])


@q(f"""
WITH {ANN} SELECT 'A' || passage_id AS anonymous_id, CASE WHEN passage_id % 2 = 0 THEN passage_id::VARCHAR ELSE 'A' || passage_id END AS passage_id, count(*) AS n FROM ann WHERE label = '1' GROUP BY ALL""")
def unblind_annotations(spark, d):
    rows = annotations(spark, d).filter("label = '1'").select(F.concat(F.lit("A"), F.col("passage_id").cast("string")).alias("anonymous_id"), "feature_id")
    mapping = passages(spark, d).filter("passage_id % 2 = 0").select(F.concat(F.lit("A"), F.col("passage_id").cast("string")).alias("anonymous_id"), "passage_id")
    return P.unblind(rows, mapping).groupBy("anonymous_id", "passage_id").agg(F.count("*").alias("n"))


@q(f"WITH {SCORES} SELECT passage_id, theory_id, round(score, 6) AS score FROM sc")
def theory_scores(spark, d):
    return _r(scores(spark, d), "score")


@q(f"WITH {ANN}, {FP} SELECT passage_id, theory_id, round(coalesce(sum(least(value, t)) FILTER (value IS NOT NULL) / nullif(sum(greatest(value, t)) FILTER (value IS NOT NULL), 0), 0), 6)::DOUBLE AS score FROM ann JOIN fp USING (feature_id) GROUP BY ALL")
def theory_scores_unweighted(spark, d):
    return _r(scores(spark, d, "jaccard"), "score")


@q(f"WITH {ANN}, {FP} SELECT passage_id, theory_id, round(coalesce(2 * sum(value * t) / nullif(sum(value) + sum(t) FILTER (value IS NOT NULL), 0), 0), 6)::DOUBLE AS score FROM ann JOIN fp USING (feature_id) GROUP BY ALL")
def theory_scores_dice(spark, d):
    return _r(scores(spark, d, "dice"), "score")


@q(f"WITH {QS} SELECT passage_id, round(qs, 6) AS qs FROM qs")
def qs_scores(spark, d):
    return _r(qs(spark, d), "qs")


@q(f"WITH {ANN} SELECT passage_id, round(coalesce(count(*) FILTER (value = 1) / nullif(count(value), 0), 0), 6)::DOUBLE AS qef FROM ann WHERE feature_id IN {EXCLUSIVE} GROUP BY passage_id")
def qef_scores(spark, d):
    return _r(X.exclusive_share(values(spark, d), EXCLUSIVE), "qef")


_CLASS = f"""{ANN}, fc AS (SELECT passage_id, tradition, count(*) FILTER (value = 1 AND feature_id IN {CORE}) AS n_core, coalesce(bool_or(value = 1 AND feature_id IN ('F07')), false) AS has_quantum, coalesce(bool_or(value = 1 AND feature_id IN ('O01')), false) AS s FROM ann GROUP BY ALL),
cls AS (SELECT passage_id, tradition, n_core, has_quantum, CASE WHEN n_core = 0 AND NOT s THEN 'insufficient' WHEN has_quantum AND n_core >= 2 THEN 'potentially_qft_like' WHEN NOT has_quantum AND n_core >= 3 THEN 'classical_field_like' WHEN NOT has_quantum AND n_core >= 2 THEN 'field_like' ELSE 'metaphor_substrate_only' END AS field_class FROM fc)"""


@q(f"WITH {_CLASS} SELECT passage_id, n_core, has_quantum, field_class FROM cls")
def field_class(spark, d):
    return X.field_class(values(spark, d), CORE, FIELD_QUANTUM, SUBSTRATE)


CLASSES = ("insufficient", "metaphor_substrate_only", "field_like", "classical_field_like", "potentially_qft_like")


@q(f"WITH {_CLASS} SELECT tradition, {', '.join(f'''count(*) FILTER (field_class = '{c}') AS {c}''' for c in CLASSES)} FROM cls GROUP BY tradition")
def field_class_pivot(spark, d):
    cls = X.field_class(values(spark, d), CORE, FIELD_QUANTUM, SUBSTRATE).join(passages(spark, d).select("passage_id", "tradition"), "passage_id")
    return cls.groupBy("tradition").pivot("field_class", list(CLASSES)).count().fillna(0)


@q(f"WITH {SCORES}, k AS (SELECT passage_id, theory_id, row_number() OVER (PARTITION BY passage_id ORDER BY round(score, 9) DESC, theory_id) AS rank FROM sc) SELECT theory_id, rank::INT AS rank, count(*) AS n FROM k GROUP BY ALL")
def theory_ranks(spark, d):
    return X.ranks(_r(scores(spark, d), "score", n=9)).groupBy("theory_id", "rank").agg(F.count("*").alias("n"))


@q(f"WITH {QS} SELECT tradition, role, round(avg(qs), 6) AS mean, round(stddev_samp(qs), 6) AS std, count(*) AS n FROM qs JOIN p USING (passage_id) JOIN ({ROLES}) USING (passage_id) GROUP BY ALL")
def qs_summary(spark, d):
    rows = qs(spark, d).join(role_passages(spark, d).select("passage_id", "tradition", "role"), "passage_id")
    return _r(rows.groupBy("tradition", "role").agg(F.avg("qs").alias("mean"), F.stddev_samp("qs").alias("std"), F.count("*").alias("n")), "mean", "std")


@q(f"WITH {SCORES} SELECT tradition, {', '.join(f'''round(avg(score) FILTER (theory_id = 'T{i}'), 6) AS \"T{i}\"''' for i in range(1, 5))} FROM sc JOIN p USING (passage_id) GROUP BY tradition")
def theory_matrix(spark, d):
    rows = scores(spark, d).join(passages(spark, d).select("passage_id", "tradition"), "passage_id")
    ids = [f"T{i}" for i in range(1, 5)]
    return _r(rows.groupBy("tradition").pivot("theory_id", ids).avg("score"), *ids)


@q(f"WITH {ANN} SELECT tradition, {', '.join(f'''count(*) FILTER (feature_id = '{f}' AND label = '1') AS {f}''' for f in FEATURES)} FROM ann GROUP BY tradition")
def feature_pivot(spark, d):
    all_ = passages(spark, d).select("tradition").distinct()
    rows = annotations(spark, d).filter("label = '1'").groupBy("tradition").pivot("feature_id", FEATURES).count()
    return all_.join(rows, "tradition", "left").fillna(0)


CLAIMS = [("C01", ["O01", "F01"], ["Q01"], None), ("C02", ["O02", "D02"], ["Q99"], "classical_field_like_ontology"), ("C03", ["Z98"], ["Z99"], None), ("C04", ["O04"], [], None)]


def _claims_sql() -> str:
    lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS claim_id, {lst(r)} AS req, {lst(qf)} AS qf, {'NULL' if o is None else repr(o)}::VARCHAR AS o" for c, r, qf, o in CLAIMS)
    return f"""cl AS ({rows}), y AS (SELECT p.passage_id, coalesce(list(feature_id) FILTER (label = '1'), []) AS yes FROM p LEFT JOIN ann USING (passage_id) GROUP BY 1),
e AS (SELECT claim_id, count(*) AS n, round(avg(list_has_any(yes, req)::INT), 6) AS any_required, round(avg((len(req) > 0 AND list_has_all(yes, req))::INT), 6) AS all_required,
  round(avg(list_has_any(yes, qf)::INT), 6) AS any_quantum, round(avg((len(qf) > 0 AND list_has_all(yes, qf))::INT), 6) AS all_quantum,
  list_sort(list_distinct(flatten(list(list_intersect(req, yes))))) AS supported, list_sort(list_distinct(flatten(list(list_intersect(qf, yes))))) AS q_supported, any_value(o) AS o FROM y, cl GROUP BY claim_id)"""


@q(f"WITH {ANN}, {_claims_sql()} SELECT * EXCLUDE (o), CASE WHEN len(q_supported) > 0 THEN 'partial_quantum_overlap' WHEN len(supported) > 0 AND o IS NOT NULL THEN o WHEN len(supported) > 0 THEN 'classical_or_field_like_ontology' ELSE 'unsupported_in_sample' END AS verdict FROM e")
def claims_eval(spark, d):
    claims = spark.createDataFrame(CLAIMS, "claim_id string, required array<string>, quantum array<string>, verdict_override string")
    out = A.evaluate_claims(annotations(spark, d).filter("label = '1'"), passages(spark, d), claims)
    return _r(out, "any_required", "all_required", "any_quantum", "all_quantum")


@q(f"WITH {ANN}, {_claims_sql()} SELECT claim_id, CASE WHEN any_required = 0 THEN 'unsupported' WHEN len(q_supported) = 0 THEN 'contradicted' ELSE 'partial' END AS verdict FROM e")
def claim_autopsy(spark, d):
    claims = spark.createDataFrame(CLAIMS, "claim_id string, required array<string>, quantum array<string>, verdict_override string")
    out = A.evaluate_claims(annotations(spark, d).filter("label = '1'"), passages(spark, d), claims)
    return out.select("claim_id", F.when(F.col("any_required") == 0, "unsupported").when(F.size("q_supported") == 0, "contradicted").otherwise("partial").alias("verdict"))


@q(f"WITH {FP}, x AS (SELECT a.theory_id AS a, b.theory_id AS b, a.t AS ta, b.t AS tb FROM fp a JOIN fp b USING (feature_id) WHERE a.theory_id < b.theory_id), s AS (SELECT a, b, count(*) FILTER (ta = 1 AND tb = 1) / count(*) FILTER (ta = 1 OR tb = 1) AS jaccard, (SELECT count(*) FROM ({PASSAGES})) AS n_passages FROM x GROUP BY ALL) SELECT a, b, round(jaccard, 6) AS jaccard, n_passages FROM s")
def fingerprint_pairs(spark, d):
    n = passages(spark, d).agg(F.count("*").alias("n_passages"))
    return _r(X.binary_pairs(fingerprints(spark)).select("a", "b", "jaccard").crossJoin(n), "jaccard")


def _works_as_fingerprints(spark, d):
    rows = values(spark, d).groupBy("work", "feature_id").agg(F.coalesce(F.avg(F.coalesce("value", F.lit(0.0))), F.lit(0.0)).alias("m"))
    return rows.select(F.col("work").alias("theory_id"), "feature_id", (F.col("m") > 0.3).cast("int").alias("t"))


_WFP = f"{ANN}, wf AS (SELECT work AS theory_id, feature_id, (avg(coalesce(value, 0)) > 0.3)::INT AS t FROM ann GROUP BY ALL), wp AS (SELECT a.theory_id AS a, b.theory_id AS b, coalesce(count(*) FILTER (a.t = 1 AND b.t = 1) / nullif(count(*) FILTER (a.t = 1 OR b.t = 1), 0), 0) AS jaccard, count(*) FILTER (a.t <> b.t) AS hamming FROM wf a JOIN wf b USING (feature_id) WHERE a.theory_id < b.theory_id GROUP BY ALL)"


@q(f"WITH {_WFP} SELECT a, b, hamming FROM wp")
def hamming_matrix(spark, d):
    return X.binary_pairs(_works_as_fingerprints(spark, d)).select("a", "b", "hamming")


@q(f"WITH {_WFP}, u AS (SELECT a AS theory_id, b AS o, jaccard FROM wp UNION ALL SELECT b, a, jaccard FROM wp) SELECT theory_id, o AS nearest, round(jaccard, 6) AS jaccard, jaccard >= 0.85 AS near_identical FROM u QUALIFY row_number() OVER (PARTITION BY theory_id ORDER BY jaccard DESC, o) = 1")
def nearest_fingerprint(spark, d):
    return _r(X.nearest(X.binary_pairs(_works_as_fingerprints(spark, d))), "jaccard")


@q("WITH m AS (SELECT vec_id, embedding, label, first_value(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS ref FROM embeddings) SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], ref::DOUBLE[]), 6) AS cosine FROM m")
def embedding_cosine(spark, d):
    rows = table(spark, d, "embeddings")
    ref = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return _r(rows.join(F.broadcast(ref), "label").select("vec_id", "label", X.cosine(F.col("embedding"), F.col("ref")).alias("cosine")), "cosine")


@q("""
WITH k(feature_id, keyword) AS (VALUES ('K1', 'license'), ('K2', 'tion'), ('K3', 'und'), ('K4', 'eau'))
SELECT conv_id AS panel, feature_id, max(contains(lower(text), keyword)::INT) AS value FROM conversations, k GROUP BY ALL""")
def panel_vectors(spark, d):
    rows = table(spark, d, "conversations").withColumn("passage_id", F.struct("conv_id", "turn"))
    found = keyword_features(rows, (("K1", ("license",)), ("K2", ("tion",)), ("K3", ("und",)), ("K4", ("eau",))))
    return found.groupBy(F.col("passage_id.conv_id").alias("panel"), "feature_id").agg(F.max("value").alias("value"))


def tfidf_sql(counts: str, key: str = "passage_id") -> str:
    return f"""tf AS ({counts}), nn AS (SELECT count(DISTINCT {key}) AS n FROM tf), dfr AS (SELECT term, count(DISTINCT {key}) AS df FROM tf GROUP BY term),
raw AS (SELECT {key}, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN dfr USING (term), nn),
tw AS (SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight FROM raw)"""


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2)"
_ONE_TWO = f"SELECT passage_id, term, count(*) AS tf FROM (SELECT passage_id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM (SELECT passage_id, {TOKENS} AS ws FROM ({PASSAGES}))) GROUP BY ALL"


@q(f"""WITH {tfidf_sql(_ONE_TWO)}, side AS (SELECT passage_id, CASE WHEN role = 'target' THEN 'A' ELSE 'B' END AS side FROM ({ROLES})),
sums AS (SELECT term, coalesce(sum(weight) FILTER (side = 'A'), 0) AS a, coalesce(sum(weight) FILTER (side = 'B'), 0) AS b FROM tw JOIN side USING (passage_id) GROUP BY term)
SELECT round(sum(a * b) / (SELECT count(*) FILTER (side = 'A') * count(*) FILTER (side = 'B') FROM side), 6) AS mean_similarity FROM sums""")
def tfidf_similarity(spark, d):
    side = roles(spark, d).select("passage_id", F.when(F.col("role") == "target", "A").otherwise("B").alias("side"))
    texts = B.whole_texts(passages(spark, d).select("passage_id", "text"), "passage_id", []).select("passage_id", "texts")
    tags = side.groupBy("passage_id").agg(F.collect_list(F.struct("side")).alias("tags"))
    texts = texts.join(tags, "passage_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<side:string>>")))
    return _r(X.mean_pair_similarity(B.tag_sums(B.tfidf_blocks(texts, "passage_id", pairs=True, once=True), ["side"], met=True), side, "passage_id"), "mean_similarity")


def _within_sql(text: str) -> str:
    return f"""WITH two AS (SELECT work, passage_id, {text} AS text, row_number() OVER (PARTITION BY work ORDER BY passage_id) AS rn FROM ({PASSAGES}) QUALIFY rn <= 2),
tf AS (SELECT work, rn, term, count(*) AS tf FROM (SELECT work, rn, unnest({TOKENS}) AS term FROM two) GROUP BY ALL),
raw AS (SELECT work, rn, term, tf * (ln(3.0 / (1 + count(*) OVER (PARTITION BY work, term))) + 1) AS raw FROM tf),
w AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY work, rn)) AS weight FROM raw)
SELECT a.work, round(sum(a.weight * b.weight), 6) AS cosine FROM w a JOIN w b ON a.work = b.work AND a.term = b.term AND a.rn = 1 AND b.rn = 2 GROUP BY a.work"""


def _within_work(rows):
    two = first_n(rows, ["work"], ["passage_id"], 2)
    counts = X.terms(two, ["work", "rn"])
    df = counts.groupBy("work", "term").agg(F.count("*").alias("df"))
    raw = counts.join(df, ["work", "term"]).withColumn("raw", F.col("tf") * (F.ln(3.0 / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("work", "rn").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    w = raw.join(norm, ["work", "rn"]).select("work", "rn", "term", (F.col("raw") / F.col("norm")).alias("weight"))
    both = w.groupBy("work", "term").agg(F.sum(F.when(F.col("rn") == 1, F.col("weight"))).alias("a"), F.sum(F.when(F.col("rn") == 2, F.col("weight"))).alias("b"))
    return _r(both.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("work").agg(F.sum(F.col("a") * F.col("b")).alias("cosine")), "cosine")


@q(_within_sql("text"))
def within_work_cosine(spark, d):
    return _within_work(passages(spark, d))


@q(_within_sql(_subst(f"({SUBJECT_TEXT})", "|".join(MASK_TERMS), "[MASK]")))
def within_work_cosine_masked(spark, d):
    return _within_work(subject_passages(spark, d).withColumn("text", T.mask(F.col("text"), MASK_TERMS, "[MASK]")))


@q()
def random_projection_similarity(spark, d):
    side = roles(spark, d).select("passage_id", F.when(F.col("role") == "target", "A").otherwise("B").alias("side"))
    rows = passages(spark, d).select("passage_id", "text").join(side, "passage_id")  # a text without a side is in neither sum
    e = X.random_projection(rows.select(F.struct("passage_id", "side").alias("row"), "text"), "row").select("row.*", F.posexplode("vector").alias("term", "weight"))
    return _r(X.mean_pair_similarity(e, side, "passage_id"), "mean_similarity")


@q(f"""WITH w AS (SELECT passage_id, md5(unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''))) AS h FROM ({PASSAGES})),
v AS (SELECT passage_id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS dim, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS v FROM w GROUP BY ALL),
e AS (SELECT passage_id, dim, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY passage_id)), 0), 0) AS e FROM v),
side AS (SELECT passage_id, CASE WHEN role = 'target' THEN 'A' ELSE 'B' END AS side FROM ({ROLES})),
sums AS (SELECT dim, coalesce(sum(e) FILTER (side = 'A'), 0) AS a, coalesce(sum(e) FILTER (side = 'B'), 0) AS b FROM e JOIN side USING (passage_id) GROUP BY dim)
SELECT round(sum(a * b) / (SELECT count(*) FILTER (side = 'A') * count(*) FILTER (side = 'B') FROM side), 6) AS mean_similarity FROM sums""")
def hash_embed_similarity(spark, d):
    e = X.hash_embedding(passages(spark, d), "passage_id", 64)
    side = roles(spark, d).select("passage_id", F.when(F.col("role") == "target", "A").otherwise("B").alias("side"))
    return _r(X.mean_pair_similarity(e.select("passage_id", F.col("dim").alias("term"), F.col("value").alias("weight")), side, "passage_id"), "mean_similarity")


@q(f"""
WITH rec AS (SELECT work || ':' || tradition AS record_id, min(evidence_len) || ' words' AS body FROM (SELECT work, tradition, {_words.format('text')} AS evidence_len FROM ({PASSAGES})) GROUP BY ALL),
req AS (SELECT DISTINCT work AS check_id, work || ':' || l AS record_id FROM ({PASSAGES}), (VALUES ('en'), ('fr'), ('xx')) v(l) WHERE l <> 'xx' OR work = 'src1'),
j AS (SELECT check_id, count(body) = count(*) AS ids_ok, coalesce(string_agg(body, ' ' ORDER BY body), '') AS t FROM req LEFT JOIN rec USING (record_id) GROUP BY check_id)
SELECT check_id, ids_ok, regexp_matches(t, '^1[0-9]* words') AS pattern_ok, ids_ok AND trim(t) <> '' AS pass_ref FROM j""")
def attestation(spark, d):
    p = P.normalize_passages(passages(spark, d), "text", "text")
    rec = p.groupBy(F.concat_ws(":", "work", "tradition").alias("record_id")).agg(F.concat(F.min("word_count").cast("string"), F.lit(" words")).alias("body"))
    langs = F.explode(F.when(F.col("work") == "src1", F.array(F.lit("en"), F.lit("fr"), F.lit("xx"))).otherwise(F.array(F.lit("en"), F.lit("fr")))).alias("l")
    req = p.select("work").distinct().select("work", langs).select(F.col("work").alias("check_id"), F.concat_ws(":", "work", "l").alias("record_id"))
    return X.attestation(req, rec, "^1[0-9]* words")


QUERIES, ORACLE_SQL = q.queries, q.sql
