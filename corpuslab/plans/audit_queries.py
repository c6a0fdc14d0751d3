"""Queries of audits, selection, versions and inference."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as U
from ..operators import passages as P
from ..operators import score as X
from ..operators import select as S
from ..operators import splitting as Sp
from ..operators import stats as I
from . import Registry
from ..dims import ROBUSTNESS_TESTS
from ..operators.lexicon import ids_in_texts
from ..operators.annotate import annotate, label_value
from ..sources.scratch import written
from .score_queries import ANN, CLASSICAL, CUE_ROWS, FEATURES, FP, QS, QUANTUM, annotations, fingerprints, qs, values
from .score_queries import _r
from .text_queries import FREQUENT, RARE, _arr, _found, _subst, _words
from .views import PASSAGES, ROLES, passages, role_passages, roles, table

q = Registry()

_norm = "trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))"
R = 200


def _d(*keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::BIGINT"


@q(f"SELECT sha256(text) AS group_hash, count(*) AS n, min(passage_id) AS first_id FROM ({PASSAGES}) GROUP BY 1 HAVING count(*) > 1")
def leakage_exact(spark, d):
    return U.duplicate_groups(passages(spark, d), F.col("text"))


@q(f"SELECT sha256({_norm}) AS group_hash, count(*) AS n, min(passage_id) AS first_id FROM ({PASSAGES}) GROUP BY 1 HAVING count(*) > 1")
def leakage_normalized(spark, d):
    return U.duplicate_groups(passages(spark, d), U.normalized(F.col("text")))


_ISSUES = f"SELECT 'editorial_language' AS type, passage_id FROM ({PASSAGES}) WHERE regexp_matches(text, '(?i)mit license|apache') UNION ALL SELECT 'possible_commentary_mix', passage_id FROM ({PASSAGES}) WHERE contains(lower(text), 'released') OR contains(lower(text), 'copyright')"


def _issues(spark, d):
    return U.leakage_issues(passages(spark, d), "mit license|apache", ("released", "copyright"))


@q(_ISSUES)
def leakage_issues(spark, d):
    return _issues(spark, d)


def _split(spark, d):
    return passages(spark, d).withColumn("split", S.modulo_split(F.col("passage_id")))


SPLIT = f"SELECT *, CASE WHEN passage_id % 5 <= 2 THEN 'train' WHEN passage_id % 5 = 3 THEN 'dev' ELSE 'test' END AS split FROM ({PASSAGES})"


@q(f"""WITH o AS (SELECT passage_id FROM ({SPLIT}) GROUP BY passage_id HAVING count(DISTINCT split) > 1), i AS ({_ISSUES}), dup AS (SELECT text FROM ({PASSAGES}) GROUP BY text HAVING count(*) > 1),
c AS (SELECT (SELECT count(*) FROM dup) AS n_duplicates, (SELECT count(*) FROM o) AS n_hard, (SELECT count(*) FROM i) AS n_issues)
SELECT *, CASE WHEN n_duplicates > 0 OR n_hard > 0 THEN 'FAIL' WHEN n_issues > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM c""")
def leakage_status(spark, d):
    return U.audit_status(U.duplicate_groups(passages(spark, d), F.col("text")), U.overlaps(_split(spark, d), "passage_id"), _issues(spark, d))


@q(f"""WITH s AS (SELECT * FROM ({SPLIT})), k AS (SELECT sha256(text) AS key_value, split, 'HARD' AS severity FROM s UNION ALL SELECT work, split, 'WARN' FROM s)
SELECT key_value, list_sort(list(DISTINCT split)) AS splits, severity FROM k GROUP BY key_value, severity HAVING count(DISTINCT split) > 1""")
def split_overlap(spark, d):
    s = _split(spark, d)
    return U.overlaps(s.withColumn("h", F.sha2("text", 256)), "h").unionByName(U.overlaps(s, "work", severity="WARN"))


@q(f"""WITH a AS (SELECT 'PASSAGE_' || substr(sha256('pepper:' || passage_id), 1, 10) AS anonymous_id, passage_id, text FROM ({PASSAGES}))
SELECT x.anonymous_id, 'true_id_in_text' AS issue, y.passage_id::VARCHAR AS detail FROM a x JOIN a y ON contains(x.text, y.passage_id::VARCHAR)
UNION ALL SELECT anonymous_id, 'anon_id_in_text', anonymous_id FROM a WHERE contains(text, anonymous_id)
UNION ALL SELECT anonymous_id, 'label_leak', len(list_filter(['license', 'apache'], lambda p: regexp_matches(text, '(?i)' || p)))::VARCHAR FROM a WHERE regexp_matches(text, '(?i)license|apache')""")
def blind_audit(spark, d):
    work, mapping = P.blind_passages(passages(spark, d), "pepper")
    leaks = P.detect_leaks(work, ("license", "apache")).filter(F.size("leaks") > 0)
    issue = lambda rows, name, detail: rows.select("anonymous_id", F.lit(name).alias("issue"), detail.alias("detail"))
    out = issue(ids_in_texts(work, mapping), "true_id_in_text", F.col("found_id"))
    out = out.unionByName(issue(work.filter(F.contains("text", "anonymous_id")), "anon_id_in_text", F.col("anonymous_id")))
    return out.unionByName(issue(leaks, "label_leak", F.size("leaks").cast("string")))


#: Ids with punctuation: where a text's first sentence ends and the next begins.
_PHRASE = "[a-z]+[.,!?] [A-Z]?[a-z]+"


@q(f"""WITH i AS (SELECT DISTINCT regexp_extract(text, '{_PHRASE}') AS found_id FROM ({PASSAGES}))
SELECT passage_id, found_id FROM ({PASSAGES}) JOIN i ON contains(text, found_id) WHERE found_id <> ''""")
def phrases_in_texts(spark, d):
    rows = passages(spark, d)
    return ids_in_texts(rows, rows.select(F.regexp_extract("text", _PHRASE, 0).alias("phrase")), "passage_id", "phrase")


_AN = f"SELECT *, list_filter({_arr(RARE)}, lambda t: contains(lower(text), t)) AS strong FROM ({PASSAGES})"


@q(f"""WITH h AS ({_AN}), t AS (SELECT tradition, term || '=' || count(*) AS x FROM (SELECT tradition, unnest(strong) AS term FROM h) GROUP BY tradition, term),
l AS (SELECT tradition, list_sort(list(x)) AS terms FROM t GROUP BY tradition), b AS (SELECT tradition, count(*) AS n, count(*) FILTER (len(strong) > 0) AS n_contaminated FROM h GROUP BY tradition)
SELECT tradition, n, n_contaminated, round(n_contaminated / n, 6) AS rate, coalesce(terms, []) AS terms FROM b LEFT JOIN l USING (tradition)""")
def contamination_summary(spark, d):
    return _r(U.contamination_summary(P.anachronism_rows(passages(spark, d), RARE, FREQUENT), "tradition"), "rate")


@q(f"""WITH {QS}, y AS (SELECT tradition, count(*) FILTER (label = '1') AS positives, count(DISTINCT feature_id) FILTER (label = '1') AS n_features FROM ann GROUP BY tradition),
s AS (SELECT tradition, count(*) AS n, round(avg(qs), 6) AS mean_qs FROM qs JOIN p USING (passage_id) GROUP BY tradition), c AS (SELECT tradition, round(avg((len(strong) > 0)::INT), 6) AS contamination FROM ({_AN}) GROUP BY tradition)
SELECT * FROM y JOIN s USING (tradition) JOIN c USING (tradition)""")
def tradition_profile(spark, d):
    yes = annotations(spark, d).groupBy("tradition").agg(F.count_if(F.col("label") == "1").alias("positives"), F.countDistinct(F.when(F.col("label") == "1", F.col("feature_id"))).alias("n_features"))
    s = qs(spark, d).join(passages(spark, d).select("passage_id", "tradition"), "passage_id").groupBy("tradition").agg(F.count("*").alias("n"), F.avg("qs").alias("mean_qs"))
    c = P.anachronism_rows(passages(spark, d), RARE, FREQUENT).groupBy("tradition").agg(F.avg(F.col("contaminated").cast("double")).alias("contamination"))
    return _r(yes.join(s, "tradition").join(c, "tradition"), "mean_qs", "contamination")


@q(f"SELECT passage_id, work FROM ({PASSAGES}) WHERE passage_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def sealed_exclusion(spark, d):
    sealed = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("passage_id"))
    return passages(spark, d).select("passage_id", "work").join(sealed, "passage_id", "left_anti")


@q("SELECT a.doc_id AS passage_id FROM (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')) a JOIN (SELECT doc_id FROM labels WHERE quality = 1) b USING (doc_id)")
def id_overlap(spark, d):
    a = passages(spark, d).filter("work IN ('src1', 'src2')").select("passage_id")
    return a.intersect(roles(spark, d).filter("role = 'target'").select("passage_id"))


FAMILY = [(f"src{i}", f"family{i % 6}") for i in range(15)]


@q(f"SELECT passage_id, work, coalesce(f, 'unknown_' || work) AS family FROM ({PASSAGES}) LEFT JOIN (VALUES {', '.join(map(str, FAMILY))}) v(work, f) USING (work)")
def family_lookup(spark, d):
    return U.with_default(passages(spark, d).select("passage_id", "work"), spark.createDataFrame(FAMILY, "work string, family string"), "work", "family")


@q(f"""WITH r AS (SELECT passage_id, tradition, CASE WHEN passage_id % 3 = 0 THEN passage_id - 500 END AS date_min, CASE WHEN passage_id % 4 = 0 THEN passage_id - 400 END AS date_max FROM ({PASSAGES}))
SELECT passage_id, CASE WHEN date_min IS NULL AND date_max IS NULL THEN lo ELSE coalesce(date_min, date_max) END AS date_lo, CASE WHEN date_min IS NULL AND date_max IS NULL THEN hi ELSE coalesce(date_max, date_min) END AS date_hi
FROM r LEFT JOIN (VALUES ('en', -100, 200), ('fr', 300, 400)) v(tradition, lo, hi) USING (tradition)""")
def date_prior(spark, d):
    rows = passages(spark, d).select("passage_id", "tradition", F.expr("CASE WHEN passage_id % 3 = 0 THEN passage_id - 500 END").alias("date_min"), F.expr("CASE WHEN passage_id % 4 = 0 THEN passage_id - 400 END").alias("date_max"))
    priors = spark.createDataFrame([("en", -100, 200), ("fr", 300, 400)], "tradition string, lo int, hi int")
    return U.with_dates(rows, priors, "tradition").select("passage_id", "date_lo", "date_hi")


@q(f"SELECT passage_id, coalesce(s, 'development') AS split FROM ({PASSAGES}) LEFT JOIN (VALUES ('src0', 'train'), ('src1', 'train'), ('src2', 'sealed')) v(work, s) USING (work)")
def plan_split(spark, d):
    plan = spark.createDataFrame([("src0", "train"), ("src1", "train"), ("src2", "sealed")], "work string, split string")
    return passages(spark, d).join(F.broadcast(plan), "work", "left").select("passage_id", F.coalesce("split", F.lit("development")).alias("split"))


@q(f"SELECT passage_id, split FROM ({SPLIT})")
def modulo_split(spark, d):
    return _split(spark, d).select("passage_id", "split")


@q(f"""WITH rw AS (SELECT DISTINCT role, CASE WHEN role = 'control' THEN work ELSE work || 't' END AS work FROM ({PASSAGES}) JOIN ({ROLES}) USING (passage_id) UNION ALL SELECT 'target', 'src1' UNION ALL SELECT 'solo', 'srcX'),
s AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY work) * 2 <= count(*) OVER (PARTITION BY role) + 1 AS f FROM rw)
SELECT role, work, CASE WHEN bool_or(f) OVER (PARTITION BY work) THEN 'discovery' ELSE 'replication' END AS split FROM s""")
def split_discovery(spark, d):
    rows = role_passages(spark, d).select("role", F.when(F.col("role") == "control", F.col("work")).otherwise(F.concat("work", F.lit("t"))).alias("work"))
    return S.half_split(rows.unionByName(spark.createDataFrame([("target", "src1"), ("solo", "srcX")], "role string, work string")))


@q(f"SELECT passage_id, work FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY {_d("'s1'", 'passage_id')}, passage_id) AS k FROM ({PASSAGES})) WHERE k <= 5")
def seeded_sample(spark, d):
    return S.seeded_sample(passages(spark, d), ["work"], "passage_id", 5, "s1").select("passage_id", "work")


@q(f"SELECT passage_id, work FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY passage_id) AS k FROM ({PASSAGES})) ORDER BY k, work LIMIT 40")
def round_robin_sample(spark, d):
    return S.round_robin(passages(spark, d), "work", "passage_id", 40).select("passage_id", "work")


@q(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY passage_id) - 1 AS i, count(*) OVER (PARTITION BY work) AS n FROM ({PASSAGES}))
SELECT passage_id, work FROM k WHERE n <= 7 OR i IN (SELECT floor(j * n / 7.0)::BIGINT FROM range(7) t(j))""")
def even_sample(spark, d):
    return S.even_sample(passages(spark, d), ["work"], ["passage_id"], 7).select("passage_id", "work")


@q(f"SELECT passage_id, work, row_number() OVER (PARTITION BY work ORDER BY passage_id)::INT AS rn FROM ({PASSAGES}) QUALIFY rn <= 10")
def calibration_sample(spark, d):
    return S.first_n(passages(spark, d), ["work"], ["passage_id"], 10).select("passage_id", "work", "rn")


@q(f"WITH {QS} SELECT passage_id, round(qs, 6) AS qs FROM qs ORDER BY round(qs, 9) DESC, passage_id LIMIT 10")
def top_passages(spark, d):
    return _r(S.top(qs(spark, d), F.round("qs", 9), "passage_id", 10), "qs")


@q(f"SELECT arg_min(passage_id, passage_id) AS passage_id, sha256(text) AS h FROM ({PASSAGES}) GROUP BY text")
def dedup_keep_first(spark, d):
    rows = passages(spark, d).withColumn("h", F.sha2("text", 256))
    return S.dedup_keep_first(rows, ["h"], "passage_id").select("passage_id", "h")


@q(f"SELECT tradition, work, coalesce(role, 'none') AS role, count(*) AS n FROM ({PASSAGES}) LEFT JOIN ({ROLES}) USING (passage_id) GROUP BY ALL")
def balance_report(spark, d):
    rows = passages(spark, d).join(roles(spark, d), "passage_id", "left")
    return rows.groupBy("tradition", "work", F.coalesce("role", F.lit("none")).alias("role")).agg(F.count("*").alias("n"))


@q(f"SELECT split, tradition, count(*) AS n, count(DISTINCT work) AS works FROM ({SPLIT}) GROUP BY ROLLUP (split, tradition)")
def corpus_meta(spark, d):
    return _split(spark, d).rollup("split", "tradition").agg(F.count("*").alias("n"), F.countDistinct("work").alias("works"))


@q("""SELECT event_id, event_type FROM events WHERE regexp_matches(props, '"(k|score|page|item|ref|a|v)"\\s*:')""")
def json_key_scan(spark, d):
    return U.json_key_scan(table(spark, d, "events"), "props", ("k", "score", "page", "item", "ref", "a", "v")).select("event_id", "event_type")


_ABL = "de|les|the"


@q(f"""WITH b AS (SELECT passage_id, tradition, len({_found('text', _ABL)}) AS n0, list_filter({_arr(FREQUENT)}, lambda t: contains(lower(text), t)) AS f0, {_subst('text', 'une|thther|und', '')} AS t1 FROM ({PASSAGES})),
a AS (SELECT *, list_filter({_arr(FREQUENT)}, lambda t: contains(lower(t1), t)) AS f1 FROM b)
SELECT passage_id, list_filter(f0, lambda x: NOT list_contains(f1, x)) AS lost, len(f1) - len(f0) AS delta FROM a""")
def lexicon_ablation(spark, d):
    rows = passages(spark, d)
    rows = rows.withColumns({"f0": T.containing(F.col("text"), FREQUENT), "f1": T.containing(T.mask(F.col("text"), ["une", "thther", "und"], ""), FREQUENT)})
    return rows.select("passage_id", F.array_except("f0", "f1").alias("lost"), (F.size("f1") - F.size("f0")).cast("long").alias("delta"))


_MASKED = f"SELECT * REPLACE ({_subst('text', 'une|thther|und|ment', '')} AS text) FROM ({PASSAGES})"
_ONE = "SELECT passage_id, any_value(tradition) AS tradition, any_value(qs) AS qs, list_sort(list(feature_id) FILTER (label = '1')) AS fs FROM ann JOIN qs USING (passage_id) GROUP BY passage_id"
_ABLATED = f"""b AS (WITH {QS} {_ONE}), m AS (WITH {QS.replace(f"p AS ({PASSAGES})", f"p AS ({_MASKED})")} {_ONE}),
ab AS (SELECT passage_id, b.tradition, b.qs AS before, m.qs AS after, m.qs - b.qs AS delta, list_sort(list_filter(coalesce(b.fs, []), lambda x: NOT list_contains(coalesce(m.fs, []), x))) AS lost, list_sort(list_filter(coalesce(m.fs, []), lambda x: NOT list_contains(coalesce(b.fs, []), x))) AS gained FROM b JOIN m USING (passage_id))"""


def _ablation(spark, d):
    rows = passages(spark, d)
    masked = rows.withColumn("text", T.mask(F.col("text"), ["une", "thther", "und", "ment"], ""))
    sides = []
    for x in (rows, masked):
        found = written(annotate(x, CUE_ROWS, FEATURES).select("passage_id", "tradition", "feature_id", "label"))  # features and scores read it
        sides.append((found, X.specificity(X.theory_scores(found.select("passage_id", "feature_id", label_value(F.col("label")).alias("value")), fingerprints(spark)), QUANTUM, CLASSICAL)))
    return U.ablation(*[U.scored_features(a, s) for a, s in sides])


@q(f"WITH {_ABLATED} SELECT passage_id, tradition, round(before, 6) AS before, round(after, 6) AS after, round(delta, 6) AS delta, lost, gained FROM ab")
def masking_ablation(spark, d):
    return _r(_ablation(spark, d), "before", "after", "delta")


@q(f"WITH {_ABLATED} SELECT tradition, count(*) AS n, round(avg(before), 6) AS mean_before, round(avg(delta), 6) AS mean_delta, sum(len(lost))::BIGINT AS n_lost, sum(len(gained))::BIGINT AS n_gained FROM ab GROUP BY tradition")
def masking_ablation_by_group(spark, d):
    rows = _ablation(spark, d).groupBy("tradition").agg(F.count("*").alias("n"), F.avg("before").alias("mean_before"), F.avg("delta").alias("mean_delta"), F.sum(F.size("lost")).alias("n_lost"), F.sum(F.size("gained")).alias("n_gained"))
    return _r(rows, "mean_before", "mean_delta")


_year = "CASE WHEN passage_id % 9 <> 0 THEN 1850 + passage_id % 150 END"
_men = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // length('{t}')" for t in FREQUENT)


@q(f"""WITH {QS}, y AS (SELECT passage_id, ({_year}) // 10 * 10 AS decade, {_men} AS hits FROM p)
SELECT decade::BIGINT AS decade, count(*) AS n, sum(hits)::BIGINT AS total, round(avg(hits), 6) AS mean_hits, round(avg(qs), 6) AS mean_qs FROM y JOIN qs USING (passage_id) WHERE decade IS NOT NULL GROUP BY decade""")
def decade_modernization(spark, d):
    hits = sum((T.mentions(F.col("text"), t) for t in FREQUENT), F.lit(0))
    rows = passages(spark, d).select("passage_id", F.expr(f"({_year}) div 10 * 10").alias("decade"), hits.alias("hits")).filter("decade IS NOT NULL").join(qs(spark, d), "passage_id")
    return _r(rows.groupBy("decade").agg(F.count("*").alias("n"), F.sum("hits").alias("total"), F.avg("hits").alias("mean_hits"), F.avg("qs").alias("mean_qs")), "mean_hits", "mean_qs")


_STYLE = "CASE passage_id % 5 WHEN 0 THEN 'recent_scholarly' WHEN 1 THEN 'literal' WHEN 2 THEN 'machine' WHEN 3 THEN 'older_scholarly' ELSE 'synthetic' END"
_TCI = f"""{QS}, st AS (SELECT passage_id // 3 AS family, {_STYLE} AS style, qs FROM qs),
g AS (SELECT family, avg(qs) FILTER (style IN ('recent_scholarly', 'machine')) AS m, avg(qs) FILTER (style IN ('literal', 'older_scholarly')) AS o FROM st GROUP BY family),
tci AS (SELECT family, m - o AS tci FROM g WHERE m IS NOT NULL AND o IS NOT NULL)"""


def contamination_index(scores, modern=("recent_scholarly", "machine"), older=("literal", "older_scholarly")):
    """(family, tci, interpretation) of families that have both modern and older versions."""
    m = lambda s: F.avg(F.when(F.col("style").isin(*s), F.col("qs")))
    out = scores.groupBy("family").agg((m(modern) - m(older)).alias("tci")).filter("tci IS NOT NULL")
    t = F.round("tci", 9)
    return out.withColumn("interpretation", F.when(t > 0.1, "possible_modernization").when(F.abs(t) <= 0.1, "near_zero").otherwise("older_higher"))


def _families(spark, d):
    return qs(spark, d).select(F.expr("passage_id div 3").alias("family"), F.expr(_STYLE).alias("style"), "qs")


@q(f"WITH {_TCI} SELECT family, round(tci, 6) AS tci, CASE WHEN round(tci, 9) > 0.1 THEN 'possible_modernization' WHEN abs(round(tci, 9)) <= 0.1 THEN 'near_zero' ELSE 'older_higher' END AS interpretation FROM tci")
def tci(spark, d):
    return _r(contamination_index(_families(spark, d)), "tci")


@q(f"WITH {_TCI} SELECT count(*) AS n_pairs, round(avg(tci), 6) AS mean_tci, round(stddev_samp(tci), 6) AS std_tci FROM tci")
def tci_summary(spark, d):
    return _r(contamination_index(_families(spark, d)).agg(F.count("*").alias("n_pairs"), F.avg("tci").alias("mean_tci"), F.stddev_samp("tci").alias("std_tci")), "mean_tci", "std_tci")


_HITS = f"list_filter({_arr(FREQUENT)}, lambda t: contains(lower(text), t))"


@q(f"""WITH v AS (SELECT conv_id, turn, {_HITS} AS f, length(text) AS n FROM conversations), l AS (SELECT *, lag(f) OVER w AS pf, lag(turn) OVER w AS prev, lag(n) OVER w AS pn FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, prev, turn, list_sort(list_filter(f, lambda x: NOT list_contains(pf, x))) AS gained, list_sort(list_filter(pf, lambda x: NOT list_contains(f, x))) AS lost, n - pn AS delta FROM l WHERE prev IS NOT NULL""")
def version_shift(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    v = table(spark, d, "conversations").select("conv_id", "turn", T.containing(F.col("text"), FREQUENT).alias("f"), F.length("text").cast("long").alias("n"))
    v = v.withColumn("p", F.lag(F.struct("turn", "f", "n")).over(w)).filter("p IS NOT NULL")
    return v.select("conv_id", F.col("p.turn").alias("prev"), "turn", F.array_sort(F.array_except("f", "p.f")).alias("gained"), F.array_sort(F.array_except("p.f", "f")).alias("lost"), (F.col("n") - F.col("p.n")).alias("delta"))


_dens = f"({' + '.join(f'''regexp_matches(text, '(?i){w}')::INT''' for w in FREQUENT)}) / greatest({_words.format('text')}, 1)"


@q(f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY tradition ORDER BY passage_id) AS k FROM ({PASSAGES})) SELECT tradition, count(*) AS n, round(avg({_dens}), 6) AS density FROM k WHERE k <= 80 GROUP BY tradition")
def modernization_by_group(spark, d):
    rows = S.first_n(passages(spark, d), ["tradition"], ["passage_id"], 80)
    dens = sum((F.col("text").rlike(f"(?iu){w}").cast("int") for w in FREQUENT), F.lit(0)) / F.greatest(T.word_count(F.col("text")), F.lit(1))
    return _r(rows.groupBy("tradition").agg(F.count("*").alias("n"), F.avg(dens).alias("density")), "density")


_KW = (("K1", "tion"), ("K2", "und"), ("K3", "eau"), ("K4", "que"))


def _top1_sql(text: str) -> str:
    best = " ".join(f"WHEN contains(lower({text}), '{k}') THEN '{f}'" for f, k in _KW)
    return f"CASE {best} END"


@q(f"SELECT passage_id, {_top1_sql('text')} AS raw_top, {_top1_sql('m')} AS masked_top, {_top1_sql('text')} IS DISTINCT FROM {_top1_sql('m')} AS changed FROM (SELECT *, replace(replace(text, 'tion', ''), 'und', '') AS m FROM ({PASSAGES}))")
def masked_top1_shift(spark, d):
    rows = passages(spark, d).withColumn("m", F.replace(F.replace("text", F.lit("tion"), F.lit("")), F.lit("und"), F.lit("")))
    top = lambda c: F.coalesce(*[F.when(F.contains(F.lower(c), F.lit(k)), F.lit(f)) for f, k in _KW])
    return rows.select("passage_id", top("text").alias("raw_top"), top("m").alias("masked_top"), (~top("text").eqNullSafe(top("m"))).alias("changed"))


@q(f"WITH {QS} SELECT round(corr(length(text), qs), 6) AS length_qs, round(corr(passage_id % 150, {_dens}), 6) AS year_density FROM p JOIN qs USING (passage_id)")
def length_corr(spark, d):
    dens = sum((F.col("text").rlike(f"(?iu){w}").cast("int") for w in FREQUENT), F.lit(0)) / F.greatest(T.word_count(F.col("text")), F.lit(1))
    rows = passages(spark, d).select("passage_id", F.length("text").alias("n"), dens.alias("dens")).join(qs(spark, d), "passage_id")
    return _r(rows.agg(F.corr("n", "qs").alias("length_qs"), F.corr(F.col("passage_id") % 150, "dens").alias("year_density")), "length_qs", "year_density")


@q(f"""WITH m AS (SELECT role, 'chars' AS metric, n_chars::DOUBLE AS v FROM documents JOIN ({ROLES}) ON doc_id = passage_id UNION ALL SELECT role, 'words', {_words.format('text')}::DOUBLE FROM documents JOIN ({ROLES}) ON doc_id = passage_id)
SELECT metric, role, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, max(v) AS max, round(avg((v > 100)::INT), 6) AS share FROM m GROUP BY ALL""")
def group_contrast(spark, d):
    rows = role_passages(spark, d).select("role", F.length("text").cast("double").alias("chars"), T.word_count(F.col("text")).cast("double").alias("words"))
    rows = rows.unpivot(["role"], ["chars", "words"], "metric", "v")
    out = rows.groupBy("metric", "role").agg(F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.max("v").alias("max"), F.avg((F.col("v") > 100).cast("double")).alias("share"))
    return _r(out, "mean", "median", "share")


# Inference: n_chars of documents in the clusters of their source, arms by label.

_ARMS = f"arms AS (SELECT role AS arm, source AS cluster, n_chars::DOUBLE AS v, doc_id FROM documents JOIN ({ROLES}) ON doc_id = passage_id)"
_CL = f"{_ARMS}, cl AS (SELECT arm, cluster, count(*) AS n, sum(v) AS total FROM arms GROUP BY ALL)"


def _arms(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), F.col("source").alias("work"), "n_chars", "lang")
    return docs.join(roles(spark, d), "passage_id")


def _clusters(spark, d):
    return I.cluster_sums(_arms(spark, d), "role", "work", "n_chars")


_obs = lambda a: f"sum(total) FILTER (arm = '{a}') / sum(n) FILTER (arm = '{a}')"
_dl = "avg(v) FILTER (arm = 'target') - avg(v) FILTER (arm = 'control')"


@q(f"WITH {_ARMS} SELECT round(avg(v) FILTER (arm = 'target'), 6) AS mean_target, round(avg(v) FILTER (arm = 'control'), 6) AS mean_control, round({_dl}, 6) AS delta FROM arms")
def primary_effect(spark, d):
    return _r(I.mean_difference(_arms(spark, d), "role", "n_chars", "target", "control"), "mean_target", "mean_control", "delta")


def _boot_sql(seed: str, source: str = "cl", cols: str = "n, total") -> str:
    return f"""num AS (SELECT *, row_number() OVER (ORDER BY arm, cluster) - 1 AS i, count(*) OVER () AS k FROM {source}),
dr AS (SELECT rep, slot, num.* FROM (SELECT r.range AS rep, s.i AS slot, {_d(f"'{seed}'", 'r.range', 's.i')} % s.k AS j FROM range({R}) r, num s) x JOIN num ON num.i = x.j)"""


_BOOT = f"{_boot_sql('b1')}, bm AS (SELECT rep, sum(total) / sum(n) AS m FROM dr GROUP BY rep)"
_CI = "(SELECT count(*) AS n_boot, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM bm)"


@q(f"WITH {_CL}, {_BOOT} SELECT *, (SELECT round(sum(total) / sum(n), 6) FROM cl) AS point FROM {_CI}")
def cluster_bootstrap_ci(spark, d):
    return _r(I.cluster_bootstrap_ci(_clusters(spark, d), R, "b1"), "lo", "hi", "point")


def _perm_sql(seed: str) -> str:
    return f"""pb AS (SELECT arm, cluster, total / n AS m, count(*) FILTER (arm = 'target') OVER () AS n_t FROM cl),
po AS (SELECT range AS rep, m, row_number() OVER (PARTITION BY range ORDER BY {_d(f"'{seed}'", 'range', 'arm', 'cluster')}, arm, cluster) <= n_t AS in_t FROM range({R}), pb),
pd AS (SELECT rep, avg(m) FILTER (in_t) - avg(m) FILTER (NOT in_t) AS delta FROM po GROUP BY rep)"""


@q(f"WITH {_CL}, {_perm_sql('p1')}, ob AS (SELECT {_obs('target')} - {_obs('control')} AS o FROM cl) SELECT round(any_value(o), 6) AS observed, round((count(*) FILTER (abs(delta) >= abs(o) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM pd, ob")
def cluster_permutation(spark, d):
    return _r(I.cluster_permutation(_clusters(spark, d), "target", "control", R, "p1"), "observed", "p")


@q(f"WITH {_CL}, {_perm_sql('p2')}, ob AS (SELECT avg(total / n) FILTER (arm = 'target') - avg(total / n) FILTER (arm = 'control') AS o FROM cl) SELECT round(any_value(o), 6) AS observed, round(count(*) FILTER (delta >= o - 1e-12) / count(*), 6) AS p FROM pd, ob")
def work_permutation(spark, d):
    return _r(I.cluster_permutation(_clusters(spark, d), "target", "control", R, "p2", two_sided=False, correction=0, observed_by="cluster"), "observed", "p")


@q(f"WITH {_ARMS} SELECT c.cluster, round((SELECT {_dl} FROM arms WHERE arms.cluster <> c.cluster), 6) AS delta FROM (SELECT DISTINCT cluster FROM arms) c")
def leave_one_work_out(spark, d):
    return _r(I.leave_one_cluster_out(_clusters(spark, d), "target", "control"), "delta")


@q("SELECT doc_id, round(avg(n_chars) OVER () - (sum(n_chars) OVER () - n_chars) / (count(*) OVER () - 1), 6) AS effect FROM documents")
def leave_one_out(spark, d):
    return _r(I.leave_one_out(table(spark, d, "documents"), "doc_id", "n_chars"), "effect")


@q(f"""WITH f AS (SELECT lang, role AS arm, source AS cluster, count(*) AS n, sum(n_chars)::DOUBLE AS total FROM documents JOIN ({ROLES}) ON doc_id = passage_id GROUP BY ALL),
pb AS (SELECT lang, arm, cluster, total / n AS m, count(*) FILTER (arm = 'target') OVER (PARTITION BY lang) AS n_t FROM f),
po AS (SELECT range AS rep, lang, m, row_number() OVER (PARTITION BY lang, range ORDER BY {_d("'m1'", 'range', 'arm', 'cluster')}, arm, cluster) <= n_t AS in_t FROM range({R}), pb),
pd AS (SELECT lang, rep, avg(m) FILTER (in_t) - avg(m) FILTER (NOT in_t) AS delta FROM po GROUP BY ALL), mx AS (SELECT rep, max(abs(delta)) AS largest FROM pd GROUP BY rep),
ob AS (SELECT lang, avg(total / n) FILTER (arm = 'target') - avg(total / n) FILTER (arm = 'control') AS o FROM f GROUP BY lang)
SELECT lang, round(o, 6) AS observed, round(avg((largest >= abs(o) - 1e-12)::INT), 6) AS p_family FROM mx, ob GROUP BY lang, o""")
def max_stat_permutation(spark, d):
    c = _arms(spark, d).groupBy("lang", F.col("role").alias("arm"), F.col("work").alias("cluster")).agg(F.count("*").alias("n"), F.sum(F.col("n_chars").cast("double")).alias("total"))
    return _r(I.max_statistic(c, "target", "control", "lang", R, "m1"), "observed", "p_family")


@q(f"WITH {_CL}, {_BOOT}, {_perm_sql('p1')}, ob AS (SELECT {_obs('target')} - {_obs('control')} AS o FROM cl) SELECT round(any_value(o), 6) AS delta, (SELECT lo FROM {_CI}) AS lo, (SELECT hi FROM {_CI}) AS hi, round((count(*) FILTER (abs(delta) >= abs(o) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM pd, ob")
def effect_bundle(spark, d):
    c = _clusters(spark, d)
    ci = I.cluster_bootstrap_ci(c, R, "b1").select("lo", "hi")
    return _r(I.cluster_permutation(c, "target", "control", R, "p1").withColumnRenamed("observed", "delta").crossJoin(ci), "delta", "lo", "hi", "p")


# The same inference with draws split down a tree of buckets; its distribution is tested.


@q()
def cluster_bootstrap_split(spark, d):
    return _r(Sp.split_bootstrap_ci(_clusters(spark, d), R, "s1"), "lo", "hi", "point")


@q()
def f1_bootstrap_split(spark, d):
    rows = _arms(spark, d).withColumn("f1", (F.col("n_chars") % 100) / 100.0)
    return _r(Sp.split_bootstrap_ci(I.cluster_sums(rows, None, "passage_id", "f1"), R, "s2"), "lo", "hi", "point")


@q()
def cluster_permutation_split(spark, d):
    return _r(Sp.split_permutation(_clusters(spark, d), "target", "control", R, "s3"), "observed", "p")


@q()
def passage_permutation_split(spark, d):
    return _r(Sp.split_permutation(I.cluster_sums(_arms(spark, d), "role", "passage_id", "n_chars"), "target", "control", R, "s4"), "observed", "p")


@q()
def variance_bootstrap_split(spark, d):
    m = I.cluster_moments(table(spark, d, "documents"), "source", "n_chars")
    return _r(Sp.split_variance_ci(m, R, "s5"), "between_lo", "between_hi", "within_lo", "within_hi")


@q("SELECT 0.025::DOUBLE AS share, round(quantile_cont(n_chars::DOUBLE, 0.025), 6) AS value FROM documents UNION ALL SELECT 0.5, round(quantile_cont(n_chars::DOUBLE, 0.5), 6) FROM documents UNION ALL SELECT 0.95, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) FROM documents UNION ALL SELECT 0.975, round(quantile_cont(n_chars::DOUBLE, 0.975), 6) FROM documents")
def length_quantiles(spark, d):
    shares = [0.025, 0.5, 0.95, 0.975]
    found = I.exact_quantiles(table(spark, d, "documents"), "n_chars", shares)
    return _r(spark.createDataFrame(list(zip(shares, found, strict=True)), "share double, value double"), "value")


_ACC = "(passage_id * 7 % 10 < 6)"


@q(f"""WITH g AS (SELECT tradition, count(*) AS n, sum({_ACC}::INT) AS k FROM ({PASSAGES}) GROUP BY tradition),
s AS (SELECT r.range AS rep, tradition, n, k, unnest(range(n)) AS slot FROM range({R}) r, g), b AS (SELECT tradition, rep, avg(({_d("'a1'", 'tradition', 'rep', 'slot')} % n < k)::INT) AS a FROM s GROUP BY ALL)
SELECT tradition, n, round(any_value(k) / n, 6) AS accuracy, round(quantile_cont(a, 0.025), 6) AS lo, round(quantile_cont(a, 0.975), 6) AS hi FROM b JOIN g USING (tradition) GROUP BY tradition, n""")
def accuracy_bootstrap(spark, d):
    return _r(I.binary_bootstrap(passages(spark, d), "tradition", F.expr(_ACC), R, "a1"), "accuracy", "lo", "hi")


@q(f"""WITH cl AS (SELECT 'all' AS arm, doc_id AS cluster, 1 AS n, (n_chars % 100) / 100.0 AS total FROM documents JOIN ({ROLES}) ON doc_id = passage_id), {_boot_sql('f1')}, bm AS (SELECT rep, sum(total) / sum(n) AS m FROM dr GROUP BY rep)
SELECT *, (SELECT round(sum(total) / sum(n), 6) FROM cl) AS point FROM {_CI}""")
def f1_bootstrap(spark, d):
    rows = _arms(spark, d).withColumn("f1", (F.col("n_chars") % 100) / 100.0)
    return _r(I.cluster_bootstrap_ci(I.cluster_sums(rows, None, "passage_id", "f1"), R, "f1"), "lo", "hi", "point")


@q()
def accuracy_bootstrap_counts(spark, d):
    return _r(I.value_bootstrap(passages(spark, d), F.col("tradition"), F.expr(_ACC), R, "a2").withColumnsRenamed({"by": "tradition", "point": "accuracy"}), "accuracy", "lo", "hi")


@q()
def f1_bootstrap_counts(spark, d):
    return _r(I.value_bootstrap(_arms(spark, d), F.lit("all"), (F.col("n_chars") % 100) / 100.0, R, "f2").drop("by"), "point", "lo", "hi")


_MO = "mo AS (SELECT 'all' AS arm, source AS cluster, avg(n_chars) AS m, var_samp(n_chars) AS v FROM documents GROUP BY source)"


@q(f"WITH {_MO}, s AS (SELECT count(*) AS n_clusters, stddev_samp(m) AS b, sqrt(avg(v)) AS w FROM mo) SELECT n_clusters, round(b, 6) AS between_sd, round(w, 6) AS within_sd, round(b * b / (b * b + w * w), 6) AS icc FROM s")
def variance_components(spark, d):
    return _r(I.variance_parts(I.cluster_moments(table(spark, d, "documents"), "source", "n_chars")), "between_sd", "within_sd", "icc")


@q(f"""WITH {_MO}, {_boot_sql('v1', 'mo')}, b AS (SELECT rep, stddev_samp(m) AS b FROM (SELECT DISTINCT rep, cluster, m FROM dr) GROUP BY rep), w AS (SELECT rep, sqrt(avg(v)) AS w FROM dr GROUP BY rep)
SELECT round((SELECT quantile_cont(b, 0.025) FROM b), 6) AS between_lo, round((SELECT quantile_cont(b, 0.975) FROM b), 6) AS between_hi, round((SELECT quantile_cont(w, 0.025) FROM w), 6) AS within_lo, round((SELECT quantile_cont(w, 0.975) FROM w), 6) AS within_hi""")
def variance_bootstrap(spark, d):
    m = I.cluster_moments(table(spark, d, "documents"), "source", "n_chars")
    return _r(I.variance_bootstrap(m, R, "v1"), "between_lo", "between_hi", "within_lo", "within_hi")


_SHUF = f"""{ANN}, {FP}, pl AS (SELECT passage_id, feature_id, row_number() OVER (PARTITION BY passage_id ORDER BY feature_id) AS i FROM ann),
de AS (SELECT passage_id, value, row_number() OVER (PARTITION BY passage_id ORDER BY {_d("'sh'", 'passage_id', 'feature_id')}, feature_id) AS i FROM ann),
sv AS (SELECT passage_id, feature_id, value FROM pl JOIN de USING (passage_id, i)),
ss AS (SELECT passage_id, theory_id, coalesce(sum(w * least(value, t)) FILTER (value IS NOT NULL) / nullif(sum(w * greatest(value, t)) FILTER (value IS NOT NULL), 0), 0) AS score FROM sv JOIN fp USING (feature_id) GROUP BY ALL),
sq AS (SELECT passage_id, coalesce(max(score) FILTER (theory_id IN {QUANTUM}), 0) - coalesce(max(score) FILTER (theory_id IN {CLASSICAL}), 0) AS qs FROM ss GROUP BY passage_id)"""


@q(f"WITH {_SHUF} SELECT count(*) AS n, round(avg(qs), 6) AS mean_qs, round(avg(abs(qs)), 6) AS mean_abs_qs FROM sq")
def shuffle_control(spark, d):
    s = I.shuffled(values(spark, d), ["passage_id"], "feature_id", "value", "sh")
    out = X.specificity(X.theory_scores(s, fingerprints(spark)), QUANTUM, CLASSICAL)
    return _r(out.agg(F.count("*").alias("n"), F.avg("qs").alias("mean_qs"), F.avg(F.abs("qs")).alias("mean_abs_qs")), "mean_qs", "mean_abs_qs")


@q(f"""WITH pl AS (SELECT work, passage_id, row_number() OVER (PARTITION BY work ORDER BY passage_id) AS i FROM ({PASSAGES})),
de AS (SELECT work, tradition, row_number() OVER (PARTITION BY work ORDER BY {_d("'lp'", 'work', 'passage_id')}, passage_id) AS i FROM ({PASSAGES})) SELECT work, passage_id, tradition FROM pl JOIN de USING (work, i)""")
def label_permute(spark, d):
    return I.shuffled(passages(spark, d), ["work"], "passage_id", "tradition", "lp")


@q(f"""WITH {_ARMS}, k AS (SELECT arm, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM arms), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM arms GROUP BY v)),
s AS (SELECT count(*) FILTER (arm = 'target') AS n1, count(*) FILTER (arm <> 'target') AS n2, sum(r) FILTER (arm = 'target') AS rs FROM k), u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s, t)
SELECT n1, n2, u, round((u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u""")
def mann_whitney(spark, d):
    return _r(I.mann_whitney(_arms(spark, d), "role", "n_chars", "target").drop("p"), "z")


_TAIL = "0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)"


@q(f"""WITH {_ARMS}, a2 AS (SELECT lang, arms.* FROM arms JOIN documents USING (doc_id)), k AS (SELECT lang, arm, v, rank() OVER (PARTITION BY lang ORDER BY v) + (count(*) OVER (PARTITION BY lang, v) - 1) / 2 AS r FROM a2),
t AS (SELECT lang, sum(c * c * c - c) AS ties FROM (SELECT lang, count(*) AS c FROM a2 GROUP BY lang, v) GROUP BY lang),
s AS (SELECT lang, count(*) FILTER (arm = 'target') AS n1, count(*) FILTER (arm <> 'target') AS n2, coalesce(sum(r) FILTER (arm = 'target'), 0) AS rs FROM k GROUP BY lang), u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s JOIN t USING (lang)),
z AS (SELECT *, (u - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12 * (n + 1 - ties / nullif(n * (n - 1), 0))), 0) AS z FROM u), x AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z)
SELECT lang, n1, n2, round(CASE WHEN n1 >= 3 AND n2 >= 3 THEN CASE WHEN z >= 0 THEN {_TAIL} ELSE 1 - {_TAIL} END END, 6)::DOUBLE AS p FROM x""")
def mann_whitney_p(spark, d):
    return _r(I.mann_whitney(_arms(spark, d), "role", "n_chars", "target", by=["lang"]).select("lang", "n1", "n2", "p"), "p")


#: Which rows the tests that can be run here keep.
_VARIANTS = {"H_older_translations_only": "passage_id % 150 < 75", "I_literal_translations_only": "passage_id % 5 = 1", "J_mask_physics_vocab": "work <> 'src0'", "L_high_confidence_only": "n_chars >= 500"}
_vsql = lambda w: w.replace("passage_id", "doc_id").replace("work", "cluster").replace("n_chars", "v")


@q(f"""WITH {_ARMS}, c AS ({" UNION ALL ".join(f"SELECT '{t}' AS test, {_dl} AS delta FROM arms WHERE {_vsql(w)}" for t, w in _VARIANTS.items())}), f AS (SELECT {_dl} AS p FROM arms)
SELECT test, CASE WHEN delta IS NULL THEN 'not_run' ELSE 'computed' END AS status, round(coalesce(delta, p), 6) AS delta FROM (VALUES {', '.join(f"('{t}')" for t in ROBUSTNESS_TESTS)}) t(test) LEFT JOIN c USING (test), f""")
def robustness_battery(spark, d):
    rows = _arms(spark, d)
    named = F.explode(F.filter(F.array(*[F.when(F.expr(w), F.lit(t)) for t, w in _VARIANTS.items()]), lambda x: x.isNotNull())).alias("test")
    side = lambda a: F.avg(F.when(F.col("role") == a, F.col("n_chars")))
    variants = rows.select("role", "n_chars", named).groupBy("test").agg((side("target") - side("control")).alias("delta"))
    return _r(I.robustness_battery(variants, I.mean_difference(rows, "role", "n_chars", "target", "control")), "delta")


TESTS = ("full", "no_hot_source", "english_only", "short_only", "masking", "translation_swap")


@q(f"""WITH {_ARMS}, x AS (SELECT arms.*, lang FROM arms JOIN documents USING (doc_id)),
c AS (SELECT 'full' AS test, {_dl} AS delta FROM x UNION ALL SELECT 'no_hot_source', {_dl} FROM x WHERE cluster <> 'src0' UNION ALL SELECT 'english_only', {_dl} FROM x WHERE lang = 'en' UNION ALL SELECT 'short_only', {_dl} FROM x WHERE v < 2000)
SELECT test, CASE WHEN delta IS NULL THEN 'not_run' ELSE 'computed' END AS status, round(delta, 6) AS delta, round(delta - (SELECT delta FROM c WHERE test = 'full'), 6) AS change FROM (VALUES {', '.join(f"('{t}')" for t in TESTS)}) t(test) LEFT JOIN c USING (test)""")
def robustness_table(spark, d):
    rows = _arms(spark, d)
    subsets = {"full": rows, "no_hot_source": rows.filter("work <> 'src0'"), "english_only": rows.filter("lang = 'en'"), "short_only": rows.filter("n_chars < 2000")}
    done = None
    for name, s in subsets.items():
        one = I.mean_difference(s, "role", "n_chars", "target", "control").select(F.lit(name).alias("test"), "delta")
        done = one if done is None else done.unionByName(one)
    names = spark.createDataFrame([(t,) for t in TESTS], "test string")
    return _r(I.robustness_table(names, done, done.filter("test = 'full'")), "delta", "change")


@q(f"""WITH p AS (SELECT source AS test, round(abs(avg(n_chars) - 2000) / (avg(n_chars) + 2000) / 5, 9) AS p FROM documents GROUP BY source), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS n FROM p)
SELECT test, p, coalesce(i <= (SELECT max(i) FROM k WHERE p <= 0.05 * i / n), false) AS reject FROM k""")
def bh_fdr(spark, d):
    p = F.round(F.abs(F.avg("n_chars") - 2000) / (F.avg("n_chars") + 2000) / 5, 9)
    return I.bh_fdr(table(spark, d, "documents").groupBy(F.col("source").alias("test")).agg(p.alias("p")), "p", "test", 0.05)


QUERIES, ORACLE_SQL = q.queries, q.sql
