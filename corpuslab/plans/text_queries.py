"""Queries of sources, passages and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import BOOK_RULES, FEATURE_KEYWORDS, GIVEAWAY_TERMS, MASK_TERMS, MODERN_LEXICON, NEIGHBOUR_TERMS, OTHER_PAGES, PAGE_RULES, STRONG_TERMS
from ..functions import text as T
from ..operators import lexicon as X
from ..operators import passages as P
from ..operators import segments as S
from ..sources import io
from . import Registry
from .views import PASSAGES, SUBJECT_PASSAGES, passages, role_passages, roles, subject_passages, table

q = Registry()

#: Lexicons that occur in the driver's invented texts.
RARE = ("license", "released", "copyright", "apache", "public")
FREQUENT = ("tion", "ther", "ble", "und", "que", "ment")
WORDS = {"the": "certain", "and": "plus", "die": "jene", "les": "ces", "los": "unos"}
FAMILIES = (("article", r"\b(the|der|die|das|les|los)\b"), ("licence", r"\b(license|licence|mit)\b"), ("digits", r"\b[0-9]+\b"))
LEAKS = (r"\blicense\b", r"\bthe\b", r"\bund\b", r"\b[0-9]{3}\b")



def _marked(text: str) -> str:
    """SQL for the text with its words between two marks: RE2's word boundary is for ASCII only."""
    return f"regexp_replace({text}, '([\\p{{L}}\\p{{Nd}}_]+)', chr(1) || '\\1' || chr(2), 'g')"


def _subst(text: str, words: str, new: str, any_case: bool = True) -> str:
    """SQL that puts new in the place of whole words."""
    return f"translate(regexp_replace({_marked(text)}, chr(1) || '({'?i:' if any_case else ''}{words})' || chr(2), '{new}', 'g'), chr(1) || chr(2), '')"


def _found(text: str, words: str) -> str:
    return f"regexp_extract_all({_marked(text)}, chr(1) || '(?i:{words})' || chr(2))"


_arr = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_words = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"


@q(f"SELECT passage_id, tradition, work, {_words.format('text')}::BIGINT AS word_count FROM ({PASSAGES}) WHERE trim(text) <> ''")
def scan_passages(spark, d):
    out = P.normalize_passages(io.read_passages(spark, f"{d}/documents.parquet"), "text", "text")
    return out.select(F.col("doc_id").alias("passage_id"), F.col("lang").alias("tradition"), F.col("source").alias("work"), "word_count")


@q(f"SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN role = 'user' THEN text END), ''), nullif(trim(text), '')) AS effective_text, {_words.format('text')}::BIGINT AS word_count FROM conversations WHERE nullif(trim(text), '') IS NOT NULL")
def normalize_passages(spark, d):
    rows = table(spark, d, "conversations").withColumn("translation", F.when(F.col("role") == "user", F.col("text")))
    return P.normalize_passages(rows, "translation", "text").select("conv_id", "turn", "effective_text", "word_count")


@q(f"""
WITH r AS (SELECT passage_id, regexp_replace(text, '[.] ([A-Z])[a-z]*', ' | \\1 |' || chr(10), 'g') AS t FROM ({PASSAGES})),
x AS (SELECT passage_id, regexp_extract_all(t, '([^|\\n]+)[|] ([A-Z]) [|]', 1) AS b, regexp_extract_all(t, '([^|\\n]+)[|] ([A-Z]) [|]', 2) AS i FROM r),
e AS (SELECT passage_id, unnest(b) AS body, unnest(i) AS record_id, generate_subscripts(b, 1) AS n FROM x)
SELECT passage_id, record_id, trim(arg_max(body, n)) AS body FROM e GROUP BY ALL""")
def parse_records(spark, d):
    rows = passages(spark, d).withColumn("text", F.regexp_replace("text", "[.] ([A-Z])[a-z]*", " | $1 |\n"))
    # a body begins where its run begins: sought from each place within the run, a text without records took the square of its length
    return S.parse_records(rows, r"(?<![^|\n])([^|\n]++)[|] ([A-Z]) [|]")


@q(r"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s ]+', ' ', 'g')) AS plain FROM s""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("plain"))


@q(f"""
WITH known AS (SELECT DISTINCT doc_id AS passage_id FROM labels)
SELECT passage_id, work, CASE WHEN passage_id IN (SELECT passage_id FROM known) THEN 'refused' ELSE 'admitted' END AS verdict FROM ({PASSAGES})""")
def registry_admit(spark, d):
    new, refused = io.registry_admit(roles(spark, d), passages(spark, d).select("passage_id", "work"), "passage_id")
    return new.withColumn("verdict", F.lit("admitted")).unionByName(refused.withColumn("verdict", F.lit("refused")))


@q(f"""
SELECT count(*) AS n, count(DISTINCT tradition) AS n_traditions, count(DISTINCT work) AS n_works, count(*) FILTER (trim(text) = '') AS n_blank,
       count(DISTINCT passage_id) = count(*) AS ok FROM ({PASSAGES})""")
def corpus_profile(spark, d):
    return passages(spark, d).agg(
        F.count("*").alias("n"), F.countDistinct("tradition").alias("n_traditions"), F.countDistinct("work").alias("n_works"),
        F.count_if(F.trim("text") == "").alias("n_blank"), (F.countDistinct("passage_id") == F.count("*")).alias("ok"),
    )


@q("SELECT count(*) AS n_rows, sum(('0x' || substr(sha256(concat_ws(chr(31), doc_id::VARCHAR, lang, source, text)), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM documents")
def table_fingerprint(spark, d):
    return io.table_fingerprint(table(spark, d, "documents"), ["doc_id", "lang", "source", "text"])


_strip = "trim(array_to_string(list_filter(string_split({}, chr(10)), lambda l: NOT ({})), chr(10)))"
_starts = lambda marks: " OR ".join(f"starts_with(lower(trim(l)), '{m}')" for m in marks)


@q(f"""
SELECT 'PASSAGE_' || substr(sha256('pepper:' || passage_id), 1, 10) AS anonymous_id, passage_id, {_words.format('s')}::BIGINT AS word_count, sha256(s) AS text_hash
FROM (SELECT passage_id, {_strip.format('text', _starts(("commentary:", "editor:", "note:")))} AS s FROM ({PASSAGES}))""")
def blind_passages(spark, d):
    work, mapping = P.blind_passages(passages(spark, d), "pepper")
    return work.join(mapping, "anonymous_id").select("anonymous_id", "passage_id", "word_count", F.sha2("text", 256).alias("text_hash"))


@q(f"SELECT passage_id, {_strip.format('t', _starts(('note:', 'the', 'released')))} AS stripped FROM (SELECT passage_id, text AS t FROM ({PASSAGES}))")
def strip_editorial(spark, d):
    return passages(spark, d).select("passage_id", T.drop_lines(F.col("text"), ("note:", "the", "released")).alias("stripped"))


_leak = lambda p: f"CASE WHEN len({_found('text', p[2:-2])}) > 0 THEN '{p}' END"


@q(f"SELECT passage_id, list_filter([{', '.join(map(_leak, LEAKS))}], lambda p: p IS NOT NULL) AS leaks FROM ({PASSAGES})")
def detect_leaks(spark, d):
    return P.detect_leaks(passages(spark, d), LEAKS).select("passage_id", "leaks")


def _scrub_sql() -> str:
    text, ctes, counts = "text", [], []
    for i, (_, p) in enumerate(FAMILIES):
        p = p.replace("\\b", "")
        ctes.append(f"s{i} AS (SELECT *, len({_found(f't{i}', p)}) AS n{i}, {_subst(f't{i}', p, '[SCRUBBED]')} AS t{i + 1} FROM {'s' + str(i - 1) if i else 'base'})")
        counts.append(f"n{i}")
    k = len(FAMILIES)
    marks = _starts(("commentary:", "editor:", "note:", "translator:"))
    names = ", ".join(f"CASE WHEN n{i} > 0 THEN '{n}' END" for i, (n, _) in enumerate(FAMILIES))
    return f"""WITH base AS (SELECT passage_id, text AS t0 FROM ({PASSAGES})), {", ".join(ctes)},
l AS (SELECT *, len(list_filter(string_split(t{k}, chr(10)), lambda l: {marks})) AS nl FROM s{k - 1})
SELECT passage_id, sha256({_strip.format(f"t{k}", marks)}) AS scrubbed_hash, ({" + ".join(counts)} + nl)::BIGINT AS n_replacements,
       list_sort(list_filter([{names}, CASE WHEN nl > 0 THEN 'editorial_line' END], lambda x: x IS NOT NULL)) AS families_hit FROM l"""


@q(_scrub_sql())
def scrub_text(spark, d):
    return P.scrub_text(passages(spark, d), FAMILIES).select("passage_id", F.sha2("scrubbed", 256).alias("scrubbed_hash"), "n_replacements", "families_hit")


_ALT = T.alternation(list(WORDS), bounded=False)[1:-1]


@q(f"SELECT passage_id, sha256({_subst('text', _ALT, '[MASKED]')}) AS masked_hash, len({_found('text', _ALT)})::BIGINT AS n_edits FROM ({PASSAGES})")
def mask_vocab(spark, d):
    text = F.col("text")
    return passages(spark, d).select("passage_id", F.sha2(T.mask(text, list(WORDS)), 256).alias("masked_hash"), F.size(T.mask_edits(text, list(WORDS))).cast("long").alias("n_edits"))


def _neutral_sql(t: str = "text") -> str:
    for term in sorted(WORDS, key=lambda x: (-len(x), x)):
        t = _subst(_subst(t, term.capitalize(), WORDS[term].capitalize(), False), term, WORDS[term])
    return t


@q(f"SELECT passage_id, sha256({_neutral_sql()}) AS neutral_hash FROM ({PASSAGES})")
def neutralize_vocab(spark, d):
    return passages(spark, d).select("passage_id", F.sha2(T.neutralize(F.col("text"), WORDS), 256).alias("neutral_hash"))


@q(f"""SELECT passage_id, 'original' AS variant, sha256(text) AS h FROM ({PASSAGES})
UNION ALL SELECT passage_id, 'masked', sha256({_subst('text', _ALT, '[MASKED]')}) FROM ({PASSAGES})
UNION ALL SELECT passage_id, 'neutralized', sha256({_neutral_sql()}) FROM ({PASSAGES})""")
def text_variants(spark, d):
    return P.text_variants(passages(spark, d), WORDS).select("passage_id", "variant", F.sha2("variant_text", 256).alias("h"))


@q(f"SELECT passage_id, sha256(regexp_replace(text, '(?i)({'|'.join(sorted(FREQUENT, key=lambda t: (-len(t), t)))})', '[MASK]', 'g')) AS masked_hash FROM ({PASSAGES})")
def mask_giveaway(spark, d):
    return passages(spark, d).select("passage_id", F.sha2(T.mask(F.col("text"), FREQUENT, "[MASK]", bounded=False), 256).alias("masked_hash"))


@q(f"""
WITH h AS (SELECT *, list_filter({_arr(RARE)}, lambda t: contains(lower(text), t)) AS strong, list_filter({_arr(FREQUENT)}, lambda t: contains(lower(text), t)) AS soft FROM ({PASSAGES}))
SELECT passage_id, strong, soft, len(strong)::BIGINT AS n_strong, len(soft)::BIGINT AS n_soft, len(strong) > 0 AS contaminated, replace(substr(text, 1, 280), chr(10), ' ') AS excerpt FROM h""")
def anachronism_rows(spark, d):
    return P.anachronism_rows(passages(spark, d), RARE, FREQUENT).select("passage_id", "strong", "soft", "n_strong", "n_soft", "contaminated", "excerpt")


@q(f"""
WITH t AS (SELECT unnest({_arr(RARE + FREQUENT)}) AS term)
SELECT passage_id, term, ((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term))::BIGINT AS mentions FROM ({PASSAGES}), t WHERE contains(lower(text), term)""")
def lexicon_hits(spark, d):
    return X.term_mentions(passages(spark, d), RARE + FREQUENT)


@q(f"SELECT passage_id, round(({' + '.join(f'''(len({_found('text', w)}) > 0)::INT''' for w in WORDS)}) / greatest({_words.format('text')}, 1), 6) AS density FROM ({PASSAGES})")
def modernization_density(spark, d):
    return X.whole_word_density(passages(spark, d), list(WORDS)).withColumn("density", F.round("density", 6))


@q(f"""
WITH c AS (SELECT source AS work, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS langs, max(coalesce(quality, 0)) AS q FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
r AS (SELECT *, CASE WHEN n < 10 THEN 'too_small' WHEN chars < 100000 THEN 'too_short' WHEN langs < 2 THEN 'one_language' WHEN q = 0 THEN 'no_quality' END AS reason FROM c)
SELECT work, n, chars, reason, CASE WHEN reason IS NULL THEN 'eligible' ELSE 'ineligible' END AS status FROM r""")
def source_eligibility(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    works = docs.groupBy(F.col("source").alias("work")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"), F.max(F.coalesce("quality", F.lit(0))).alias("q"))
    rules = [("too_small", F.col("n") < 10), ("too_short", F.col("chars") < 100000), ("one_language", F.col("langs") < 2), ("no_quality", F.col("q") == 0)]
    return P.source_eligibility(works, rules).select("work", "n", "chars", "reason", "status")


@q(f"""
WITH v(label, term) AS (VALUES ('en', 'tion'), ('en', 'ther'), ('de', 'und'), ('de', 'sch'), ('fr', 'que'), ('fr', 'eau'), ('es', 'ción'), ('es', 'los'))
SELECT passage_id, tradition, count(DISTINCT label) FILTER (contains(lower(text), term) AND label <> tradition) > 0 AS hard_negative FROM ({PASSAGES}), v GROUP BY ALL""")
def hard_negative_flag(spark, d):
    terms = {"en": ("tion", "ther"), "de": ("und", "sch"), "fr": ("que", "eau"), "es": ("ción", "los")}
    others = [(own, [t for other, ts in terms.items() if other != own for t in ts]) for own in terms]
    return X.neighbour_flag(passages(spark, d), "tradition", others)


RULES = (("licence", ("license", "copyright")), ("german", (" der ", " und ")), ("french", (" une ", " les ")), ("english", (" the ", " and ")))


@q(f"SELECT passage_id, CASE {' '.join('WHEN ' + ' OR '.join(f'''contains(lower(text), '{k}')''' for k in keys) + f''' THEN '{label}' ''' for label, keys in RULES)} ELSE 'other' END AS label FROM ({PASSAGES})")
def rule_label(spark, d):
    return passages(spark, d).select("passage_id", P.first_matching(F.col("text"), RULES, "other").alias("label"))


@q(f"""
WITH k(feature_id, keyword) AS (VALUES ('K1', 'license'), ('K1', 'copyright'), ('K2', 'tion'), ('K3', 'und'), ('K3', 'sch'), ('K4', 'eau'))
SELECT passage_id, feature_id, max(contains(lower(text), keyword)::INT) AS value FROM ({PASSAGES}), k GROUP BY ALL""")
def keyword_features(spark, d):
    return X.keyword_features(passages(spark, d), (("K1", ("license", "copyright")), ("K2", ("tion",)), ("K3", ("und", "sch")), ("K4", ("eau",))))


# The packaged lexicons, over texts that hold their words.

_SP = f"sp AS ({SUBJECT_PASSAGES})"
_pairs = lambda table: ", ".join(f"('{name}', '{k}')" for name, ks in table for k in ks)
_has_word = lambda w: f"(len({_found('text', w)}) > 0)::INT"
#: A class for each passage, by its source.
_CLASS = [(f"src{i}", name) for i, (name, _) in enumerate(NEIGHBOUR_TERMS)]


@q(f"WITH {_SP}, t AS (SELECT unnest({_arr(MODERN_LEXICON)}) AS term) SELECT passage_id, term, ((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term))::BIGINT AS mentions FROM sp, t WHERE contains(lower(text), term)")
def modern_lexicon_hits(spark, d):
    return X.term_mentions(subject_passages(spark, d), MODERN_LEXICON)


@q(f"WITH {_SP} SELECT passage_id, round(({' + '.join(map(_has_word, MASK_TERMS))}) / greatest({_words.format('text')}, 1), 6) AS density FROM sp")
def mask_term_density(spark, d):
    return X.whole_word_density(subject_passages(spark, d), MASK_TERMS).withColumn("density", F.round("density", 6))


@q(f"WITH {_SP}, k(feature_id, keyword) AS (VALUES {_pairs(FEATURE_KEYWORDS)}) SELECT passage_id, feature_id, coalesce(max(contains(lower(text), keyword)::INT), 0) AS value FROM sp, k GROUP BY ALL")
def feature_proxy(spark, d):
    return X.keyword_features(subject_passages(spark, d), FEATURE_KEYWORDS)


@q(f"""WITH {_SP}, c(work, label) AS (VALUES {', '.join(map(str, _CLASS))}), k(label, term) AS (VALUES {_pairs(NEIGHBOUR_TERMS)})
SELECT passage_id, c.label, coalesce(bool_or(contains(lower(text), term)), false) AS hard_negative FROM sp LEFT JOIN c USING (work) LEFT JOIN k ON k.label = c.label GROUP BY ALL""")
def neighbour_flags(spark, d):
    label = F.coalesce(*[F.when(F.col("work") == w, F.lit(name)) for w, name in _CLASS])
    return X.neighbour_flag(subject_passages(spark, d).withColumn("label", label), "label", NEIGHBOUR_TERMS)


_in_page = lambda k: f"starts_with(page, '{k[1:]}')" if k[0] == "^" else f"contains(page, '{k}')"
_page_case = " ".join(f"WHEN {' OR '.join(map(_in_page, ks))} THEN '{name}'" for name, ks in PAGE_RULES)
_book_case = " ".join(f"WHEN contains(book, '{ks[0]}') THEN '{name}'" for name, ks in BOOK_RULES)
_HINT, _BOOK = "CASE passage_id % 5 WHEN 0 THEN 'relativity' WHEN 1 THEN 'unknown' END", "concat('volume-', passage_id % 4)"


@q(f"""WITH {_SP}, pg AS (SELECT passage_id, lower(CASE WHEN passage_id % 11 = 0 THEN '11-' ELSE '' END || replace(substr(text, 1, 300), ' ', '-')) AS page, {_HINT} AS hint, {_BOOK} AS book FROM sp)
SELECT passage_id, CASE {_page_case} WHEN hint IN {tuple(dict(PAGE_RULES))} THEN hint {_book_case} ELSE '{OTHER_PAGES}' END AS label FROM pg""")
def page_classes(spark, d):
    # a page's name is made of a text's first words
    page = F.concat(F.when(F.col("passage_id") % 11 == 0, "11-").otherwise(""), F.replace(F.substring("text", 1, 300), F.lit(" "), F.lit("-")))
    return subject_passages(spark, d).select("passage_id", X.page_class(page, F.expr(_HINT), F.expr(_BOOK), PAGE_RULES, BOOK_RULES, OTHER_PAGES).alias("label"))


_any = sorted({*STRONG_TERMS, *MODERN_LEXICON}, key=lambda t: (-len(t), t))


@q(f"""WITH {_SP} SELECT passage_id, sha256({_subst('text', '|'.join(MASK_TERMS), '[MASK]')}) AS terms_hash, sha256({_subst('text', '|'.join(GIVEAWAY_TERMS), '[MASKED]')}) AS giveaway_hash,
sha256(regexp_replace(text, '(?i)({'|'.join(_any)})', '[MASKED]', 'g')) AS lexicon_hash FROM sp""")
def packaged_masks(spark, d):
    text = F.col("text")
    masks = {"terms_hash": T.mask(text, MASK_TERMS, "[MASK]"), "giveaway_hash": T.mask(text, GIVEAWAY_TERMS), "lexicon_hash": T.mask(text, _any, bounded=False)}
    return subject_passages(spark, d).select("passage_id", *[F.sha2(c, 256).alias(k) for k, c in masks.items()])


@q(f"""
WITH p AS (SELECT passage_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM ({PASSAGES}))
SELECT passage_id, array_to_string(list_filter(ps, lambda x: regexp_matches(x, '^(The|Die|Le|La|El)[a-z]*')), chr(10)) AS commentary,
       array_to_string(list_filter(ps, lambda x: NOT regexp_matches(x, '^(The|Die|Le|La|El)[a-z]*')), chr(10)) AS verse FROM p""")
def commentary_split(spark, d):
    return P.commentary_split(passages(spark, d), "^(The|Die|Le|La|El)[a-z]*").select("passage_id", "commentary", "verse")


_SENT = "list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda s: trim(s) <> '')"


@q(f"""
WITH s AS (SELECT passage_id, text, {_SENT} AS ss FROM ({PASSAGES})),
e AS (SELECT passage_id, CASE WHEN len(list_filter(ss, lambda s: NOT ends_with(s, '?'))) = 0 THEN [trim(text)] ELSE ss END AS xs, len(list_filter(ss, lambda s: NOT ends_with(s, '?'))) = 0 AS whole FROM s),
u AS (SELECT passage_id, whole, unnest(xs) AS sentence, generate_subscripts(xs, 1) AS n FROM e)
SELECT passage_id, passage_id || '::P' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS proposition_id, sentence, CASE WHEN whole THEN 0.5 WHEN {_words.format('sentence')} >= 5 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence
FROM u WHERE (whole OR NOT ends_with(sentence, '?')) AND sentence <> ''""")
def propositions(spark, d):
    return S.propositions(passages(spark, d))


@q(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?is)^.*?<body[^\n]*\n', ''), '(?is)</body.*$', '')) AS body FROM pages")
def strip_boilerplate(spark, d):
    return table(spark, d, "pages").select("page_id", S.strip_boilerplate(F.col("html"), "<body", "</body").alias("body"))


@q(f"""
WITH e AS (SELECT passage_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM ({PASSAGES})),
c AS (SELECT passage_id, n, trim(regexp_replace(p, '\\s+', ' ', 'g')) AS paragraph FROM e)
SELECT passage_id, n::INT AS n, paragraph, {_words.format('paragraph')}::BIGINT AS n_words FROM c WHERE {_words.format('paragraph')} >= 40 AND NOT regexp_matches(paragraph, '^[0-9ivxlc]+$')""")
def paragraphs(spark, d):
    return S.paragraphs(passages(spark, d), 40, r"\n")


def _packs_sql(close_at: int, keep_tail: int, longer_than: int = 0, noise: tuple = (), most_words: int = 1 << 30) -> str:
    """The fold over sentences as a recursion: sentence i joins the open pack, which closes at close_at words."""
    clean = "".join(f" AND NOT contains(lower(s), '{x}')" for x in noise)
    return f"""
WITH RECURSIVE se AS (SELECT passage_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: length(s) > {longer_than}{clean}) AS ss FROM ({PASSAGES})),
c AS (SELECT passage_id, ss, list_transform(ss, lambda s: {_words.format('s')}) AS ws FROM se),
f AS (SELECT passage_id, ws, 0::BIGINT AS i, 0::BIGINT AS words, 0::BIGINT AS open, 0::BIGINT AS own FROM c
  UNION ALL SELECT passage_id, ws, i + 1, CASE WHEN words + ws[i + 1] >= {close_at} THEN 0 ELSE words + ws[i + 1] END, CASE WHEN words + ws[i + 1] >= {close_at} THEN open + 1 ELSE open END, open FROM f WHERE i < len(ws)),
g AS (SELECT passage_id, own, string_agg(ss[i], ' ' ORDER BY i) AS pack, sum(f.ws[i]) AS words FROM f JOIN c USING (passage_id) WHERE i > 0 GROUP BY passage_id, own)
SELECT passage_id, (row_number() OVER (PARTITION BY passage_id ORDER BY own) - 1)::INT AS n, pack FROM g WHERE (words >= {close_at} OR words >= {keep_tail}) AND words <= {most_words}"""


@q(_packs_sql(60, 40))
def pack_sentences(spark, d):
    return S.pack_sentences(passages(spark, d), 60, 40)


@q(_packs_sql(60, 60, 40, S.NOISE, 220))
def carve_sentences(spark, d):
    return S.pack_sentences(passages(spark, d), 60, 60, longer_than=40, noise=S.NOISE, most_words=220)


@q(f"""
WITH w AS (SELECT passage_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM ({PASSAGES})),
s AS (SELECT passage_id, ws, unnest(CASE WHEN len(ws) <= 120 THEN [0] ELSE range(0, len(ws) - 40 + 1, 100) END) AS start FROM w WHERE len(ws) >= 40)
SELECT passage_id, start::INT AS start, array_to_string(ws[start + 1 : start + 120], ' ') AS "window" FROM s""")
def word_windows(spark, d):
    return S.word_windows(passages(spark, d), 120, 100, 40)


@q("""
WITH a AS (SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT doc_id, lang, NULL::INT AS quality FROM documents WHERE source = 'src1')
SELECT lang, count(*) AS n, count(quality) AS labelled FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY lang""")
def corpus_union(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    both = docs.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality").unionByName(docs.filter("source = 'src1'").select("doc_id", "lang"), allowMissingColumns=True)
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"))


@q(f"SELECT passage_id, work, role FROM ({PASSAGES}) JOIN (SELECT doc_id AS passage_id, CASE WHEN quality = 1 THEN 'target' ELSE 'control' END AS role FROM labels) USING (passage_id) WHERE role = 'control'")
def control_passages(spark, d):
    return role_passages(spark, d).filter("role = 'control'").select("passage_id", "work", "role")


QUERIES, ORACLE_SQL = q.queries, q.sql
