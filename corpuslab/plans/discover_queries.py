"""Queries of graphs, discovery and learning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import FEATURE_GRAPH
from ..operators import annotate as A
from ..operators import blocks as B
from ..operators import discover as D
from ..operators import graph as G
from ..operators import learn as L
from ..operators import linear as Ln
from ..operators import select as Sel
from ..operators import setjoin as J
from ..operators import stats as I
from ..sources.scratch import written
from . import Registry
from .audit_queries import SPLIT, _d, _split
from .score_queries import ANN, FEATURES, FP, SCORES, TOKENS, _r, annotations, fingerprints, scores, tfidf_sql, values
from .views import PASSAGES, ROLES, passages, role_passages, roles, table

q = Registry()

_MAP_N = "gn(feature_id, node_type) AS (VALUES " + ", ".join(f"('{f}', '{n}')" for f in FEATURES for n in dict.fromkeys(FEATURE_GRAPH[f][0])) + ")"
_MAP_E = "ge(feature_id, source, edge_type, target) AS (VALUES " + ", ".join(f"('{f}', '{e[0]}', '{e[1]}', '{e[2]}')" for f in FEATURES if (e := FEATURE_GRAPH[f][1])) + ")"
GRAPH = f"""{ANN}, {_MAP_N}, {_MAP_E}, pos AS (SELECT * FROM ann WHERE label = '1' AND trim(evidence) <> ''),
nodes AS (SELECT passage_id, node_type, feature_id, evidence FROM pos JOIN gn USING (feature_id)), edges AS (SELECT passage_id, source, edge_type, target, feature_id FROM pos JOIN ge USING (feature_id)),
sg AS (SELECT passage_id, list_sort(list(DISTINCT x)) AS signature FROM (SELECT passage_id, 'N:' || node_type AS x FROM nodes UNION ALL SELECT passage_id, 'E:' || edge_type FROM edges) GROUP BY passage_id)"""


def _pos(spark, d):
    return annotations(spark, d).filter("label = '1'").select("passage_id", "tradition", "work", "feature_id", "evidence")


def _sig(spark, d):
    return G.feature_signatures(_pos(spark, d))


@q(f"WITH {GRAPH} SELECT passage_id, node_type, list_sort(list(feature_id)) AS features, substr(string_agg(evidence, ' | ' ORDER BY feature_id), 1, 500) AS evidence FROM nodes GROUP BY ALL")
def graph_nodes(spark, d):
    return G.feature_nodes(_pos(spark, d))


@q(f"WITH {GRAPH} SELECT passage_id, (row_number() OVER (PARTITION BY passage_id ORDER BY feature_id) - 1)::INT AS edge_no, source, edge_type, target, feature_id FROM edges")
def graph_edges(spark, d):
    return G.feature_edges(_pos(spark, d))


@q(f"WITH {GRAPH} SELECT * FROM sg")
def graph_signature(spark, d):
    return _sig(spark, d)


#: Families and phrases that occur in the driver's invented texts.
FAMILIES = (("article", "entity", r"\b(the|der|die|les|los)\b"), ("joiner", "process", r"\b(and|und|que)\b"), ("licence", "property", r"\b(license|released|mit)\b"))
PHRASES = ((r"\s+and\s+", "INTERACTS_WITH", 0.85), (r"\s+of\s+", "COMPOSED_OF", 0.8), (r"\s+und\s+", "INTERACTS_WITH", 0.85))
_SENTS = f"ss AS (SELECT passage_id, unnest(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda s: trim(s)), lambda s: length(s) > 5)) AS s FROM ({PASSAGES}))"
_mk = "regexp_replace(s, '([\\p{L}\\p{Nd}_]+)', chr(1) || '\\1' || chr(2), 'g')"


def _ents_sql() -> str:
    one = " UNION ALL ".join(f"SELECT passage_id, '{r}' AS role, '{k}' AS kind, unnest(regexp_extract_all({_mk}, chr(1) || '(?i:({p[3:-3]}))' || chr(2), 1)) AS w FROM ss" for r, k, p in FAMILIES)
    return f"{_SENTS}, er AS ({one}), ents AS (SELECT passage_id, 'n_' || substr(sha1(role || ':' || lower(w)), 1, 10) AS node_id, role, kind, lower(w) AS surface, count(*) AS mentions FROM er GROUP BY ALL)"


@q(f"WITH {_ents_sql()} SELECT * FROM ents")
def extract_entities(spark, d):
    return G.extract_entities(passages(spark, d), FAMILIES)


def _rels_sql() -> str:
    word = "([A-Za-z][\\w\\-]*)"
    role = lambda w: "CASE " + " ".join(f"WHEN regexp_matches({w}, '^({p[3:-3]})$') THEN '{r}'" for r, _, p in FAMILIES) + " ELSE 'entity' END"
    one = " UNION ALL ".join(f"SELECT passage_id, '{k}' AS relation, {c}::DOUBLE AS confidence, unnest(regexp_extract_all(s, '(?i){word}{p}{word}', 1)) AS a, unnest(regexp_extract_all(s, '(?i){word}{p}{word}', 2)) AS b FROM ss" for p, k, c in PHRASES)
    return f"""{_SENTS}, rr AS ({one}), rels AS (SELECT passage_id, relation, confidence, lower(a) AS source_word, lower(b) AS target_word,
'n_' || substr(sha1({role('lower(a)')} || ':' || lower(a)), 1, 10) AS source, 'n_' || substr(sha1({role('lower(b)')} || ':' || lower(b)), 1, 10) AS target FROM rr)"""


@q(f"WITH {_rels_sql()} SELECT passage_id, relation, source, target, source_word, target_word, confidence, count(*) AS n FROM rels WHERE source <> target GROUP BY ALL")
def extract_relations(spark, d):
    out = G.extract_relations(passages(spark, d), PHRASES, FAMILIES)
    return out.groupBy("passage_id", "relation", "source", "target", "source_word", "target_word", "confidence").agg(F.count("*").alias("n"))


# Graphs of orders: suppliers and parts as nodes, lines as edges; the first ten orders are the templates.

def _gn(graph):
    return f"""gn AS (SELECT DISTINCT {graph} AS graph_id, 's' || l_suppkey % 50 AS id, 'supplier' AS kind FROM lineitem WHERE l_suppkey % 50 <> 0 UNION SELECT DISTINCT {graph}, 'p' || l_partkey % 40, 'part' || l_partkey % 3 FROM lineitem),
nd AS (SELECT graph_id, id, min(kind) AS kind FROM gn GROUP BY ALL),
ed AS (SELECT DISTINCT {graph} AS graph_id, 's' || l_suppkey % 50 AS source, 'p' || l_partkey % 40 AS target, l_returnflag AS kind FROM lineitem)"""


_GN = _gn("l_orderkey")


def _order_graphs(spark, d, graph="l_orderkey"):
    s, p = F.concat(F.lit("s"), (F.col("l_suppkey") % 50).cast("string")), F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string"))
    part = F.concat(F.lit("part"), (F.col("l_partkey") % 3).cast("string"))
    li = table(spark, d, "lineitem").select(F.expr(graph).alias("graph_id"), s.alias("source"), p.alias("target"), F.col("l_returnflag").alias("kind"), (F.col("l_suppkey") % 50 != 0).alias("known"), part.alias("part"))
    if graph == "l_orderkey":
        li = li.repartition("graph_id")  # small graphs: dealt once, all that follows is by graph; 35 large ones are not
    ends = F.explode(F.array(F.when(F.col("known"), F.struct(F.col("source").alias("id"), F.lit("supplier").alias("kind"))), F.struct(F.col("target").alias("id"), F.col("part").alias("kind")))).alias("x")
    nodes = li.select("graph_id", ends).filter("x IS NOT NULL").groupBy("graph_id", "x.id").agg(F.min("x.kind").alias("kind"))
    edges = li.select("graph_id", "source", "target", "kind").distinct()
    return nodes, edges


MODES = ("A", "N")


@q(f"""SELECT e.graph_id, e.source, e.target, CASE WHEN e.kind IN {MODES} THEN e.kind ELSE 'OTHER' END AS kind
FROM (SELECT DISTINCT l_orderkey AS graph_id, 's' || l_suppkey % 50 AS source, 'p' || l_partkey % 40 AS target, l_returnflag AS kind FROM lineitem) e
JOIN (SELECT DISTINCT l_orderkey AS graph_id, 's' || l_suppkey % 50 AS id FROM lineitem WHERE l_suppkey % 50 <> 0) a ON a.graph_id = e.graph_id AND a.id = e.source
JOIN (SELECT DISTINCT l_orderkey AS graph_id, 'p' || l_partkey % 40 AS id FROM lineitem) b ON b.graph_id = e.graph_id AND b.id = e.target""")
def valid_edges(spark, d):
    nodes, edges = _order_graphs(spark, d)
    return G.valid_edges(edges, nodes, MODES, "OTHER").select("graph_id", "source", "target", "kind")


_GONE = "l.id = 'p39'"  # one part is no node either, so that targets are missing too


@q(f"""WITH {_GN}, l AS (SELECT * FROM nd l WHERE NOT ({_GONE})) SELECT ed.*, 'source' AS missing FROM ed ANTI JOIN l ON l.graph_id = ed.graph_id AND l.id = source
UNION ALL SELECT ed.*, 'target' FROM ed ANTI JOIN l ON l.graph_id = ed.graph_id AND l.id = target""")
def dangling_edges(spark, d):
    nodes, edges = _order_graphs(spark, d)
    return G.dangling_edges(edges, nodes.alias("l").filter(f"NOT ({_GONE})"))


_MS = """ms AS (SELECT ed.graph_id, coalesce(a.kind, 'UNKNOWN') AS src_kind, ed.kind, coalesce(b.kind, 'UNKNOWN') AS dst_kind, count(*) AS n
FROM ed LEFT JOIN nd a ON a.graph_id = ed.graph_id AND a.id = source LEFT JOIN nd b ON b.graph_id = ed.graph_id AND b.id = target GROUP BY ALL)"""


@q(f"WITH {_GN}, {_MS} SELECT * FROM ms")
def typed_multiset(spark, d):
    nodes, edges = _order_graphs(spark, d)
    return G.typed_multiset(edges, nodes)


#: The graphs that all others are compared with: templates are a table, and this is its filter.
TEMPLATES = 20


def _sizes(nodes, edges):
    return nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes")).join(edges.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id")


def _typed(spark, d):
    nodes, edges = _order_graphs(spark, d)
    m, s = G.typed_multiset_small(edges, nodes), _sizes(nodes, edges)
    small = f"graph_id <= {TEMPLATES}"
    return G.typed_similarity(m, m.filter(small), s, s.filter(small))


_TY = f"""{_GN}, {_MS}, sz AS (SELECT graph_id, (SELECT count(*) FROM nd WHERE nd.graph_id = e.graph_id) AS n_nodes, count(*) AS n_edges FROM ed e GROUP BY graph_id),
it AS (SELECT x.graph_id AS a, y.graph_id AS b, sum(least(x.n, y.n)) AS i FROM ms x JOIN ms y USING (src_kind, kind, dst_kind) WHERE y.graph_id <= {TEMPLATES} GROUP BY ALL),
ty AS (SELECT x.graph_id AS a, y.graph_id AS b, coalesce(coalesce(i, 0) / nullif(x.n_edges + y.n_edges - coalesce(i, 0), 0), 1) AS raw, x.n_nodes AS an, y.n_nodes AS bn, x.n_edges AS ae, y.n_edges AS be FROM sz x JOIN sz y ON y.graph_id <= {TEMPLATES} LEFT JOIN it ON it.a = x.graph_id AND it.b = y.graph_id),
ta AS (SELECT a, b, raw, raw * (least(an, bn) / greatest(an, bn)) * (least(ae, be) / greatest(ae, be)) AS adjusted FROM ty)"""


@q(f"WITH {_TY} SELECT a, b, round(raw, 6) AS raw, round(adjusted, 6) AS adjusted FROM ta")
def typed_similarity(spark, d):
    return _r(_typed(spark, d), "raw", "adjusted")


#: A graph for each kind of shipment, from all lines: the full matrix of their pairs.
_SHIP = "l_partkey % 7 * 5 + l_suppkey % 5"


@q(f"""WITH {_gn(_SHIP)}, {_MS}, sz AS (SELECT graph_id, count(*) AS n_edges FROM ed GROUP BY graph_id),
it AS (SELECT x.graph_id AS a, y.graph_id AS b, sum(least(x.n, y.n)) AS i FROM ms x JOIN ms y USING (src_kind, kind, dst_kind) GROUP BY ALL)
SELECT x.graph_id AS a, y.graph_id AS b, round(coalesce(coalesce(i, 0) / nullif(x.n_edges + y.n_edges - coalesce(i, 0), 0), 1), 6) AS raw FROM sz x CROSS JOIN sz y LEFT JOIN it ON it.a = x.graph_id AND it.b = y.graph_id""")
def graph_pair_matrix(spark, d):
    nodes, edges = _order_graphs(spark, d, _SHIP)
    m, s = G.typed_multiset(edges, nodes), _sizes(nodes, edges)
    return _r(G.typed_similarity(m, m, s, s).select("a", "b", "raw"), "raw")


def _profiles(spark, d, most):
    p = written(G.node_profiles(*_order_graphs(spark, d)))
    return p, p.filter(f"graph_id <= {most}")


@q(f"""WITH {_GN}, h AS (SELECT graph_id, id, k, count(*) AS n FROM (SELECT graph_id, source AS id, '>' || kind AS k FROM ed UNION ALL SELECT graph_id, target, '<' || kind FROM ed) GROUP BY ALL),
t AS (SELECT graph_id, id, sum(n) AS t FROM h GROUP BY ALL),
pr AS (SELECT x.graph_id AS a, x.id AS a_id, y.graph_id AS b, y.id AS b_id, (x.kind <> y.kind)::INT AS pen FROM nd x, nd y WHERE y.graph_id <= 2),
l AS (SELECT a, a_id, b, b_id, sum(abs(xn - yn)) AS l1 FROM (SELECT a, a_id, b, b_id, k, sum(xn) AS xn, sum(yn) AS yn FROM (
  SELECT a, a_id, b, b_id, k, n AS xn, 0 AS yn FROM pr JOIN h ON h.graph_id = a AND h.id = a_id UNION ALL SELECT a, a_id, b, b_id, k, 0, n FROM pr JOIN h ON h.graph_id = b AND h.id = b_id) GROUP BY ALL) GROUP BY ALL)
SELECT pr.a, pr.a_id, pr.b, pr.b_id, round(pen + coalesce(l1, 0) / (2.0 * greatest(1, coalesce(tx.t, 0) + coalesce(ty.t, 0))), 6)::DOUBLE AS distance FROM pr LEFT JOIN l USING (a, a_id, b, b_id)
LEFT JOIN t tx ON tx.graph_id = pr.a AND tx.id = pr.a_id LEFT JOIN t ty ON ty.graph_id = pr.b AND ty.id = pr.b_id""")
def node_distance(spark, d):
    return _r(G.node_distances(*_profiles(spark, d, 2)), "distance")


@q()
def graph_alignment(spark, d):
    return _r(G.profile_alignment(*_profiles(spark, d, 4)), "alignment")


@q()
def graph_retrieval(spark, d):
    typed = _typed(spark, d).filter("b <= 4")
    s = G.retrieval_scores(typed, G.profile_alignment(*_profiles(spark, d, 4)), 0.25, 0.75)
    truth = s.select(F.col("a").alias("query"), (F.col("a") % 4 + 1).alias("truth")).distinct()
    return _r(L.retrieval_metrics(s.select(F.col("a").alias("query"), F.col("b").alias("item"), F.round("score", 9).alias("score")), truth), "mrr", "top1", "top2", "margin")


@q(f"""WITH {_GN}, g AS (SELECT graph_id, (SELECT list(DISTINCT source || kind || target) FROM ed e WHERE e.graph_id = x.graph_id) AS e, (SELECT list(DISTINCT kind || id) FROM nd n WHERE n.graph_id = x.graph_id) AS n FROM (SELECT DISTINCT graph_id FROM ed) x)
SELECT x.graph_id AS a, y.graph_id AS b, round(0.7 * coalesce(len(list_intersect(x.e, y.e)) / nullif(len(list_distinct(x.e || y.e)), 0), 0) + 0.3 * coalesce(len(list_intersect(x.n, y.n)) / nullif(len(list_distinct(x.n || y.n)), 0), 0), 6)::DOUBLE AS score FROM g x, g y WHERE y.graph_id <= {TEMPLATES}""")
def graph_overlap(spark, d):
    nodes, edges = _order_graphs(spark, d)
    g = edges.groupBy("graph_id").agg(F.collect_set(F.concat("source", "kind", "target")).alias("edges")).join(nodes.groupBy("graph_id").agg(F.collect_set(F.concat("kind", "id")).alias("nodes")), "graph_id")
    return _r(G.overlap(g, g.filter(f"graph_id <= {TEMPLATES}")), "score")


# All order graphs with each other: graphs of equal relations and sizes are one class, whose least graph stands for it.

_CL = f"""{_GN}, {_MS}, sz AS (SELECT graph_id, n_nodes, n_edges FROM (SELECT graph_id, count(*) AS n_nodes FROM nd GROUP BY ALL) JOIN (SELECT graph_id, count(*) AS n_edges FROM ed GROUP BY ALL) USING (graph_id)),
ks AS (SELECT graph_id, list_sort(list(concat_ws('|', src_kind, kind, dst_kind, n))) AS k FROM ms GROUP BY graph_id),
mem AS (SELECT graph_id, min(graph_id) OVER (PARTITION BY k, n_nodes, n_edges) AS class_id FROM ks JOIN sz USING (graph_id)),
cm AS (SELECT * FROM ms WHERE graph_id IN (SELECT class_id FROM mem)), ci AS (SELECT x.graph_id AS a, y.graph_id AS b, sum(least(x.n, y.n))::BIGINT AS i FROM cm x JOIN cm y USING (src_kind, kind, dst_kind) GROUP BY ALL),
cr AS (SELECT a, b, i / (x.n_edges + y.n_edges - i) AS raw, least(x.n_nodes, y.n_nodes) / greatest(x.n_nodes, y.n_nodes) AS rn, least(x.n_edges, y.n_edges) / greatest(x.n_edges, y.n_edges) AS re FROM ci JOIN sz x ON x.graph_id = a JOIN sz y ON y.graph_id = b),
ca AS (SELECT a, b, raw, raw * rn * re AS adjusted FROM cr)"""
#: Similarity of linked classes, and of linked literal graphs.
TYPED_LINK, LITERAL_LINK = 0.6, 0.5


def _typed_classes(spark, d):
    nodes, edges = _order_graphs(spark, d)
    return J.set_classes(G.typed_multiset_small(edges, nodes), "graph_id", ["src_kind", "kind", "dst_kind"], "n", _sizes(nodes, edges), ["n_nodes", "n_edges"])


@q(f"WITH {_CL} SELECT * FROM mem")
def typed_classes(spark, d):
    return _typed_classes(spark, d)[1]


@q(f"WITH {_CL} SELECT a, b, round(raw, 6) AS raw, round(adjusted, 6) AS adjusted FROM ca WHERE a < b AND adjusted >= {TYPED_LINK} - 1e-9")
def typed_links(spark, d):
    classes, _ = _typed_classes(spark, d)
    return _r(J.similar_classes(classes, classes, TYPED_LINK, ["n_nodes", "n_edges"], same=True).select("a", "b", "raw", "adjusted"), "raw", "adjusted")


@q(f"""WITH {_CL}, off AS (SELECT class_id, graph_id AS other FROM mem QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY graph_id) <= 4),
be AS (SELECT a, other, adjusted FROM ca JOIN off ON class_id = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY adjusted DESC, other) <= 4)
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY adjusted DESC, other)::INT AS rank, other, round(adjusted, 6) AS adjusted FROM mem JOIN be ON a = class_id WHERE other <> graph_id QUALIFY rank <= 3""")
def typed_nearest(spark, d):
    classes, members = _typed_classes(spark, d)
    return _r(J.nearest_sets(classes, members, "graph_id", 3, ["n_nodes", "n_edges"]), "adjusted")


@q(f"""WITH {_GN}, e AS (SELECT graph_id, source || kind || target AS x FROM ed), n AS (SELECT graph_id, kind || id AS x FROM nd), es AS (SELECT graph_id, count(*) AS k FROM e GROUP BY ALL), ns AS (SELECT graph_id, count(*) AS k FROM n GROUP BY ALL),
ei AS (SELECT p.graph_id AS a, q.graph_id AS b, count(*) AS i FROM e p JOIN e q ON p.x = q.x AND p.graph_id < q.graph_id GROUP BY ALL),
ej AS (SELECT a, b, i / (x.k + y.k - i) AS je FROM ei JOIN es x ON x.graph_id = a JOIN es y ON y.graph_id = b WHERE 0.7 * (i / (x.k + y.k - i)) + 0.3 >= {LITERAL_LINK} - 1e-9),
ni AS (SELECT a, b, any_value(je) AS je, count(q.x) AS i FROM ej JOIN n p ON p.graph_id = a LEFT JOIN n q ON q.graph_id = b AND q.x = p.x GROUP BY ALL)
SELECT a, b, round(0.7 * je + 0.3 * (i / (x.k + y.k - i)), 6) AS score FROM ni JOIN ns x ON x.graph_id = a JOIN ns y ON y.graph_id = b WHERE 0.7 * je + 0.3 * (i / (x.k + y.k - i)) >= {LITERAL_LINK} - 1e-9""")
def overlap_links(spark, d):
    nodes, edges = _order_graphs(spark, d)
    g = edges.groupBy("graph_id").agg(F.collect_set(F.concat("source", "kind", "target")).alias("edges")).join(nodes.groupBy("graph_id").agg(F.collect_set(F.concat("kind", "id")).alias("nodes")), "graph_id")
    return _r(J.overlap_links(g, None, LITERAL_LINK), "score")


_LABELS = ("license", "tion", "und", "que", "ther", "eau", "ción")


@q(f"WITH h AS (SELECT passage_id, label, row_number() OVER (PARTITION BY passage_id ORDER BY label) AS n FROM ({PASSAGES}), (VALUES {', '.join(f"('{x}')" for x in _LABELS)}) l(label) WHERE contains(lower(text), label)) SELECT passage_id, n::INT AS n, label, lead(label) OVER (PARTITION BY passage_id ORDER BY label) AS next_label FROM h WHERE n <= 20")
def lexical_proxy_graph(spark, d):
    return G.lexical_proxy(passages(spark, d), spark.createDataFrame([(x,) for x in _LABELS], "label string"))


_K2 = "k2 AS (SELECT [a.x, b.x] AS signature, count(*) AS support FROM (SELECT passage_id, unnest(signature) AS x FROM sg) a JOIN (SELECT passage_id, unnest(signature) AS x FROM sg) b ON a.passage_id = b.passage_id AND a.x < b.x GROUP BY ALL HAVING count(*) >= 3)"


@q(f"WITH {GRAPH}, {_K2} SELECT * FROM k2")
def motif_support(spark, d):
    return D.frequent_sets(_sig(spark, d), "passage_id", 3, 2, longer=False)


def _sets_sql(most):
    """SQL for the item sets of size 2..most that at least 3 passages of u hold."""
    join = lambda a, b: f" JOIN u {b} ON {a}.passage_id = {b}.passage_id AND {a}.x < {b}.x"
    one = lambda n: f"SELECT [{', '.join(f'{c}.x' for c in n)}] AS signature, count(*) AS support FROM u a{''.join(map(join, n, n[1:]))} GROUP BY ALL HAVING count(*) >= 3"
    return " UNION ALL ".join(one("abcdef"[:k]) for k in range(2, most + 1))


_LONGER = "SELECT signature, count(*) AS support FROM {} WHERE len(signature) > 6 GROUP BY signature HAVING count(*) >= 3"
_MO = f"u AS (SELECT passage_id, unnest(signature) AS x FROM sg), mo AS ({_sets_sql(6)} UNION ALL {_LONGER.format('sg')})"


def _motifs(spark, d):
    return D.frequent_sets(_sig(spark, d), "passage_id", 3)


@q(f"WITH {GRAPH}, {_MO} SELECT * FROM mo")
def motif_mining(spark, d):
    return _motifs(spark, d)


@q(f"WITH {ANN}, u AS (SELECT passage_id, feature_id AS x FROM ann WHERE label = '1') {_sets_sql(4)}")
def feature_combos(spark, d):
    items = _pos(spark, d).groupBy("passage_id").agg(F.array_sort(F.collect_set("feature_id")).alias("signature"))
    return D.frequent_sets(items, "passage_id", 3, 4, longer=False)


_FAM = """CASE WHEN list_has_any(signature, ['N:substrate', 'N:disturbance', 'N:space']) AND list_has_any(signature, ['E:pervades', 'E:propagates_through', 'E:manifests_as']) THEN 'field_like'
WHEN list_contains(signature, 'E:cannot_be_reduced_to') AND list_contains(signature, 'N:whole') THEN 'unknown' WHEN list_has_any(signature, ['N:matter', 'N:motion', 'N:cause', 'N:effect']) THEN 'classical' ELSE 'unrelated' END"""


@q(f"WITH {GRAPH}, {_MO} SELECT signature, support, {_FAM} AS family FROM mo")
def motif_family(spark, d):
    return D.structural_family(_motifs(spark, d))


_OWN = f"{_MO}, ow AS (SELECT mo.signature, sg.passage_id, tradition, work FROM mo JOIN sg ON list_has_all(sg.signature, mo.signature) JOIN p USING (passage_id))"
_ENR = f"""{_OWN}, tot AS (SELECT count(*) FILTER (tradition = 'en') AS nt, count(*) FILTER (tradition IN ('fr', 'de')) AS nc FROM p),
en0 AS (SELECT signature, count(*) FILTER (tradition = 'en') AS n_target, count(*) FILTER (tradition IN ('fr', 'de')) AS n_control, count(DISTINCT work) AS n_works FROM ow GROUP BY signature),
en AS (SELECT *, CASE WHEN n_target = 0 AND n_control = 0 THEN 1.0 WHEN n_control = 0 AND n_target > 0 THEN NULL WHEN n_control = 0 THEN 1.0 ELSE (n_target / greatest(nt, 1)) / (n_control / greatest(nc, 1)) END::DOUBLE AS e,
 n_control = 0 AND n_target > 0 AS infinite, sqrt((1 / greatest(n_target, 1) - 1 / greatest(nt, 1)) + (1 / greatest(n_control, 1) - 1 / greatest(nc, 1))) AS se FROM en0, tot)"""


def _mined(spark, d):
    """The frequent sets, and the signatures that they come from: texts are read once."""
    s = written(_sig(spark, d))
    return D.frequent_sets(s, "passage_id", 3), s


def _owner_counts(spark, d, by):
    return D.owner_counts(*_mined(spark, d), passages(spark, d), "passage_id", by)


def _enrichment(counts, p):
    totals = p.groupBy("tradition").agg(F.count("*").alias("n"))
    return D.enrichment(counts, totals, ["en"], ["fr", "de"], "tradition")


_ci = lambda s: f"CASE WHEN n_control > 0 THEN round(exp(CASE WHEN e > 0 THEN ln(e) ELSE 0 END {s} 1.96 * se), 6) END"


@q(f"WITH {GRAPH}, {_ENR} SELECT signature, n_target, n_control, round(e, 6) AS enrichment, infinite, {_ci('-')} AS lo, {_ci('+')} AS hi FROM en")
def motif_enrichment(spark, d):
    return _r(_enrichment(_owner_counts(spark, d, "tradition"), passages(spark, d)), "enrichment", "lo", "hi")


@q(f"""WITH {GRAPH}, {_ENR}, m AS (SELECT mo.signature, support, n_works, e, infinite, {_FAM.replace('signature', 'mo.signature')} AS family FROM mo JOIN en ON en.signature = mo.signature),
s AS (SELECT *, round(0.25 * least(CASE WHEN infinite THEN 5.0 ELSE coalesce(e, 0) END / 5.0, 1.0) + 0.2 * least(n_works / 5.0, 1.0) + 0.15 * least(support / 20.0, 1.0) + 0.15 * CASE WHEN family = 'field_like' THEN 1.0 WHEN family = 'unrelated' THEN 0.2 ELSE 0.4 END + 0.1 * CASE WHEN family = 'field_like' THEN 1.0 ELSE 0.5 END + 0.075, 9)::DOUBLE AS rank_score FROM m)
SELECT signature, family, round(rank_score, 6) AS rank_score, row_number() OVER (ORDER BY rank_score DESC, len(signature), signature)::INT AS rank FROM s""")
def motif_ranking(spark, d):
    p, (sets, s) = passages(spark, d), _mined(spark, d)
    works = D.owner_counts(sets, s, p, "passage_id", "work").groupBy("signature").agg(F.count("work").alias("n_works"))
    e = _enrichment(D.owner_counts(sets, s, p, "passage_id", "tradition"), p).select("signature", "enrichment", "infinite")
    m = D.structural_family(sets).join(e, "signature").join(works, "signature")
    return _r(D.rank_motifs(m).select("signature", "family", "rank_score", "rank"), "rank_score")


@q(f"""WITH {GRAPH}, bg AS (SELECT x AS item, count(*) AS c FROM (SELECT unnest(signature) AS x FROM sg JOIN ({ROLES}) USING (passage_id) WHERE role = 'control') GROUP BY x), tt AS (SELECT sum(c) AS t, count(*) AS v FROM bg),
s AS (SELECT passage_id, any_value(signature) AS signature, least(-sum(ln((coalesce(c, 0) + 1) / (t + v))), -ln(1e-12)) AS s FROM (SELECT passage_id, signature, unnest(signature) AS item FROM sg) LEFT JOIN bg USING (item), tt GROUP BY passage_id),
f AS (SELECT passage_id, s, list_filter([CASE WHEN n_chars < 40 THEN 'very_short' END, CASE WHEN n_chars > 4000 THEN 'very_long' END, CASE WHEN len(signature) = 1 AND signature[1] LIKE 'N:%' THEN 'sparse_graph' END, CASE WHEN count(*) OVER (PARTITION BY signature) >= 5 THEN 'duplicate_cluster' END], lambda x: x IS NOT NULL) AS flags
FROM s JOIN documents ON doc_id = passage_id)
SELECT passage_id, round(s, 6) AS surprisal, flags, CASE WHEN len(flags) > 0 THEN 'ARTIFACT_SUSPECTED' WHEN round(s, 9) >= (SELECT quantile_cont(round(s, 9), 0.95) FROM f) THEN 'ANOMALY_CANDIDATE' ELSE 'TYPICAL' END AS status FROM f""")
def surprisal(spark, d):
    s = _sig(spark, d)
    bg = s.join(roles(spark, d).filter("role = 'control'"), "passage_id")
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "n_chars")
    return _r(D.surprisal(s, bg, meta), "surprisal")


#: Of structural families, which name no motif quantum-specific.
_THEMES = {"field_like": f"({_FAM}) = 'field_like'", "atomistic": "list_has_any(signature, ['N:constituent', 'N:matter'])", "relational": "len(list_filter(signature, lambda x: starts_with(x, 'E:'))) > 0", "observer": "list_contains(signature, 'N:observer')"}


@q(f"""WITH {GRAPH}, {_OWN}, c AS (SELECT tradition, signature, count(*) AS n, count(*) OVER (PARTITION BY signature) AS n_groups FROM ow GROUP BY signature, tradition)
SELECT tradition, signature, n, n_groups, CASE WHEN n_groups = 1 THEN 'unique' ELSE 'shared' END AS scope, list_filter([{', '.join(f"CASE WHEN {w} THEN '{t}' END" for t, w in sorted(_THEMES.items()))}], lambda x: x IS NOT NULL) AS themes,
count(*) OVER t AS n_motifs, count(*) FILTER (n_groups = 1) OVER t AS n_unique, count(*) FILTER (n_groups > 1) OVER t AS n_shared FROM c WINDOW t AS (PARTITION BY tradition)""")
def motif_atlas(spark, d):
    sets, s = _mined(spark, d)
    sets = written(sets)  # counted by owners, and put into themes
    return D.atlas(D.structural_family(sets), D.owner_counts(sets, s, passages(spark, d), "passage_id", "tradition"), "tradition")


@q(f"""WITH {GRAPH}, h AS (SELECT sg.*, work FROM sg JOIN p USING (passage_id)), o AS (SELECT * FROM h WHERE work IN ('src1', 'src2', 'src3', 'src4')), u AS (SELECT passage_id, unnest(signature) AS x FROM o), r AS (SELECT DISTINCT signature FROM h WHERE work NOT IN ('src1', 'src2', 'src3', 'src4')),
m AS ({_sets_sql(6)} UNION ALL {_LONGER.format('o')}), b AS (SELECT m.signature, bool_or(r.signature = m.signature) AS exact FROM m JOIN r ON list_has_all(r.signature, m.signature) GROUP BY ALL)
SELECT signature, coalesce(exact, false) AS exact, exact IS NOT NULL AS recovered FROM m LEFT JOIN b USING (signature)""")
def motif_replication(spark, d):
    s = _sig(spark, d).join(passages(spark, d).select("passage_id", "work"), "passage_id")
    own = F.col("work").isin("src1", "src2", "src3", "src4")
    return D.replication(D.frequent_sets(s.filter(own), "passage_id", 3), s.filter(~own))


_BI = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: length(w) >= 4)"
_BIG = f"bw AS (SELECT passage_id, tradition, {_BI} AS ws FROM ({PASSAGES})), bb AS (SELECT passage_id, tradition, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bigram FROM bw)"


@q(f"WITH {_BIG} SELECT bigram, count(*) AS n FROM bb GROUP BY bigram ORDER BY n DESC, bigram LIMIT 20")
def bigram_motifs(spark, d):
    return Sel.top(D.bigrams(passages(spark, d), ["passage_id"]).groupBy("bigram").agg(F.count("*").alias("n")), F.col("n"), "bigram", 20)


@q(f"""WITH {_BIG}, t AS (SELECT bigram FROM bb GROUP BY bigram ORDER BY count(*) DESC, bigram LIMIT 20), x AS (SELECT DISTINCT bigram, passage_id, tradition FROM bb JOIN t USING (bigram)), n AS (SELECT count(*) FILTER (tradition = 'en') AS ne, count(*) FILTER (tradition <> 'en') AS no FROM ({PASSAGES}))
SELECT bigram, round((count(*) FILTER (tradition = 'en') / any_value(ne) + 1e-9) / (count(*) FILTER (tradition <> 'en') / any_value(no) + 1e-9), 3)::DOUBLE AS lift FROM x, n GROUP BY bigram""")
def bigram_lift(spark, d):
    rows = passages(spark, d)
    t = Sel.top(D.bigrams(rows, []).groupBy("bigram").agg(F.count("*").alias("n")), F.col("n"), "bigram", 20)
    sides = lambda df, *by: df.groupBy(*by).agg(F.count_if(F.col("tradition") == "en").alias("en"), F.count_if(F.col("tradition") != "en").alias("other"))
    n = sides(rows).select(F.col("en").alias("ne"), F.col("other").alias("no"))
    held = F.array_intersect(D.bigram_list(F.col("text")), "__top")
    x = rows.crossJoin(F.broadcast(t.agg(F.collect_list("bigram").alias("__top")))).select("passage_id", "tradition", F.explode(held).alias("bigram")).distinct()
    lift = (F.col("en") / F.col("ne") + 1e-9) / (F.col("other") / F.col("no") + 1e-9)
    return _r(sides(x, "bigram").crossJoin(F.broadcast(n)).select("bigram", lift.alias("lift")), "lift", n=3)


_DATE = "CASE WHEN passage_id % 9 <> 0 THEN passage_id % 700 - 300 END AS date_lo, CASE WHEN passage_id % 9 <> 0 THEN passage_id % 700 - 250 + passage_id % 7 END AS date_hi"


def _dates(df):
    return df.selectExpr("*", *_DATE.split(", CASE")[:1], "CASE" + _DATE.split(", CASE")[1])


@q(f"WITH {ANN}, f AS (SELECT feature_id, passage_id, {_DATE} FROM ann WHERE label = '1') SELECT feature_id, (date_lo + date_hi) / 2 AS first_mid, passage_id AS first_id, date_hi - date_lo AS width FROM f WHERE date_lo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY first_mid, passage_id) = 1")
def first_appearance(spark, d):
    return D.first_appearance(_dates(_pos(spark, d)), ["feature_id"])


@q(f"WITH {ANN}, f AS (SELECT feature_id, passage_id, {_DATE} FROM ann WHERE label = '1') SELECT a.feature_id AS f1, b.feature_id AS f2, (a.date_lo + a.date_hi) / 2 AS first_mid, passage_id AS first_id, a.date_hi - a.date_lo AS width FROM f a JOIN f b USING (passage_id) WHERE a.feature_id < b.feature_id AND a.date_lo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f1, f2 ORDER BY first_mid, passage_id) = 1")
def first_pair_appearance(spark, d):
    return D.first_appearance(D.feature_pairs(_dates(_pos(spark, d)).select("passage_id", "feature_id", "date_lo", "date_hi")), ["f1", "f2"])


@q(f"WITH {GRAPH}, {_OWN}, m AS (SELECT signature, (date_lo + date_hi) / 2 AS mid FROM (SELECT *, {_DATE} FROM ow)), l AS (SELECT signature, count(mid) AS n_dated, min(mid) AS earliest, max(mid) AS latest, list_sort(list(mid) FILTER (mid IS NOT NULL)) AS ms FROM m GROUP BY signature) SELECT signature, n_dated, earliest, latest, ms[n_dated // 2 + 1] AS middle, CASE WHEN n_dated > 0 THEN 'dated' ELSE 'undated' END AS status FROM l")
def motif_temporal(spark, d):
    return D.motif_dates(*_mined(spark, d), _dates(passages(spark, d).select("passage_id")))


_WR = f"wr AS (SELECT p.work, CASE WHEN avg((role = 'target')::INT) > 0.8 THEN 'target' ELSE 'control' END AS role FROM ({PASSAGES}) p JOIN ({ROLES}) USING (passage_id) GROUP BY p.work)"


@q(f"""WITH {GRAPH}, {_OWN}, {_WR}, cl AS (SELECT role AS arm, work AS cluster, row_number() OVER (ORDER BY role, work) - 1 AS i, count(*) OVER (PARTITION BY role) AS k, row_number() OVER (PARTITION BY role ORDER BY work) - 1 AS j FROM wr),
pr AS (SELECT m.signature, c.arm, c.cluster, c.j, (o.work IS NOT NULL)::INT AS hit FROM (SELECT DISTINCT signature FROM ow) m CROSS JOIN cl c LEFT JOIN (SELECT DISTINCT signature, work FROM ow) o ON o.signature = m.signature AND o.work = c.cluster),
dr AS (SELECT r.range AS rep, c.arm, {_d("'mb'", 'r.range', 'c.arm', 'c.j')} % c.k AS j FROM range(50) r, cl c),
e AS (SELECT signature, rep, avg(hit) FILTER (arm = 'target') AS pt, avg(hit) FILTER (arm = 'control') AS pc FROM dr JOIN pr USING (arm, j) GROUP BY ALL),
v AS (SELECT signature, CASE WHEN pc = 0 THEN CASE WHEN pt > 0 THEN 50.0 ELSE 1.0 END ELSE pt / pc END::DOUBLE AS v FROM e)
SELECT signature, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM v GROUP BY signature""")
def motif_bootstrap(spark, d):
    owned = _owner_counts(spark, d, "work").select("signature", F.col("work").alias("cluster"))
    arm = F.when(F.avg((F.col("role") == "target").cast("double")) > 0.8, "target").otherwise("control")
    works = role_passages(spark, d).groupBy(F.col("work").alias("cluster")).agg(arm.alias("arm"))
    return _r(motif_work_bootstrap(owned, works, 50, "mb"), "lo", "hi")


def motif_work_bootstrap(owned, works, n_boot, seed, cap=50.0):
    """(signature, lo, hi): interval of the ratio of shares of works that hold a motif, when works are drawn by arm.

    owned: (signature, cluster); works: (cluster, arm). An infinite ratio counts as the cap.
    """
    w = W.partitionBy("arm")
    numbered = works.withColumns({"j": F.row_number().over(w.orderBy("cluster")) - 1, "k": F.count("*").over(w)})
    flags = owned.select("signature").distinct().crossJoin(F.broadcast(numbered)).join(owned.withColumn("hit", F.lit(1)), ["signature", "cluster"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    draws = I.replicates(works, n_boot).crossJoin(F.broadcast(numbered.select("arm", F.col("j").alias("slot"), "k")))
    draws = draws.select("rep", "arm", (I.draw(seed, F.col("rep"), F.col("arm"), F.col("slot")) % F.col("k")).alias("j"))
    share = lambda a: F.avg(F.when(F.col("arm") == a, F.col("hit")))
    e = draws.join(flags.select("signature", "arm", "j", "hit"), ["arm", "j"]).groupBy("signature", "rep").agg(share("target").alias("pt"), share("control").alias("pc"))
    v = F.when((F.col("pc") == 0) & (F.col("pt") > 0), cap).when(F.col("pc") == 0, 1.0).otherwise(F.try_divide("pt", "pc"))
    out = e.groupBy("signature").agg(F.percentile(v, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return out.select("signature", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


# Learning: languages as classes.

_W = f"lab AS (SELECT passage_id, tradition AS label, work, split FROM ({SPLIT})), {tfidf_sql(f'SELECT passage_id, term, count(*) AS tf FROM (SELECT passage_id, unnest({TOKENS}) AS term FROM ({PASSAGES})) GROUP BY ALL')}"
_PRED = f"""{_W}, ce AS (SELECT label, term, sum(weight) / (SELECT count(*) FROM lab l WHERE l.label = lab.label AND split = 'train') AS m FROM tw JOIN lab USING (passage_id) WHERE split = 'train' GROUP BY label, term),
cn AS (SELECT label, term, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM ce),
si AS (SELECT passage_id, cn.label AS predicted, round(sum(weight * c), 9) AS similarity FROM tw JOIN lab USING (passage_id) JOIN cn USING (term) WHERE split <> 'train' GROUP BY ALL),
pr AS (SELECT si.*, lab.label AS truth, work FROM si JOIN lab USING (passage_id) QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY similarity DESC, predicted) = 1)"""


def _text_blocks(spark, d):
    p = _split(spark, d)
    rows = p.select("passage_id", F.col("tradition").alias("truth"), "work", (F.col("split") == "train").alias("train"), (F.col("split") != "train").alias("asked"), "text")
    return B.tfidf_blocks(B.whole_texts(rows, "passage_id", ["truth", "work", "train", "asked"]), "passage_id")


def _labels(spark, d):
    return _split(spark, d).select("passage_id", F.col("tradition").alias("label"), "work", "split")


def _centroid_predictions(spark, d):
    blocks, lab = _text_blocks(spark, d), _labels(spark, d)
    sums = B.tag_sums(blocks, ["truth"], "train").withColumnRenamed("truth", "label")
    c = L.centroids(sums, lab.filter("split = 'train'").select("passage_id", "label"))
    test = lab.filter("split <> 'train'").groupBy("passage_id").agg(F.min(F.struct(F.col("label").alias("truth"), "work")).alias("x")).select("passage_id", "x.*")
    return L.centroid_predict(blocks, c, "passage_id", "asked").join(test, "passage_id")


@q(f"WITH {_PRED} SELECT passage_id, truth, predicted, round(similarity, 6) AS similarity FROM pr")
def centroid_predict(spark, d):
    return _r(_centroid_predictions(spark, d).select("passage_id", "truth", "predicted", "similarity"), "similarity")


#: Predictions with errors, so that the reports have something to count.
_NOISY = "CASE WHEN passage_id % 4 = 0 THEN 'en' WHEN passage_id % 11 = 0 THEN 'de' ELSE tradition END"
_NP = f"np AS (SELECT passage_id, work, tradition AS truth, {_NOISY} AS predicted FROM ({PASSAGES}))"


def _noisy(spark, d):
    return passages(spark, d).select("passage_id", "work", F.col("tradition").alias("truth"), F.expr(_NOISY).alias("predicted"))


@q(f"""WITH {_NP}, l AS (SELECT DISTINCT truth AS label FROM np UNION SELECT DISTINCT predicted FROM np), c AS (SELECT label, (SELECT count(*) FROM np WHERE truth = label) AS support, (SELECT count(*) FROM np WHERE predicted = label) AS said, (SELECT count(*) FROM np WHERE truth = label AND predicted = label) AS hit FROM l),
x AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM c)
SELECT label, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6)::DOUBLE AS f1, support FROM x""")
def classification_report(spark, d):
    return _r(L.classification_report(_noisy(spark, d)), "precision", "recall", "f1")


@q(f"""WITH {_NP}, l AS (SELECT DISTINCT truth AS label FROM np UNION SELECT DISTINCT predicted FROM np), c AS (SELECT label, (SELECT count(*) FROM np WHERE truth = label) AS support, (SELECT count(*) FROM np WHERE predicted = label) AS said, (SELECT count(*) FROM np WHERE truth = label AND predicted = label) AS hit FROM l),
x AS (SELECT *, coalesce(2 * hit / nullif(said + support, 0), 0) AS f1 FROM c)
SELECT sum(support)::BIGINT AS n, round(sum(hit) / sum(support), 6) AS top1, round(avg(f1), 6) AS macro_f1, arg_min(label, (round(f1, 9), label)) AS weakest, round(min(f1), 6) AS weakest_f1 FROM x""")
def classification_summary(spark, d):
    return _r(L.classification_summary(_noisy(spark, d)), "top1", "macro_f1", "weakest_f1")


@q(f"WITH {_NP} SELECT truth, predicted, count(*) AS n FROM np GROUP BY ALL")
def confusion_matrix(spark, d):
    return L.confusion(_noisy(spark, d))


_SCQ = f"{SCORES}, tr AS (SELECT passage_id, CASE WHEN passage_id % 50 = 0 THEN 'T9' ELSE 'T' || (passage_id % 4 + 1) END AS truth, work FROM p), rk AS (SELECT passage_id, theory_id, round(score, 9) AS s, row_number() OVER (PARTITION BY passage_id ORDER BY round(score, 9) DESC, theory_id) AS k FROM sc)"
_OWNQ = "ow AS (SELECT passage_id, work, coalesce(max(k) FILTER (theory_id = truth), count(*) + 1) AS r, max(s) FILTER (k = 1) - coalesce(max(s) FILTER (k = 2), 0) AS margin, max(s) = 0 AS empty FROM rk JOIN tr USING (passage_id) GROUP BY ALL)"
_METR = "count(*) AS n, round(avg(1 / r), 6) AS mrr, round(avg((r = 1)::INT), 6) AS top1, round(avg((r <= 2)::INT), 6) AS top2, round(avg(margin), 6) AS margin, count(*) FILTER (empty) AS n_empty"


def _ranked(spark, d):
    s = scores(spark, d).select(F.col("passage_id").alias("query"), F.col("theory_id").alias("item"), F.round("score", 9).alias("score"))
    truth = F.when(F.col("passage_id") % 50 == 0, "T9").otherwise(F.concat(F.lit("T"), (F.col("passage_id") % 4 + 1).cast("string")))
    return s, passages(spark, d).select(F.col("passage_id").alias("query"), truth.alias("truth"), "work")


@q(f"WITH {_SCQ}, {_OWNQ} SELECT {_METR} FROM ow")
def retrieval_metrics(spark, d):
    return _r(L.retrieval_metrics(*_ranked(spark, d)), "mrr", "top1", "top2", "margin")


@q(f"WITH {_SCQ}, {_OWNQ} SELECT work, {_METR} FROM ow GROUP BY work")
def retrieval_by_group(spark, d):
    return _r(L.retrieval_metrics(*_ranked(spark, d), ["work"]), "mrr", "top1", "top2", "margin")


@q(f"WITH {_NP}, s AS (SELECT count(*) AS n, count(*) FILTER (truth = predicted) / count(*) AS po FROM np), e AS (SELECT sum(a.n * b.n) / (SELECT n * n FROM s) AS pe FROM (SELECT truth AS k, count(*) AS n FROM np GROUP BY 1) a JOIN (SELECT predicted AS k, count(*) AS n FROM np GROUP BY 1) b USING (k)) SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6)::DOUBLE AS kappa FROM s, e")
def cohens_kappa(spark, d):
    return _r(L.cohens_kappa(_noisy(spark, d).select(F.col("truth").alias("a"), F.col("predicted").alias("b"))), "po", "pe", "kappa")


@q("SELECT quality, toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def label_contingency(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@q(f"""WITH {ANN}, f AS (SELECT passage_id, feature_id, label AS kind FROM ann WHERE label <> 'NA'), g AS (SELECT passage_id, feature_id, CASE WHEN passage_id % 7 = 0 THEN '0' ELSE kind END AS kind FROM f WHERE passage_id % 5 <> 0 UNION ALL SELECT passage_id, 'GOLD', '1' FROM p WHERE passage_id % 10 = 0),
c AS (SELECT count(*) FILTER (g.kind = f.kind) AS tp, count(*) FILTER (g.kind IS NULL) AS fp, count(*) FILTER (f.kind IS NULL) AS fn, count(*) FILTER (g.kind <> f.kind) AS n_wrong_kind FROM g FULL JOIN f USING (passage_id, feature_id)), r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c)
SELECT tp, fp, fn, n_wrong_kind, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r""")
def extraction_eval(spark, d):
    found = annotations(spark, d).filter("label <> 'NA'").select("passage_id", "feature_id", F.col("label").alias("kind"))
    gold = found.filter("passage_id % 5 <> 0").withColumn("kind", F.when(F.col("passage_id") % 7 == 0, "0").otherwise(F.col("kind")))
    gold = gold.unionByName(passages(spark, d).filter("passage_id % 10 = 0").select("passage_id", F.lit("GOLD").alias("feature_id"), F.lit("1").alias("kind")))
    return _r(L.extraction_eval(gold, found, ["passage_id", "feature_id"]), "precision", "recall", "f1")


@q(f"""WITH s AS (SELECT * FROM ({SPLIT})), l AS (SELECT list_sort(list(DISTINCT tradition)) AS ls FROM s WHERE split = 'train'), m AS (SELECT tradition AS m FROM s WHERE split = 'train' GROUP BY tradition ORDER BY count(*) DESC, tradition LIMIT 1)
SELECT passage_id, tradition AS truth, m AS majority, ls[{_d("'mr'", 'passage_id')} % len(ls) + 1] AS random FROM s, l, m WHERE split <> 'train'""")
def majority_baseline(spark, d):
    s = _split(spark, d)
    return L.majority_and_random(s.filter("split = 'train'"), s.filter("split <> 'train'"), "tradition", "passage_id", "mr")


def _text_rows(spark, d):
    return _labels(spark, d).join(passages(spark, d).select("passage_id", "text"), "passage_id")


def _text_model(spark, d, kind, bigrams=False):
    rows = _text_rows(spark, d)
    return L.predict(L.text_classifier(rows.filter("split = 'train'").select("text", "label"), kind, bigrams), rows.filter("split <> 'train'"), "passage_id")


@q()
def svc_predict(spark, d):
    return _text_model(spark, d, "svc")


@q()
def svc_predict_pairs(spark, d):
    return _text_model(spark, d, "svc", True)


@q()
def svc_margins(spark, d):
    rows = _text_rows(spark, d)
    model = L.text_classifier(rows.filter("split = 'train'").select("text", "label"), "svc")
    return _r(L.rank_summary(L.decision_ranks(model, rows.filter("split <> 'train'"), "passage_id")), "mean_rank", "mean_margin", "top2")


@q()
def logreg_predict(spark, d):
    return _text_model(spark, d, "logreg")


@q()
def logreg_predict_pairs(spark, d):
    return _text_model(spark, d, "logreg", True)


@q()
def feature_classifier(spark, d):
    wide = values(spark, d).groupBy("passage_id", F.col("tradition").alias("label")).pivot("feature_id", FEATURES).agg(F.first("value")).fillna(0.0)
    wide = written(wide)  # the fit and the prediction read it several times
    return L.predict(L.feature_classifier(wide, FEATURES, "label"), wide, "passage_id")


@q(f"""WITH {_W}, rw AS (SELECT * FROM tw JOIN lab USING (passage_id)), tt AS (SELECT label, term, sum(weight) AS s FROM rw GROUP BY ALL), gg AS (SELECT label, term, work, sum(weight) AS g FROM rw GROUP BY ALL),
lf AS (SELECT tt.label, tt.term, w.work, s - coalesce(g, 0) AS s FROM tt CROSS JOIN (SELECT DISTINCT work FROM lab) w LEFT JOIN gg ON gg.label = tt.label AND gg.term = tt.term AND gg.work = w.work), nm AS (SELECT label, work, sqrt(sum(s * s)) AS norm FROM lf GROUP BY ALL),
si AS (SELECT passage_id, rw.label AS truth, lf.label, round(coalesce(sum(weight * s) / nullif(any_value(norm), 0), 0), 9) AS sim FROM rw JOIN lf ON lf.work = rw.work AND lf.term = rw.term JOIN nm ON nm.label = lf.label AND nm.work = lf.work GROUP BY ALL),
p1 AS (SELECT * FROM si QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY sim DESC, label) = 1) SELECT truth, label AS predicted, count(*) AS n FROM p1 GROUP BY ALL""")
def logo_centroid(spark, d):
    return L.confusion(L.leave_group_out(_text_blocks(spark, d), "passage_id", "truth", "work"))


@q(f"""WITH {_NP}, c AS (SELECT work, count(*) AS n, avg((truth = predicted)::INT) AS top1 FROM np GROUP BY work HAVING count(*) >= 3),
l AS (SELECT DISTINCT work, label FROM (SELECT work, truth AS label FROM np UNION SELECT work, predicted FROM np)),
f AS (SELECT l.work, l.label, 2 * count(*) FILTER (truth = label AND predicted = label) / (count(*) FILTER (truth = label) + count(*) FILTER (predicted = label)) AS f1 FROM l JOIN np ON np.work = l.work GROUP BY ALL),
m AS (SELECT work, avg(f1) AS macro FROM f GROUP BY work) SELECT count(*) AS n_groups, round(avg(top1), 6) AS mean_top1, round(avg(macro), 6) AS mean_macro_f1 FROM c JOIN m USING (work)""")
def group_cv_summary(spark, d):
    return _r(L.group_summary(_noisy(spark, d), "work", 3), "mean_top1", "mean_macro_f1")


def _group_texts(spark, d):
    return passages(spark, d).select(F.col("passage_id").alias("key"), F.col("tradition").alias("label"), F.col("work").alias("fold"), "text")


@q()
def logo_linear(spark, d):
    """Means over trained folds, one for each work that is left out."""
    return _r(Ln.fold_summary(Ln.leave_group_out_linear(_group_texts(spark, d))), "mean_top1", "mean_macro_f1")


@q()
def linear_predict(spark, d):
    rows = Ln.hashed_terms(_group_texts(spark, d))
    model = Ln.fit_folds(rows.filter("key % 5 <= 2"), [None])
    return Ln.predict_folds(model, rows.filter("key % 5 > 2"), [None]).select(F.col("key").alias("passage_id"), "truth", "predicted")


GRID = ((0.0, 1.0), (0.25, 0.75), (0.5, 0.5), (0.75, 0.25), (1.0, 0.0))


@q(f"""WITH {_SCQ}, g(w1, w2) AS (VALUES {', '.join(map(str, GRID))}), pt AS (SELECT passage_id, theory_id, score AS s1, CASE WHEN theory_id = truth AND passage_id % 3 <> 0 THEN 0.5 ELSE 0.25 END AS s2, truth FROM sc JOIN tr USING (passage_id)),
r AS (SELECT w1, w2, passage_id, theory_id, truth, round(w1 * s1 + w2 * s2, 9)::DOUBLE AS s FROM pt, g), k AS (SELECT *, row_number() OVER (PARTITION BY w1, passage_id ORDER BY s DESC, theory_id) AS k FROM r),
o AS (SELECT w1, w2, passage_id, coalesce(max(k) FILTER (theory_id = truth), count(*) + 1) AS r, max(s) = 0 AS e FROM k GROUP BY ALL), m AS (SELECT w1, w2, avg(1 / r) AS mrr, count(*) FILTER (e) AS n_empty FROM o GROUP BY ALL)
SELECT w1::DOUBLE AS w1, w2::DOUBLE AS w2, round(mrr, 6) AS mrr, n_empty, row_number() OVER (ORDER BY round(mrr, 9) DESC, n_empty, abs(w1 - w2), w1) = 1 AS chosen FROM m""")
def weight_selection(spark, d):
    s, t = _ranked(spark, d)
    parts = s.drop("score").join(scores(spark, d).select(F.col("passage_id").alias("query"), F.col("theory_id").alias("item"), F.col("score").alias("s1")), ["query", "item"]).join(t.select("query", "truth"), "query")
    parts = parts.withColumn("s2", F.when((F.col("item") == F.col("truth")) & (F.col("query") % 3 != 0), 0.5).otherwise(0.25)).drop("truth")
    return _r(L.select_weights(parts, t.select("query", "truth"), GRID), "mrr")


@q(f"""WITH {_gn(_SHIP)}, {_MS}, x AS (SELECT DISTINCT graph_id, src_kind || '|' || kind || '|' || dst_kind AS x FROM ms), g AS (SELECT graph_id, list(x) AS xs FROM x GROUP BY graph_id)
SELECT a.graph_id AS a, b.graph_id AS b, len(list_intersect(a.xs, b.xs))::BIGINT AS shared, len(a.xs) - len(list_intersect(a.xs, b.xs)) AS unique_a, len(b.xs) - len(list_intersect(a.xs, b.xs)) AS unique_b FROM g a JOIN g b ON a.graph_id < b.graph_id""")
def fingerprint_distinctness(spark, d):
    nodes, edges = _order_graphs(spark, d, _SHIP)
    return G.typed_distinctness(G.typed_multiset(edges, nodes))


@q(f"WITH {GRAPH}, {_OWN}, m AS (SELECT signature, passage_id, date_lo, date_hi FROM (SELECT *, {_DATE} FROM ow) WHERE date_lo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY signature ORDER BY passage_id) <= 10) SELECT signature, list([date_lo, date_hi] ORDER BY passage_id) AS ranges FROM m GROUP BY signature")
def motif_ranges(spark, d):
    return D.motif_ranges(*_mined(spark, d), _dates(passages(spark, d).select("passage_id")))


@q(f"WITH {GRAPH}, {_OWN} SELECT signature, 'tradition' AS kind, tradition AS name, count(*) AS n FROM ow GROUP BY ALL UNION ALL SELECT signature, 'work', work, count(*) FROM ow GROUP BY ALL")
def motif_profile(spark, d):
    mined, p = _mined(spark, d), passages(spark, d)
    counts = [D.owner_counts(*mined, p, "passage_id", k).select("signature", F.lit(k).alias("kind"), F.col(k).alias("name"), "n") for k in ("tradition", "work")]
    return counts[0].unionByName(counts[1])


@q(f"WITH {GRAPH}, {_MO} {' UNION ALL '.join(f"SELECT '{t}' AS theme, signature FROM mo WHERE {w}" for t, w in _THEMES.items())}")
def motif_themes(spark, d):
    return D.themes(D.structural_family(_motifs(spark, d)))


_FU = f"{ANN}, u AS (SELECT passage_id, tradition, feature_id AS x FROM ann WHERE label = '1')"
_F23 = "fc AS (SELECT [a.x, b.x] AS signature, passage_id, a.tradition FROM u a JOIN u b USING (passage_id) WHERE a.x < b.x UNION ALL SELECT [a.x, b.x, c.x], passage_id, a.tradition FROM u a JOIN u b USING (passage_id) JOIN u c USING (passage_id) WHERE a.x < b.x AND b.x < c.x UNION ALL SELECT [a.x, b.x, c.x, e.x], passage_id, a.tradition FROM u a JOIN u b USING (passage_id) JOIN u c USING (passage_id) JOIN u e USING (passage_id) WHERE a.x < b.x AND b.x < c.x AND c.x < e.x)"
_FTOP = "ft AS (SELECT signature, count(*) AS support, row_number() OVER (ORDER BY count(*) DESC, len(signature), signature)::INT AS rank FROM fc GROUP BY signature HAVING count(*) >= 3 QUALIFY rank <= 100)"


def _feature_items(spark, d):
    return _pos(spark, d).groupBy("passage_id").agg(F.array_sort(F.collect_set("feature_id")).alias("signature"))


@q(f"WITH {_FU}, {_F23}, {_FTOP} SELECT signature, any_value(support) AS support, any_value(rank) AS rank, tradition, count(*) AS n FROM ft JOIN fc USING (signature) GROUP BY signature, tradition")
def feature_combo_counts(spark, d):
    items = written(_feature_items(spark, d))
    return D.top_sets(D.frequent_sets(items, "passage_id", 3, 4, longer=False), items, passages(spark, d), "tradition")


_FPS = "th AS (SELECT theory_id, list(feature_id) AS fs FROM fp WHERE t = 1 GROUP BY theory_id)"


@q(f"""WITH {_FU}, {FP}, {_FPS}, {_F23}, mo AS (SELECT signature, count(*) AS support FROM fc GROUP BY signature HAVING count(*) >= 3),
j AS (SELECT signature, support, theory_id, len(list_intersect(signature, fs)) / len(list_distinct(signature || fs)) AS j FROM mo, th QUALIFY row_number() OVER (PARTITION BY signature ORDER BY j DESC, theory_id) = 1)
SELECT signature, support, CASE WHEN j >= 0.25 THEN theory_id END AS nearest, CASE WHEN j < 0.25 THEN 'unrelated' WHEN len(list_filter(signature, lambda x: starts_with(x, 'Q'))) > 0 AND theory_id IN ('T1', 'T2') THEN 'quantum_specific'
WHEN len(list_filter(signature, lambda x: starts_with(x, 'F'))) > 0 OR theory_id = 'T3' THEN 'field_like' WHEN theory_id = 'T4' THEN 'classical' WHEN len(list_filter(signature, lambda x: starts_with(x, 'Q'))) > 0 THEN 'quantum_specific' ELSE 'classical' END AS family FROM j""")
def feature_combo_family(spark, d):
    theories = fingerprints(spark).filter("t = 1").groupBy("theory_id").agg(F.collect_list("feature_id").alias("features"))
    return D.physics_family(D.frequent_sets(_feature_items(spark, d), "passage_id", 3, 4, longer=False), theories, ("T1", "T2"), ("T3",), ("T4",))


QUERIES, ORACLE_SQL = q.queries, q.sql
