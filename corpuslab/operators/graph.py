"""Concept graphs: from features or from text, as node and edge tables, and similarities between them.

Nodes are (graph_id, id, kind, label), edges (graph_id, source, target, kind).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import ENTITY_FAMILIES, FEATURE_GRAPH, RELATION_PHRASES
from ..functions import text as T
from ..sources.scratch import written


def _elements(positives: DataFrame, mapping: Mapping) -> DataFrame:
    spark = positives.sparkSession
    rows = [(f, list(nodes), list(edge) if edge else None) for f, (nodes, edge) in mapping.items()]
    dim = spark.createDataFrame(rows, "feature_id string, nodes array<string>, edge array<string>")
    return positives.filter("trim(evidence) <> ''").join(F.broadcast(dim), "feature_id")


def feature_nodes(positives: DataFrame, mapping: Mapping = FEATURE_GRAPH) -> DataFrame:
    """(passage_id, node_type, features, evidence): one node of each type, its evidence joined up to 500 characters."""
    rows = _elements(positives, mapping).select("passage_id", "feature_id", "evidence", F.explode(F.array_distinct("nodes")).alias("node_type"))
    out = rows.groupBy("passage_id", "node_type").agg(F.sort_array(F.collect_set(F.struct("feature_id", "evidence"))).alias("f"))
    return out.select("passage_id", "node_type", F.transform("f", lambda x: x.feature_id).alias("features"), F.substring(F.array_join(F.transform("f", lambda x: x.evidence), " | "), 1, 500).alias("evidence"))


def feature_edges(positives: DataFrame, mapping: Mapping = FEATURE_GRAPH) -> DataFrame:
    """(passage_id, edge_no, source, edge_type, target, feature_id), numbered from 0 by feature."""
    rows = _elements(positives, mapping).filter("edge IS NOT NULL")
    no = F.row_number().over(W.partitionBy("passage_id").orderBy("feature_id")) - 1
    return rows.select("passage_id", no.alias("edge_no"), F.col("edge")[0].alias("source"), F.col("edge")[1].alias("edge_type"), F.col("edge")[2].alias("target"), "feature_id")


def signatures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(passage_id, signature): the sorted set of N:type and E:type."""
    items = nodes.select("passage_id", F.concat(F.lit("N:"), "node_type").alias("x")).unionByName(edges.select("passage_id", F.concat(F.lit("E:"), "edge_type").alias("x")))
    return items.groupBy("passage_id").agg(F.array_sort(F.collect_set("x")).alias("signature"))


def feature_signatures(positives: DataFrame, mapping: Mapping = FEATURE_GRAPH) -> DataFrame:
    """The signatures of the graphs of features, in one pass over the positive annotations."""
    rows = _elements(positives, mapping)
    named = F.transform("nodes", lambda n: F.concat(F.lit("N:"), n))
    items = F.when(F.col("edge").isNull(), named).otherwise(F.concat(named, F.array(F.concat(F.lit("E:"), F.col("edge")[1]))))
    return rows.select("passage_id", F.explode(items).alias("x")).groupBy("passage_id").agg(F.array_sort(F.collect_set("x")).alias("signature"))


def node_id(surface: Column, role: Column) -> Column:
    return F.concat(F.lit("n_"), F.substring(F.sha1(F.concat_ws(":", role, F.lower(surface)).cast("binary")), 1, 10))


def _sentences(passages: DataFrame) -> DataFrame:
    rows = passages.select("passage_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))
    return rows.withColumn("sentence", F.trim("sentence")).filter(F.length("sentence") > 5)


def extract_entities(passages: DataFrame, families: Sequence = ENTITY_FAMILIES) -> DataFrame:
    """(passage_id, node_id, role, kind, surface, mentions) of the words of each family, within sentences."""
    found = F.explode(F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.regexp_extract_all("sentence", F.lit(f"(?iu){p}"), F.lit(1)).alias("hits")) for role, kind, p in families
    ])).alias("f")
    rows = _sentences(passages).select("passage_id", found).select("passage_id", "f.role", "f.kind", F.explode("f.hits").alias("surface"))
    rows = rows.withColumn("surface", F.lower("surface"))
    return rows.groupBy("passage_id", node_id(F.col("surface"), F.col("role")).alias("node_id"), "role", "kind", "surface").agg(F.count("*").alias("mentions"))


def extract_relations(passages: DataFrame, phrases: Sequence = RELATION_PHRASES, families: Sequence = ENTITY_FAMILIES) -> DataFrame:
    """(passage_id, source, relation, target, source_word, target_word, confidence); ends that are the same go."""
    word = r"([A-Za-z][\w\-]*)"
    found = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("relation"), F.lit(conf).alias("confidence"), F.arrays_zip(
            F.regexp_extract_all("sentence", F.lit(f"(?i){word}{p}{word}"), F.lit(1)).alias("a"), F.regexp_extract_all("sentence", F.lit(f"(?i){word}{p}{word}"), F.lit(2)).alias("b")).alias("ends"))
        for p, kind, conf in phrases
    ])).alias("f")
    rows = _sentences(passages).select("passage_id", found).select("passage_id", "f.relation", "f.confidence", F.explode("f.ends").alias("e"))
    rows = rows.select("passage_id", "relation", "confidence", F.lower("e.a").alias("source_word"), F.lower("e.b").alias("target_word"))
    role = lambda w: F.coalesce(*[F.when(F.col(w).rlike(f"(?iu){p}"), F.lit(r)) for r, _, p in families], F.lit("entity"))
    rows = rows.withColumns({"source": node_id(F.col("source_word"), role("source_word")), "target": node_id(F.col("target_word"), role("target_word"))})
    return rows.filter("source <> target")


def valid_edges(edges: DataFrame, nodes: DataFrame, kinds: Sequence[str], default: str) -> DataFrame:
    """Edges both of whose ends are nodes of their graph; a kind that is not known becomes the default."""
    ids = nodes.select("graph_id", "id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "source"), ["graph_id", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["graph_id", "target"], "left_semi")
    return out.withColumn("kind", F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(default))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, source, target, kind, missing) of edges with an end that is no node; both ends give two rows."""
    ids = nodes.select("graph_id", "id").distinct()
    side = lambda c: edges.join(ids.withColumnRenamed("id", c), ["graph_id", c], "left_anti").select("graph_id", "source", "target", "kind", F.lit(c).alias("missing"))
    return side("source").unionByName(side("target"))


def lexical_proxy(passages: DataFrame, labels: DataFrame, limit: int = 20) -> DataFrame:
    """(passage_id, n, label, next_label): the first labels, by name, that the text holds, chained. labels is small."""
    hits = passages.select("passage_id", F.lower("text").alias("__low")).join(F.broadcast(labels.select("label").distinct()), F.contains("__low", F.lower("label")))
    w = W.partitionBy("passage_id").orderBy("label")
    out = hits.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)
    return out.select("passage_id", "n", "label", F.lead("label").over(w).alias("next_label"))


def typed_multiset(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, src_kind, kind, dst_kind, n); an end that is no node has the kind UNKNOWN."""
    k = nodes.select("graph_id", "id", F.col("kind").alias("k")).dropDuplicates(["graph_id", "id"])
    out = edges.join(k.select("graph_id", F.col("id").alias("source"), F.col("k").alias("sk")), ["graph_id", "source"], "left")
    out = out.join(k.select("graph_id", F.col("id").alias("target"), F.col("k").alias("dk")), ["graph_id", "target"], "left")
    unknown = lambda c: F.coalesce(c, F.lit("UNKNOWN"))
    return out.groupBy("graph_id", unknown("sk").alias("src_kind"), "kind", unknown("dk").alias("dst_kind")).agg(F.count("*").alias("n"))


def typed_multiset_small(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """typed_multiset of many small graphs: each is one row for a moment, and no edge is joined with its nodes.

    Where edges and nodes are dealt by graph_id already, nothing is shuffled.
    """
    k = nodes.filter("id IS NOT NULL").groupBy("graph_id", "id").agg(F.first("kind").alias("k")).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "k"))).alias("k"))
    e = edges.groupBy("graph_id").agg(F.collect_list(F.struct("source", "kind", "target")).alias("e"))
    of = lambda end: F.coalesce(F.try_element_at("k", end), F.lit("UNKNOWN"))
    x = F.explode(F.transform("e", lambda e: F.struct(of(e.source).alias("src_kind"), e.kind.alias("kind"), of(e.target).alias("dst_kind")))).alias("x")
    return e.join(k, "graph_id", "left").select("graph_id", x).groupBy("graph_id", "x.src_kind", "x.kind", "x.dst_kind").agg(F.count("*").alias("n"))


def typed_similarity(left: DataFrame, right: DataFrame, sizes_left: DataFrame, sizes_right: DataFrame) -> DataFrame:
    """(a, b, raw, adjusted) of every left graph with every right one: the right side is the templates, or the same table.

    raw is the multiset Jaccard of typed relations (1 if both are empty); adjusted multiplies the ratios of the
    numbers of nodes and of edges (sizes: graph_id, n_nodes, n_edges), the smaller over the larger.
    """
    key = ["src_kind", "kind", "dst_kind"]

    def graphs(rows: DataFrame, sizes: DataFrame, s: str) -> DataFrame:
        known = rows.dropna(subset=key).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct(F.to_json(F.struct(*key)), "n"))).alias("m"))
        return sizes.join(known, "graph_id", "left").select(F.col("graph_id").alias(s), F.col("m").alias(f"{s}m"), F.col("n_nodes").alias(f"{s}n"), F.col("n_edges").alias(f"{s}e"))

    # a pair is one row from the first: its relations are not joined; the right side is written, as each task reads it whole
    pairs = graphs(left, sizes_left, "a").withColumn("am", F.map_entries("am")).crossJoin(written(graphs(right, sizes_right, "b")))
    zero = F.lit(0).cast("bigint")
    inter = F.aggregate("am", zero, lambda s, x: s + F.least(x.value, F.coalesce(F.try_element_at("bm", x.key), zero)))
    out = pairs.withColumn("inter", F.coalesce(inter, zero))
    raw = F.coalesce(F.try_divide(F.col("inter"), F.col("ae") + F.col("be") - F.col("inter")), F.lit(1.0))
    ratio = lambda x, y: F.coalesce(F.try_divide(F.least(x, y), F.greatest(x, y)), F.lit(1.0))
    out = out.select("a", "b", "an", "bn", "ae", "be", raw.alias("raw"))
    return out.select("a", "b", "raw", (F.col("raw") * ratio("an", "bn") * ratio("ae", "be")).alias("adjusted"))


def node_profiles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, kind, hist): how many edges of each kind go out ('>kind') and come in ('<kind')."""
    h = edges.select("graph_id", F.col("source").alias("id"), F.concat(F.lit(">"), "kind").alias("k")).unionByName(edges.select("graph_id", F.col("target").alias("id"), F.concat(F.lit("<"), "kind").alias("k")))
    h = h.groupBy("graph_id", "id", "k").agg(F.count("*").alias("n")).groupBy("graph_id", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("hist"))
    return nodes.select("graph_id", "id", "kind").join(h, ["graph_id", "id"], "left").withColumn("hist", F.coalesce("hist", F.create_map().cast("map<string,bigint>")))


def _distance(p: tuple, q: tuple) -> float:
    """node_distances of two profiles (kind, hist)."""
    (a, x), (b, y) = p, q
    l1 = sum(abs(x.get(k, 0) - y.get(k, 0)) for k in x.keys() | y.keys())
    return (a is None or a != b) + l1 / (2.0 * max(1, sum(x.values()) + sum(y.values())))


def node_distances(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, a_id, b, b_id, distance) of all node pairs: 1 for another kind, plus the normalised L1 of the histograms.

    right is a small set of templates. Distances are found once for each profile of left nodes, however many have it.
    """
    flat = F.to_json(F.struct("kind", F.sort_array(F.transform(F.map_entries("hist"), lambda e: F.struct(e.key.alias("key"), e.value.alias("value"))))))
    rows = left.select(F.col("graph_id").alias("a"), F.col("id").alias("a_id"), F.col("kind").alias("a_kind"), F.col("hist").alias("ah"), flat.alias("profile"))
    r = right.select(F.col("graph_id").alias("b"), F.col("id").alias("b_id"), F.col("kind").alias("b_kind"), F.col("hist").alias("bh"))
    pairs = rows.groupBy("profile").agg(F.first("a_kind").alias("a_kind"), F.first("ah").alias("ah")).crossJoin(F.broadcast(r))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda s, v: s + v)
    keys = F.array_union(F.map_keys("ah"), F.map_keys("bh"))
    get = lambda m, k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(0).cast("bigint"))
    l1 = F.aggregate(keys, F.lit(0).cast("bigint"), lambda s, k: s + F.abs(get("ah", k) - get("bh", k)))
    hist = l1 / (2.0 * F.greatest(F.lit(1).cast("bigint"), total("ah") + total("bh")))
    distance = F.when(F.col("a_kind") == F.col("b_kind"), 0.0).otherwise(1.0) + hist
    found = written(pairs.groupBy("profile").agg(F.collect_list(F.struct("b", "b_id", distance.alias("distance"))).alias("x")))
    return rows.select("a", "a_id", "profile").join(found, "profile").select("a", "a_id", F.explode("x").alias("x")).select("a", "a_id", "x.b", "x.b_id", "x.distance")


def assignments(cost: np.ndarray) -> np.ndarray:
    """The column of each row of each square matrix (matrix, row, column), at the least total cost of each, by shortest
    augmenting paths in O(n^3); the matrices go in step."""
    m, n = cost.shape[:2]
    all_ = np.arange(m)
    row_pot, col_pot = np.zeros((m, n + 1)), np.zeros((m, n + 1))
    match, way = np.zeros((m, n + 1), int), np.zeros((m, n + 1), int)
    for i in range(1, n + 1):
        match[:, 0] = i
        j0, at = np.zeros(m, int), all_  # the matrices that still look for a free column
        least, done = np.full((m, n + 1), np.inf), np.zeros((m, n + 1), bool)
        while len(at):
            j = j0[at]
            done[at, j] = True
            i0 = match[at, j]
            free = ~done[at, 1:]
            reduced = cost[at, i0 - 1] - row_pot[at, i0][:, None] - col_pot[at, 1:]
            own, back = least[at, 1:], way[at, 1:]
            better = free & (reduced < own)
            own, back = np.where(better, reduced, own), np.where(better, j[:, None], back)
            j1 = 1 + np.where(free, own, np.inf).argmin(1)
            step = own[np.arange(len(at)), j1 - 1][:, None]
            k, col = np.nonzero(done[at])
            row_pot[at[k], match[at[k], col]] += step[k, 0]
            col_pot[at] -= np.where(done[at], step, 0)
            least[at, 1:], way[at, 1:] = np.where(free, own - step, own), back
            j0[at] = j1
            at = at[match[at, j1] != 0]
        at = all_
        while len(at):
            j = j0[at]
            match[at, j] = match[at, way[at, j]]
            j0[at] = way[at, j]
            at = at[j0[at] != 0]
    out = np.zeros((m, n), int)
    for j in range(1, n + 1):
        out[all_, match[:, j] - 1] = j - 1
    return out


def assignment(cost: np.ndarray) -> list[int]:
    """The column of each row of a square matrix, at the least total cost."""
    return assignments(np.asarray(cost, float)[None])[0].tolist()


def profile_classes(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of node profiles: classes (class_id, nodes array of (kind, hist, n)) of equal multisets of
    profiles, and members (graph_id, class_id). What depends on profiles alone is found once for each class."""
    flat = F.sort_array(F.transform(F.map_entries("hist"), lambda e: F.struct(e.key.alias("key"), e.value.alias("value"))))
    rows = profiles.groupBy("graph_id", "kind", flat.alias("hist")).agg(F.count("*").alias("n"))
    own = rows.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("kind", "hist", "n"))).alias("nodes"))
    own = written(own.withColumn("class_id", F.sha2(F.to_json(F.struct("nodes")), 256)))
    return own.groupBy("class_id").agg(F.first("nodes").alias("nodes")), own.select("graph_id", "class_id")


def alignment(distances: DataFrame, pad: float = 3.0) -> DataFrame:
    """(a, b, alignment) of pairs of graphs: the best assignment of their nodes, quality times coverage.

    One row holds the node pairs of one passage graph and one template, both small.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pairs in pdf["pairs"]:
                rows, cols = ({k: i for i, k in enumerate(dict.fromkeys(p[c] for p in pairs))} for c in ("a_id", "b_id"))
                n = max(len(rows), len(cols))
                cost = np.full((n, n), pad)
                for p in pairs:
                    cost[rows[p["a_id"]], cols[p["b_id"]]] = p["distance"]
                hit = [cost[i, j] for i, j in enumerate(assignment(cost)) if i < len(rows) and j < len(cols)]
                out.append(max(0.0, 1 - sum(hit) / len(hit) / 2) * len(hit) / n)
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "alignment": out})

    schema = f"a {distances.schema['a'].dataType.simpleString()}, b {distances.schema['b'].dataType.simpleString()}, alignment double"
    pairs = F.sort_array(F.collect_list(F.struct("a_id", "b_id", "distance"))).alias("pairs")
    return distances.groupBy("a", "b").agg(pairs).mapInPandas(solve, schema)


#: Numbers of the cost matrices that are solved in step.
SOLVED = 1 << 20


def profile_alignment(left: DataFrame, right: DataFrame, pad: float = 3.0) -> DataFrame:
    """(a, b, alignment) of every left graph with every right one, of node profiles: the best assignment of their nodes
    at node_distances, quality times coverage. right is a small set of templates.

    Graphs whose nodes have equal profiles are one class, which is aligned once; a row holds the nodes of one class.
    """
    classes, members = profile_classes(left)
    templates, own = profile_classes(right)

    def nodes(held) -> tuple[list, np.ndarray]:
        return [(x["kind"], {e["key"]: e["value"] for e in x["hist"]}) for x in held], np.array([x["n"] for x in held])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, sized = [0.0] * len(pdf), {}
            for place, (x, y) in enumerate(zip(pdf["nodes"], pdf["others"], strict=True)):
                (x, nx), (y, ny) = nodes(x), nodes(y)
                cost = np.repeat(np.repeat(np.array([[_distance(p, q) for q in y] for p in x]), nx, 0), ny, 1)
                sized.setdefault(max(cost.shape), []).append((place, cost))
            for n, group in sized.items():
                step = max(1, SOLVED // (n * n))
                for at in range(0, len(group), step):
                    part = group[at : at + step]
                    square = np.full((len(part), n, n), pad)
                    for k, (_, cost) in enumerate(part):
                        square[k, : cost.shape[0], : cost.shape[1]] = cost
                    for (place, cost), found, full in zip(part, assignments(square), square, strict=True):
                        hits = min(cost.shape)  # all of the smaller side
                        hit = sum(full[i, j] for i, j in enumerate(found) if i < cost.shape[0] and j < cost.shape[1])
                        out[place] = max(0.0, 1 - hit / hits / 2) * hits / n
            yield pd.DataFrame({"class_id": pdf["class_id"], "other_id": pdf["other_id"], "alignment": out})

    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = classes.repartition(n, "class_id").crossJoin(F.broadcast(templates.select(F.col("class_id").alias("other_id"), F.col("nodes").alias("others"))))
    solved = pairs.mapInPandas(solve, "class_id string, other_id string, alignment double")
    solved = solved.join(F.broadcast(own.select(F.col("graph_id").alias("b"), F.col("class_id").alias("other_id"))), "other_id")
    return members.join(solved, "class_id").select(F.col("graph_id").alias("a"), "b", "alignment")


def retrieval_scores(typed: DataFrame, aligned: DataFrame, typed_weight: float, aligned_weight: float) -> DataFrame:
    """(a, b, score): the weighted sum of adjusted typed similarity and alignment; a missing part is 0."""
    out = typed.join(aligned, ["a", "b"], "left")
    return out.select("a", "b", (typed_weight * F.coalesce("adjusted", F.lit(0.0)) + aligned_weight * F.coalesce("alignment", F.lit(0.0))).alias("score"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(left: DataFrame, right: DataFrame, edge_weight: float = 0.7) -> DataFrame:
    """(a, b, score) of (graph_id, edges array, nodes array): weighted edge-set and node-set Jaccard. right is small."""
    sets = lambda df, s: df.select(F.col("graph_id").alias(s), *[F.array_distinct(c).alias(c[0] + s) for c in ("edges", "nodes")])
    pairs = sets(left, "a").crossJoin(written(sets(right, "b")))
    # the union is counted from the sizes, and not built
    pairs = pairs.withColumns({c: F.size(F.array_intersect(f"{c}a", f"{c}b")) for c in "en"})
    same = lambda c: F.coalesce(F.try_divide(F.col(c), F.size(f"{c}a") + F.size(f"{c}b") - F.col(c)), F.lit(0.0))
    return pairs.select("a", "b", (edge_weight * same("e") + (1 - edge_weight) * same("n")).alias("score"))


def typed_distinctness(multisets: DataFrame, keys: Sequence[str] = ("src_kind", "kind", "dst_kind")) -> DataFrame:
    """(a, b, shared, unique_a, unique_b) of each pair a < b of graphs: how many typed relations both have, or one alone.

    Fingerprint graphs are few; only the shared relations of a pair are joined.
    """
    items = multisets.select("graph_id", F.struct(*keys).alias("x")).distinct()
    size = items.groupBy("graph_id").agg(F.count("*").alias("n"))
    both = items.withColumnRenamed("graph_id", "a").join(items.withColumnRenamed("graph_id", "b"), "x").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = size.select(F.col("graph_id").alias("a"), F.col("n").alias("na")).join(size.select(F.col("graph_id").alias("b"), F.col("n").alias("nb")), F.expr("a < b"))
    shared = F.coalesce("shared", F.lit(0))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", shared.alias("shared"), (F.col("na") - shared).alias("unique_a"), (F.col("nb") - shared).alias("unique_b"))
