"""Discovery over graph signatures: motifs, enrichment, surprisal, first appearances, atlas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .stats import exact_quantiles


def frequent_sets(items: DataFrame, key: str, min_support: int, max_size: int = 6, longer: bool = True) -> DataFrame:
    """(signature, support) of the item sets of size 2..max_size that at least min_support keys hold, and, with
    ``longer``, of the longer signatures that at least min_support keys have as they are.

    items: (key, signature sorted array). Equal signatures are one row with their number of keys, so that level tables
    hold a row for each different signature and set, whatever the keys. Level by level, only frequent sets grow, each by
    a frequent item that comes after its last one, so that no set is made twice.
    """
    distinct = written(items.groupBy("signature").agg(F.count("*").alias("keys")).withColumn("s", F.monotonically_increasing_id()))
    rows = distinct.select("s", "keys", F.explode(F.array_distinct("signature")).alias("item"))
    good = rows.groupBy("item").agg(F.sum("keys").alias("n")).filter(F.col("n") >= min_support).select("item")
    own = rows.join(good, "item").groupBy("s", "keys").agg(F.array_sort(F.collect_set("item")).alias("own"))
    level = own.select("keys", "own", F.explode("own").alias("x")).select("keys", "own", F.array("x").alias("signature"))
    found = []
    for _ in range(2, max_size + 1):
        grown = level.select("keys", "own", "signature", F.explode(F.filter("own", lambda x: x > F.element_at("signature", -1))).alias("x"))
        grown = written(grown.select("keys", "own", F.array_append("signature", F.col("x")).alias("signature")))
        counts = written(grown.groupBy("signature").agg(F.sum("keys").alias("support")).filter(F.col("support") >= min_support))
        found.append(counts)
        level = grown.join(counts.select("signature"), "signature", "left_semi")
    if longer:
        found.append(distinct.filter((F.size("signature") > max_size) & (F.col("keys") >= min_support)).select("signature", F.col("keys").alias("support")))
    return reduce(DataFrame.unionByName, found)


def _holders(sets: DataFrame, signatures: DataFrame) -> DataFrame:
    """(signature, own) of the sets and the different signatures that hold them whole: met by each set's rarest item."""
    owns = written(signatures.select(F.col("signature").alias("own")).distinct())
    items = owns.select("own", F.explode(F.array_distinct("own")).alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("f"))
    rare = sets.select("signature", F.explode("signature").alias("item")).join(often, "item").groupBy("signature").agg(F.min_by("item", F.struct("f", "item")).alias("item"))
    return rare.join(items, "item").filter(F.size(F.array_except("signature", "own")) == 0).select("signature", "own")


def owners(sets: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(signature, key) for each key whose own signature holds the whole set; only different signatures are compared."""
    return _holders(sets, items).join(items.select(key, F.col("signature").alias("own")), "own").select("signature", key)


def owner_counts(sets: DataFrame, items: DataFrame, meta: DataFrame, key: str, by: str) -> DataFrame:
    """(signature, by, n): the keys that own each set, by group. Keys are counted by their own signature first, so that
    no row is made for each key and set."""
    own = items.select(key, F.col("signature").alias("own")).join(meta.select(key, by), key).groupBy("own", by).agg(F.count("*").alias("n"))
    return _holders(sets, items).join(own, "own").groupBy("signature", by).agg(F.sum("n").alias("n"))


def structural_family(sets: DataFrame) -> DataFrame:
    """Add family: what the node and edge types of a signature look like, by the first rule that holds."""
    has = lambda *xs: F.arrays_overlap("signature", F.array(*[F.lit(x) for x in xs]))
    family = (
        F.when(has("N:substrate", "N:disturbance", "N:space") & has("E:pervades", "E:propagates_through", "E:manifests_as"), "field_like")
        .when(has("E:cannot_be_reduced_to") & has("N:whole"), "unknown")
        .when(has("N:matter", "N:motion", "N:cause", "N:effect"), "classical")
        .otherwise("unrelated")
    )
    return sets.withColumn("family", family)


def physics_family(sets: DataFrame, fingerprints: DataFrame, quantum: Sequence[str], field_like: Sequence[str], classical: Sequence[str], least: float = 0.25) -> DataFrame:
    """Add nearest and family to sets of node types, edge types and feature ids.

    The features of a set are compared with each theory's active ones (theory_id, features), a table of few rows: the
    nearest theory is the one of highest Jaccard similarity, ties by name. If that is at least ``least``, the kinds of
    features and theory decide the family; else the structure does, as in structural_family, and nearest is null.
    """
    own = F.filter("signature", lambda x: ~x.rlike("^[NE]:"))
    near = F.transform("__theories", lambda t: F.struct((F.size(F.array_intersect(own, t.features)) / F.greatest(F.size(F.array_union(own, t.features)), F.lit(1))).alias("j"), t.theory_id.alias("theory_id")))
    best = F.array_sort(near, lambda a, b: F.when(a.j > b.j, -1).when(a.j < b.j, 1).when(a.theory_id < b.theory_id, -1).otherwise(1))[0]
    all_ = fingerprints.agg(F.collect_list(F.struct("theory_id", "features")).alias("__theories"))
    out = structural_family(sets).crossJoin(F.broadcast(all_)).withColumn("__best", best)
    has = lambda letter: F.exists(own, lambda x: F.startswith(x, F.lit(letter)))
    name = F.col("__best.theory_id")
    by_features = (
        F.when(has("Q") & name.isin(*quantum), "quantum_specific").when(has("F") | name.isin(*field_like), "field_like")
        .when(name.isin(*classical), "classical").otherwise(F.when(has("Q"), "quantum_specific").otherwise("classical"))
    )
    near_enough = F.col("__best.j") >= least
    return out.withColumn("nearest", F.when(near_enough, name)).withColumn("family", F.when(near_enough, by_features).otherwise(F.col("family"))).drop("__theories", "__best")


def enrichment(counts: DataFrame, totals: DataFrame, target: Sequence[str], control: Sequence[str], by: str) -> DataFrame:
    """(signature, n_target, n_control, enrichment, infinite, lo, hi) from (signature, by, n) and totals (by, n)."""
    side = lambda ids, c: F.coalesce(F.sum(F.when(F.col(by).isin(*ids), F.col(c))), F.lit(0))
    all_ = totals.agg(side(target, "n").alias("nt"), side(control, "n").alias("nc"))
    out = counts.groupBy("signature").agg(side(target, "n").alias("n_target"), side(control, "n").alias("n_control")).crossJoin(F.broadcast(all_))
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    pt, pc = F.col("n_target") / one("nt"), F.col("n_control") / one("nc")
    ratio = F.when((F.col("n_target") == 0) & (F.col("n_control") == 0), 1.0).when((F.col("n_control") == 0) & (F.col("n_target") > 0), None).when(F.col("n_control") == 0, 1.0).otherwise(F.try_divide(pt, pc))
    se = F.sqrt((1 / one("n_target") - 1 / one("nt")) + (1 / one("n_control") - 1 / one("nc")))
    log = F.when(F.col("enrichment") > 0, F.ln("enrichment")).otherwise(0.0)
    ci = F.col("n_control") > 0
    out = out.withColumn("enrichment", ratio).withColumn("infinite", (F.col("n_control") == 0) & (F.col("n_target") > 0))
    return out.select("signature", "n_target", "n_control", "enrichment", "infinite", F.when(ci, F.exp(log - 1.96 * se)).alias("lo"), F.when(ci, F.exp(log + 1.96 * se)).alias("hi"))


def rank_motifs(motifs: DataFrame) -> DataFrame:
    """Add rank_score and rank to (signature, support, enrichment, infinite, n_works, family): six weighted terms.

    An infinite enrichment counts as its cap. Mined motifs are few: their order is taken in one task.
    """
    cap = lambda c, m: F.least(c / m, F.lit(1.0))
    specific = F.when(F.col("family").isin("quantum_specific", "field_like"), 1.0).when(F.col("family") == "unrelated", 0.2).otherwise(0.4)
    e = F.when(F.col("infinite"), 5.0).otherwise(F.coalesce("enrichment", F.lit(0.0)))
    score = 0.25 * cap(e, 5.0) + 0.2 * cap(F.col("n_works"), 5.0) + 0.15 * cap(F.col("support"), 20.0) + 0.15 * specific + 0.1 * F.when(F.col("family") == "field_like", 1.0).otherwise(0.5) + 0.15 * 0.5
    out = motifs.withColumn("rank_score", F.round(score, 9))
    return out.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("rank_score"), F.size("signature"), "signature")))


def surprisal(signatures: DataFrame, background: DataFrame, meta: DataFrame, floor: float = 1e-12) -> DataFrame:
    """(passage_id, surprisal, flags, status): -ln of the smoothed probability of a signature's items.

    background: signatures that items are counted in; meta: (passage_id, n_chars). The item counts are few.
    """
    counts = background.select(F.explode("signature").alias("item")).groupBy("item").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"), F.count("*").alias("v"))
    rows = signatures.select("passage_id", "signature", F.explode("signature").alias("item")).join(F.broadcast(counts), "item", "left").crossJoin(F.broadcast(total))
    p = F.ln((F.coalesce("c", F.lit(0)) + 1) / (F.col("t") + F.col("v")))
    out = rows.groupBy("passage_id", "signature").agg(F.least(-F.sum(p), F.lit(-1.0) * F.ln(F.lit(floor))).alias("surprisal"))
    same = signatures.groupBy("signature").agg(F.count("*").alias("same"))
    out = out.join(same, "signature").join(meta, "passage_id")
    flag = lambda cond, name: F.when(cond, F.lit(name))
    n_nodes = F.size(F.filter("signature", lambda x: F.startswith(x, F.lit("N:"))))
    flags = F.array(flag(F.col("n_chars") < 40, "very_short"), flag(F.col("n_chars") > 4000, "very_long"), flag((n_nodes <= 1) & (n_nodes == F.size("signature")), "sparse_graph"), flag(F.col("same") >= 5, "duplicate_cluster"))
    out = out.withColumn("flags", F.filter(flags, lambda x: x.isNotNull()))
    out = written(out)
    cut = exact_quantiles(out.select(F.round("surprisal", 9).alias("s")), "s", [0.95])[0]
    status = F.when(F.size("flags") > 0, "ARTIFACT_SUSPECTED").when(F.round("surprisal", 9) >= F.lit(cut), "ANOMALY_CANDIDATE").otherwise("TYPICAL")
    return out.select("passage_id", "surprisal", "flags", status.alias("status"))


def first_appearance(features: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, first_mid, first_id, width) from rows with date_lo, date_hi and passage_id: the earliest midpoint."""
    rows = features.withColumns({"mid": (F.col("date_lo") + F.col("date_hi")) / 2, "width": F.col("date_hi") - F.col("date_lo")}).filter("mid IS NOT NULL")
    first = F.min(F.struct("mid", "passage_id", "width")).alias("f")
    return rows.groupBy(*by).agg(first).select(*by, F.col("f.mid").alias("first_mid"), F.col("f.passage_id").alias("first_id"), F.col("f.width").alias("width"))


def feature_pairs(features: DataFrame) -> DataFrame:
    """Rows for each pair f1 < f2 of a passage's features; the other columns are those of the passage."""
    rest = [c for c in features.columns if c not in ("passage_id", "feature_id")]
    left = features.withColumnRenamed("feature_id", "f1")
    right = features.select("passage_id", F.col("feature_id").alias("f2"))
    return left.join(right, "passage_id").filter("f1 < f2").select("passage_id", "f1", "f2", *rest)


def motif_dates(sets: DataFrame, items: DataFrame, dates: DataFrame) -> DataFrame:
    """(signature, n_dated, earliest, latest, middle, status): of the midpoints of its owners; middle is the upper median.

    Equal midpoints of equal signatures are one row with their number, and no set's midpoints are in one array.
    """
    own = items.select("passage_id", F.col("signature").alias("own")).join(dates, "passage_id", "left")
    own = own.groupBy("own", ((F.col("date_lo") + F.col("date_hi")) / 2).alias("mid")).agg(F.count("*").alias("n"))
    rows = _holders(sets, items).join(own, "own").groupBy("signature", "mid").agg(F.sum(F.when(F.col("mid").isNull(), 0).otherwise(F.col("n"))).alias("n"))
    total = rows.groupBy("signature").agg(F.sum("n").alias("n_dated"), F.min("mid").alias("earliest"), F.max("mid").alias("latest"))
    upto = F.sum("n").over(W.partitionBy("signature").orderBy(F.col("mid").asc_nulls_last()))
    rows = rows.withColumn("upto", upto).join(total.select("signature", "n_dated"), "signature").filter(F.col("upto") > F.floor(F.col("n_dated") / 2))
    middle = rows.groupBy("signature").agg(F.min("mid").alias("middle"))
    out = total.join(middle, "signature", "left")
    return out.select("signature", "n_dated", "earliest", "latest", "middle", F.when(F.col("n_dated") > 0, "dated").otherwise("undated").alias("status"))


def motif_ranges(sets: DataFrame, items: DataFrame, dates: DataFrame, n: int = 10) -> DataFrame:
    """(signature, ranges): the date ranges (date_lo, date_hi) of the first n dated owners, in the order of their ids.

    Of equal signatures only the first n dated ones are asked for.
    """
    first = lambda by: F.row_number().over(W.partitionBy(by).orderBy("passage_id"))
    rows = items.select("passage_id", F.col("signature").alias("own")).join(dates, "passage_id").filter("date_lo IS NOT NULL AND date_hi IS NOT NULL")
    rows = rows.withColumn("r", first("own")).filter(F.col("r") <= n).drop("r")
    rows = _holders(sets, items).join(rows, "own").withColumn("r", first("signature")).filter(F.col("r") <= n)
    ranges = F.array_sort(F.collect_list(F.struct("passage_id", "date_lo", "date_hi")))
    return rows.groupBy("signature").agg(F.transform(ranges, lambda x: F.array(x.date_lo, x.date_hi)).alias("ranges"))


def themes(motifs: DataFrame) -> DataFrame:
    """(theme, signature) of (signature, family): the motifs that are field-like, atomistic, relational, about observers or
    quantum-specific; one may be in several themes."""
    has = lambda *xs: F.arrays_overlap("signature", F.array(*[F.lit(x) for x in xs]))
    of = {
        "field_like": F.col("family") == "field_like", "atomistic": has("N:constituent", "N:matter"), "relational": F.exists("signature", lambda x: F.startswith(x, F.lit("E:"))),
        "observer": has("N:observer"), "quantum_specific": F.col("family") == "quantum_specific",
    }
    held = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in of.items()]), lambda x: x.isNotNull())
    return motifs.select(F.explode(held).alias("theme"), "signature")


def top_sets(sets: DataFrame, items: DataFrame, meta: DataFrame, by: str, n: int = 100, key: str = "passage_id") -> DataFrame:
    """(signature, support, rank, by, n): the n sets of highest support, ties by size and items, with their owners by group."""
    best = sets.orderBy(F.desc("support"), F.size("signature"), "signature").limit(n)
    best = written(best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("support"), F.size("signature"), "signature"))))
    return best.join(owner_counts(best, items, meta, key, by), "signature").select("signature", "support", "rank", by, "n")


def atlas(motifs: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """(by, signature, n, n_groups, scope, themes, n_motifs, n_unique, n_shared): a row for each group and each motif that it holds.

    motifs: (signature, family); counts: (signature, by, n), the owners of each motif in each group. scope is 'unique' for a
    motif of this group alone, and 'shared' for one of n_groups; themes are those of ``themes``, sorted, and may be none. The
    last three count the group's motifs.
    """
    held = themes(motifs).groupBy("signature").agg(F.sort_array(F.collect_list("theme")).alias("themes"))
    spread = counts.groupBy("signature").agg(F.count("*").alias("n_groups"))
    rows = written(counts.join(spread, "signature").join(held, "signature", "left"))
    # a null group is a group too
    own = F.struct(by).alias("own")
    of = rows.groupBy(own).agg(F.count("*").alias("n_motifs"), F.count_if(F.col("n_groups") == 1).alias("n_unique"), F.count_if(F.col("n_groups") > 1).alias("n_shared"))
    scope = F.when(F.col("n_groups") == 1, "unique").otherwise("shared").alias("scope")
    out = rows.withColumn("own", own).join(of, "own")
    return out.select(by, "signature", "n", "n_groups", scope, F.coalesce("themes", F.array().cast("array<string>")).alias("themes"), "n_motifs", "n_unique", "n_shared")


def replication(motifs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(signature, exact, recovered): is it a whole signature of the other half, or within one?"""
    hits = _holders(motifs, signatures).groupBy("signature").agg(F.max(F.size("own") == F.size("signature")).alias("exact"))
    return motifs.select("signature").join(hits, "signature", "left").select("signature", F.coalesce("exact", F.lit(False)).alias("exact"), F.col("exact").isNotNull().alias("recovered"))


def bigram_list(text: Column, min_len: int = 4) -> Column:
    """Neighbouring alphabetic words of at least min_len letters, the others left out before, in the order of the text."""
    # within the inner lambda the words are a variable, not an expression for each use
    w = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: F.length(x) >= min_len)
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(w), pairs)[0]


def bigrams(passages: DataFrame, keys: Sequence[str], min_len: int = 4) -> DataFrame:
    """(keys, bigram) of each of a passage's bigrams, as in bigram_list."""
    return passages.select(*keys, F.explode(bigram_list(F.col("text"), min_len)).alias("bigram"))
