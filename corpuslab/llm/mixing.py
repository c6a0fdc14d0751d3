"""Mixing sources to target weights, with DataFrame functions only.

Sources are leaves of a tree of domains, languages and sources. The token budget goes down the tree by weight. What
a child cannot supply (its subtree's tokens times the most epochs) goes to its siblings by their weights; only what
a whole subtree cannot supply reaches the siblings of its parent. Each leaf then takes whole epochs and a prefix, by
tokens, of one more epoch in seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_hot, materialize

LEVELS = ("domain", "lang", "source")
#: Rows of a part of a leaf, on average at most: what one group of a running sum holds.
PART_ROWS = 4096


def count_words(text: Column) -> Column:
    """Runs of other characters than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(weights: Mapping[str, int], path: list[str]) -> Column:
    """The whole number that weights has for the node's path, joined by '/', or 1."""
    if not weights:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.concat_ws("/", *path)), F.lit(1)).cast("long")


def water_fill(children: DataFrame, parent: list[str], name: str, budget: str, out: str) -> DataFrame:
    """Add ``out``: each child's share of its parent's ``budget`` by ``weight``, at most its ``cap``.

    In order of cap / weight, a child is full if its share of what is left reaches its cap; the others share the rest
    by weight, rounded down. Children of weight 0 get nothing.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.nullif(F.col("weight"), F.lit(0))).otherwise(F.lit(1e308))
    order = W.partitionBy(*parent).orderBy("ratio", name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy(*parent)
    full = (F.col("weight") > 0) & (F.col("cap") * (F.col("w_all") - F.col("w_before")) <= (F.col(budget) - F.col("cap_before")) * F.col("weight"))
    return (
        children.withColumn("ratio", ratio)
        .withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("weight").over(before), F.lit(0)), "w_all": F.sum("weight").over(own)})
        .withColumn("full", full)
        .withColumns({"left": F.col(budget) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(own), F.lit(0)), "w_left": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(own), F.lit(0))})
        .withColumn(out, F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(F.expr("left * weight div nullif(w_left, 0)"), F.lit(0))).cast("long"))
        .drop("ratio", "cap_before", "w_before", "w_all", "full", "left", "w_left")
    )


def leaf_budgets(leaves: DataFrame, share: tuple[int, int], weights: Mapping[str, int], max_epochs: int) -> DataFrame:
    """Add leaf_budget to (domain, lang, source, avail, ...); the whole budget is share[0] / share[1] of all avail."""
    caps = leaves.withColumn("cap", F.col("avail") * max_epochs)
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("avail").alias("avail"))
    domains = domains.withColumn("root", F.lit(0)).withColumn("avail", F.sum("avail").over(W.partitionBy("root")))
    domains = domains.withColumn("budget", F.expr(f"avail * {int(share[0])} div {int(share[1])}"))
    domains = domains.withColumn("weight", _weight(weights, ["domain"]))
    domains = water_fill(domains, ["root"], "domain", "budget", "domain_budget").select("domain", "domain_budget")
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain")
    langs = langs.withColumn("weight", _weight(weights, ["domain", "lang"]))
    langs = water_fill(langs, ["domain"], "lang", "domain_budget", "lang_budget").select("domain", "lang", "lang_budget")
    out = caps.join(langs, ["domain", "lang"]).withColumn("weight", _weight(weights, list(LEVELS)))
    return water_fill(out, ["domain", "lang"], "source", "lang_budget", "leaf_budget").select(*leaves.columns, "leaf_budget")


def mix_sources(
    documents: DataFrame, domain: Column, weights: Mapping[str, int], share: tuple[int, int] = (1, 1),
    max_epochs: int = 1, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each row: (id, domain, lang, source, n_tokens, copies long); copies says how often it is taken.

    The budget is share[0] / share[1] of all tokens (words between ASCII white space), rounded down. ``weights`` maps
    'domain', 'domain/lang' and 'domain/lang/source' to whole numbers; a node without one weighs 1. Null lang and
    source are leaves of their own, named 'unknown'. A leaf takes documents in the order of md5(seed:epoch:id) while
    the tokens before are below its budget, so it oversteps by less than one document; the order breaks ties by id.
    Texts without words never count, and are taken as the order falls. Repeated rows each count. Leaves hold any
    share of the rows: the running sum is by 4096 parts of each. An empty table gives an empty result; other columns
    are not read.
    """
    base = documents.select(
        F.col(id_col).alias("doc_id"), F.coalesce(domain, F.lit("unknown")).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"),
        F.coalesce("source", F.lit("unknown")).alias("source"), count_words(F.col(text_col)).alias("n_tokens"),
    )
    base = materialize(base)
    leaves = base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("avail"), F.count("*").alias("docs"))
    budgets = leaf_budgets(leaves, share, weights, max_epochs)
    epochs = F.coalesce(F.expr("leaf_budget div nullif(avail, 0)"), F.lit(0))
    # hexadecimal digits of the order key that tell the parts of a leaf, and half of them for groups of parts
    digits = F.ceil(F.log2(F.greatest(F.col("docs") / PART_ROWS, F.lit(1))) / 4).cast("int")
    budgets = budgets.withColumns({"epochs": epochs, "digits": digits}).withColumn("rest", F.col("leaf_budget") - F.col("epochs") * F.col("avail"))
    rows = join_hot(base, budgets, list(LEVELS), "docs", base.count())
    key = F.md5(F.concat_ws(":", F.lit(seed), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = rows.select("doc_id", *LEVELS, "n_tokens", "epochs", "rest", "digits", key.alias("key"))
    rows = materialize(rows.withColumns({"head": F.expr("substring(key, 1, digits div 2)"), "part": F.expr("substring(key, 1, digits)")}))
    parts = rows.groupBy(*LEVELS, "head", "part").agg(F.sum("n_tokens").alias("t"))
    heads = parts.groupBy(*LEVELS, "head").agg(F.sum("t").alias("t"))
    before = lambda by, order: F.coalesce(F.sum("t").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = heads.withColumn("head_start", before(LEVELS, "head")).drop("t")
    parts = parts.withColumn("part_start", before([*LEVELS, "head"], "part")).drop("t").join(heads, [*LEVELS, "head"])
    parts = parts.select(*LEVELS, "part", (F.col("part_start") + F.col("head_start")).alias("part_start"))
    inside = W.partitionBy(*LEVELS, "part").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, [*LEVELS, "part"])
    copies = F.col("epochs") + (F.col("part_start") + F.col("start") < F.col("rest")).cast("long")
    return rows.select("doc_id", *LEVELS, "n_tokens", copies.cast("long").alias("copies"))
