"""Audits of duplicates, leakage, contamination and overlaps between splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "))


def duplicate_groups(passages: DataFrame, text: Column) -> DataFrame:
    """(group_hash, n, first_id) of texts that more than one passage has."""
    groups = passages.groupBy(F.sha2(text, 256).alias("group_hash")).agg(F.count("*").alias("n"), F.min("passage_id").alias("first_id"))
    return groups.filter("n > 1")


def leakage_issues(passages: DataFrame, editorial: str, marks: Sequence[str]) -> DataFrame:
    """(type, passage_id): passages with language of editors of another time, or mixed with commentary."""
    low = F.lower("text")
    some = F.lit(False)
    for m in marks:
        some = some | F.contains(low, F.lit(m))
    a = passages.filter(F.col("text").rlike(f"(?iu){editorial}")).select(F.lit("editorial_language").alias("type"), "passage_id")
    return a.unionByName(passages.filter(some).select(F.lit("possible_commentary_mix").alias("type"), "passage_id"))


def overlaps(rows: DataFrame, key: str, split: str = "split", severity: str = "HARD") -> DataFrame:
    """(key_value, splits, severity) of keys that are in more than one split."""
    found = rows.groupBy(F.col(key).cast("string").alias("key_value")).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.filter(F.size("splits") > 1).withColumn("severity", F.lit(severity))


def audit_status(duplicates: DataFrame, hard: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: numbers of findings, and FAIL, PASS_WITH_WARNINGS or PASS."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(duplicates, "n_duplicates").crossJoin(n(hard, "n_hard")).crossJoin(n(issues, "n_issues"))
    status = F.when((F.col("n_duplicates") > 0) | (F.col("n_hard") > 0), "FAIL").when(F.col("n_issues") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return out.withColumn("status", status)


def contamination_summary(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, n_contaminated, rate, terms): per group, and for each strong term the passages that hold it."""
    base = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if("contaminated").alias("n_contaminated"))
    terms = rows.select(by, F.explode("strong").alias("term")).groupBy(by, "term").agg(F.count("*").alias("k"))
    terms = terms.groupBy(by).agg(F.array_sort(F.collect_list(F.concat_ws("=", "term", F.col("k").cast("string")))).alias("terms"))
    out = base.join(terms, by, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return out.withColumn("rate", F.col("n_contaminated") / F.col("n"))


def json_key_scan(rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose JSON text has one of the keys, at any depth."""
    return rows.filter(F.col(column).rlike('"(' + "|".join(keys) + r')"\s*:'))


def with_default(rows: DataFrame, lookup: DataFrame, key: str, value: str, prefix: str = "unknown_") -> DataFrame:
    """Add ``value`` by key; a key that the small lookup lacks gives prefix + key."""
    return rows.join(F.broadcast(lookup.select(key, value)), key, "left").withColumn(value, F.coalesce(value, F.concat(F.lit(prefix), F.col(key).cast("string"))))


def with_dates(rows: DataFrame, priors: DataFrame, key: str) -> DataFrame:
    """Add date_lo and date_hi: the row's own range, or its group's prior where it has neither end."""
    out = rows.join(F.broadcast(priors.select(key, F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))), key, "left")
    none = F.col("date_min").isNull() & F.col("date_max").isNull()
    pick = lambda own, other, prior: F.when(none, F.col(prior)).otherwise(F.coalesce(own, other))
    return out.withColumns({"date_lo": pick("date_min", "date_max", "__lo"), "date_hi": pick("date_max", "date_min", "__hi")}).drop("__lo", "__hi")


def scored_features(annotations: DataFrame, scores: DataFrame) -> DataFrame:
    """(passage_id, tradition, qs, features) of each passage: its score and the sorted features with label 1."""
    yes = F.array_sort(F.collect_set(F.when(F.col("label") == "1", F.col("feature_id"))))
    return annotations.groupBy("passage_id").agg(F.first("tradition").alias("tradition"), yes.alias("features")).join(scores.select("passage_id", "qs"), "passage_id")


def ablation(before: DataFrame, after: DataFrame) -> DataFrame:
    """(passage_id, tradition, before, after, delta, lost, gained) of two sides of scored_features: original and masked."""
    one = before.select("passage_id", "tradition", F.col("qs").alias("before"), F.col("features").alias("__b"))
    two = after.select("passage_id", F.col("qs").alias("after"), F.col("features").alias("__a"))
    out = one.join(two, "passage_id")
    return out.select("passage_id", "tradition", "before", "after", (F.col("after") - F.col("before")).alias("delta"), F.array_except("__b", "__a").alias("lost"), F.array_except("__a", "__b").alias("gained"))
