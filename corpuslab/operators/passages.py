"""Passages: normalising, blinding, scrubbing, masking and row-wise rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import EDITORIAL, EDITORIAL_SCRUB, LEAK_PATTERNS, NEUTRAL_WORDS, SCRUB_FAMILIES, SOFT_TERMS, STRONG_TERMS
from ..functions import text as T


def normalize_passages(rows: DataFrame, translation: str, source_text: str) -> DataFrame:
    """Add the effective text and its word count; rows without text are refused."""
    out = rows.withColumn("effective_text", T.effective_text(F.col(translation), F.col(source_text)))
    return out.filter("effective_text IS NOT NULL").withColumn("word_count", T.word_count(F.col("effective_text")).cast("long"))


def blind_passages(passages: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """The working table (anonymous_id, text, word_count), and the private mapping to passage ids."""
    ids = passages.withColumn("anonymous_id", T.anonymous_id(F.col("passage_id"), salt))
    work = ids.select("anonymous_id", T.drop_lines(F.col("text"), EDITORIAL).alias("text"))
    return work.withColumn("word_count", T.word_count(F.col("text")).cast("long")), ids.select("anonymous_id", "passage_id")


def unblind(annotations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Put passage ids in place of anonymous ones; ids that the mapping lacks pass through."""
    out = annotations.join(mapping.withColumnRenamed("passage_id", "__real"), "anonymous_id", "left")
    return out.withColumn("passage_id", F.coalesce(F.col("__real").cast("string"), "anonymous_id")).drop("__real")


def detect_leaks(passages: DataFrame, patterns: Sequence[str] = LEAK_PATTERNS) -> DataFrame:
    return passages.withColumn("leaks", T.matching(F.col("text"), patterns))


def scrub_text(passages: DataFrame, families: Sequence[tuple[str, str]] = SCRUB_FAMILIES, replacement: str = "[SCRUBBED]") -> DataFrame:
    """Add scrubbed, n_replacements and families_hit. Each family sees the text that the ones before it left."""
    out = passages.withColumn("__text", F.col("text"))
    for i, (_, pattern) in enumerate(families):  # a projection each, so that no replacement is computed twice
        pattern = f"(?iu){pattern}"
        out = out.select("*", F.regexp_count("__text", F.lit(pattern)).alias(f"__n{i}"), F.regexp_replace("__text", pattern, replacement).alias("__next"))
        out = out.drop("__text").withColumnRenamed("__next", "__text")
    lines = F.split("__text", "\n")
    editorial = lambda line: reduce(lambda a, b: a | b, [F.startswith(F.lower(F.trim(line)), F.lit(s)) for s in EDITORIAL_SCRUB])
    dropped = F.size(F.filter(lines, editorial))
    out = out.withColumn("__lines", dropped)
    names = [F.when(F.col(f"__n{i}") > 0, F.lit(n)) for i, (n, _) in enumerate(families)] + [F.when(F.col("__lines") > 0, F.lit("editorial_line"))]
    return out.select(
        *passages.columns, T.drop_lines(F.col("__text"), EDITORIAL_SCRUB).alias("scrubbed"),
        reduce(lambda a, b: a + b, [F.col(f"__n{i}") for i in range(len(families))] + [F.col("__lines")]).cast("long").alias("n_replacements"),
        F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda n: n.isNotNull()))).alias("families_hit"),
    )


def text_variants(passages: DataFrame, mapping: dict[str, str] = NEUTRAL_WORDS) -> DataFrame:
    """Three rows for each passage: its text, masked, and neutralised."""
    text = F.col("text")
    pairs = (("original", text), ("masked", T.mask(text, list(mapping))), ("neutralized", T.neutralize(text, mapping)))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("variant_text")) for n, c in pairs])).alias("v")
    return passages.select("passage_id", rows).select("passage_id", "v.variant", "v.variant_text")


def anachronism_rows(passages: DataFrame, strong: Sequence[str] = STRONG_TERMS, soft: Sequence[str] = SOFT_TERMS) -> DataFrame:
    """Add the terms of both lists that each text holds, their numbers, a flag for strong ones, and an excerpt."""
    text = F.col("text")
    out = passages.withColumns({"strong": T.containing(text, strong), "soft": T.containing(text, soft)})
    return out.withColumns({
        "n_strong": F.size("strong").cast("long"), "n_soft": F.size("soft").cast("long"), "contaminated": F.size("strong") > 0,
        "excerpt": F.replace(F.substring(text, 1, 280), F.lit("\n"), F.lit(" ")),
    })


def source_eligibility(sources: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add status and reason: the first rule, in order, whose condition holds refuses the row."""
    reason = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])
    return sources.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "eligible").otherwise("ineligible"))


def first_matching(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first rule one of whose keywords the lower-case text holds."""
    low = F.lower(text)
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys]), F.lit(label)) for label, keys in rules], F.lit(default))


def commentary_split(passages: DataFrame, marks: str) -> DataFrame:
    """Paragraphs that match ``marks`` on one side, the others on the other."""
    parts = F.filter(F.transform(F.split("text", r"\n"), lambda p: F.trim(p)), lambda p: p != "")
    out = passages.withColumn("__p", parts)
    is_note = lambda p: p.rlike(marks)
    return out.withColumns({"commentary": F.array_join(F.filter("__p", is_note), "\n"), "verse": F.array_join(F.filter("__p", lambda p: ~is_note(p)), "\n")}).drop("__p")
