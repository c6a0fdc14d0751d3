"""Feature annotation by cues, verification of evidence, labels and claims."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import BASE_CUES, CLASSICAL_CUES, METAPHYSICAL_CUES, NEGATIVE_CUES
from ..functions import text as T


class Cue(NamedTuple):
    feature_id: str
    pattern: str
    positive: bool = True


def cue_packs(base: bool = True, classical: bool = True, metaphysical: bool = True) -> list[Cue]:
    """The packaged cues of the packs that are on; the negative cues belong to the base."""
    out = [Cue(f, p) for on, pack in ((base, BASE_CUES), (classical, CLASSICAL_CUES), (metaphysical, METAPHYSICAL_CUES)) if on for f, p in pack]
    return out + [Cue(f, p, False) for f, p in NEGATIVE_CUES if base]


def annotate(passages: DataFrame, cues: Sequence[Cue] | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """(all columns, feature_id, label, evidence, confidence): one row for each passage and feature.

    A feature's negative cues come first (label 0), then its first matching positive cue, in order (label 1, with the
    sentence around the match as evidence); without a match the label is NA. Cues are literals of one projection, all
    packs if none are given; each is matched once, and the evidence is cut before the passage is repeated.
    """
    cues = cue_packs() if cues is None else cues
    text = F.col("text")
    rows = []
    for feature in features or list(dict.fromkeys(c.feature_id for c in cues)):
        own = [c for c in cues if c.feature_id == feature]
        no = [F.when(text.rlike(f"(?iu){c.pattern}"), F.lit("0")) for c in own if not c.positive]
        yes = [F.nullif(F.regexp_extract(text, f"(?iu){c.pattern}", 0), F.lit("")) for c in own if c.positive]
        match = F.coalesce(*yes) if yes else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(feature).alias("feature_id"), F.coalesce(*no, F.lit("?")).alias("no"), match.alias("match")))

    def decided(x: Column) -> Column:
        yes = (x.no == "?") & x.match.isNotNull()
        label = F.when(x.no == "0", "0").when(yes, "1").otherwise("NA")
        evidence = F.when(yes, T.enclosing_sentence(text, x.match)).otherwise("")
        confidence = F.when(yes, 0.8).when(x.no == "0", 0.7).otherwise(0.3)
        return F.struct(x.feature_id.alias("feature_id"), label.alias("label"), evidence.alias("evidence"), confidence.alias("confidence"))

    out = passages.withColumn("__a", F.explode(F.transform(F.array(*rows), decided)))
    return out.select(*passages.columns, "__a.feature_id", "__a.label", "__a.evidence", "__a.confidence")


def fuzzy_in(evidence: Column, text: Column) -> Column:
    """At least 80 % of the evidence's words of more than 3 letters are in the text; false without such words."""
    tokens = F.filter(F.split(F.lower(evidence), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 3)
    low = F.lower(text)
    return F.coalesce(F.size(F.filter(tokens, lambda w: F.contains(low, w))) >= 0.8 * F.nullif(F.size(tokens), F.lit(0)), F.lit(False))


def verify_evidence(annotations: DataFrame, guarded: Sequence[str], metaphor: str, technical: str, unity: str, unity_feature: str, exception: str) -> DataFrame:
    """Add flag, final_label and verified. A positive label needs evidence that is in the text.

    For guarded features, metaphors without technical words give U; unity language for ``unity_feature`` gives 0.
    """
    ev, text = F.trim("evidence"), F.col("text")
    hit = lambda p: ev.rlike(f"(?iu){p}")
    flag = (
        F.when(F.col("label") != "1", F.lit(None))
        .when(ev == "", "missing_evidence")
        .when(~F.contains(F.lower(text), F.lower(ev)) & ~fuzzy_in(ev, text), "evidence_span_not_found")
        .when((F.col("feature_id") == unity_feature) & hit(unity) & ~hit(exception), "unity_not_nonseparability")
        .when(F.col("feature_id").isin(*guarded) & hit(metaphor) & ~hit(technical), "metaphor_only")
    )
    out = annotations.withColumn("flag", flag)
    final = F.when(F.col("flag") == "metaphor_only", "U").when(F.col("flag") == "unity_not_nonseparability", "0").when(F.col("flag").isNotNull(), "NA").otherwise(F.col("label"))
    return out.withColumn("final_label", final).withColumn("verified", F.col("flag").isNull())


def label_value(label: Column) -> Column:
    """1.0 and 0.0; anything else, NA and U too, is null."""
    up = F.upper(F.trim(label.cast("string")))
    return F.when(up.isin("1", "1.0", "YES", "TRUE"), 1.0).when(up.isin("0", "0.0", "NO", "FALSE"), 0.0)


def violations(annotations: DataFrame) -> DataFrame:
    """Positive rows without evidence."""
    return annotations.filter((F.col("label") == "1") & (F.trim(F.coalesce("evidence", F.lit(""))) == ""))


def feature_vector(annotations: DataFrame, passages: DataFrame, features: DataFrame) -> DataFrame:
    """Every passage with every feature: (passage_id, feature_id, value), null where there is no label."""
    every = passages.select("passage_id").crossJoin(F.broadcast(features.select("feature_id")))
    own = annotations.select("passage_id", "feature_id", label_value(F.col("label")).alias("value"))
    return every.join(own, ["passage_id", "feature_id"], "left")


def parse_labels(raw: DataFrame, features: Sequence[str]) -> DataFrame:
    """(passage_id, feature_id, label, evidence, confidence) from a model's reply in ``raw``, each feature once.

    The first {...} of the reply holds "labels", a list of objects. YES is 1, NO is 0, others and missing ones are NA;
    confidence is clipped to 0..1; evidence that is not in the text goes, and with it a positive label.
    """
    schema = "labels array<struct<feature_id:string,label:string,evidence:string,confidence:double>>"
    body = F.from_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0), schema).labels
    rows = raw.select("passage_id", "text", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature_id"), body.alias("__l"))
    own = F.try_element_at(F.filter("__l", lambda x: x.feature_id == F.col("feature_id")), F.lit(1))
    rows = rows.withColumn("__o", own)
    ev = F.coalesce(F.col("__o.evidence"), F.lit(""))
    found = (ev != "") & F.contains(F.lower("text"), F.lower(ev))
    up = F.upper(F.col("__o.label"))
    label = F.when(up.isin("YES", "1") & found, "1").when(up.isin("NO", "0"), "0").otherwise("NA")
    return rows.select(
        "passage_id", "feature_id", label.alias("label"), F.when(found, ev).otherwise("").alias("evidence"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("__o.confidence"), F.lit(0.0)))).alias("confidence"),
    )


def evaluate_claims(positives: DataFrame, passages: DataFrame, claims: DataFrame) -> DataFrame:
    """One row for each claim (claim_id, required array, quantum array, verdict_override): shares of passages whose
    positive features meet any / all of them, the supported components, and a verdict."""
    yes = positives.groupBy("passage_id").agg(F.collect_set("feature_id").alias("yes"))
    base = passages.select("passage_id").join(yes, "passage_id", "left").withColumn("yes", F.coalesce("yes", F.array().cast("array<string>")))
    rows = base.crossJoin(F.broadcast(claims))
    share = lambda c: F.avg(c.cast("double"))
    all_of = lambda want: (F.size(want) > 0) & (F.size(F.array_except(want, "yes")) == 0)
    out = rows.groupBy("claim_id").agg(
        F.count("*").alias("n"), share(F.arrays_overlap("yes", "required")).alias("any_required"), share(all_of("required")).alias("all_required"),
        share(F.arrays_overlap("yes", "quantum")).alias("any_quantum"), share(all_of("quantum")).alias("all_quantum"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_intersect("required", "yes"))))).alias("supported"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_intersect("quantum", "yes"))))).alias("q_supported"),
        F.first("verdict_override").alias("__over"),
    )
    verdict = (
        F.when(F.size("q_supported") > 0, "partial_quantum_overlap")
        .when((F.size("supported") > 0) & F.col("__over").isNotNull(), F.col("__over"))
        .when(F.size("supported") > 0, "classical_or_field_like_ontology")
        .otherwise("unsupported_in_sample")
    )
    return out.withColumn("verdict", verdict).drop("__over")
