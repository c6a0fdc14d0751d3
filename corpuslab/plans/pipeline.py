"""The scoring pipeline end to end: blind, annotate, verify, score, classify, and write four tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import passages as P
from ..operators import score as X
from ..sources.io import write_fan_out


def score_passages(passages: DataFrame, cues: Sequence[A.Cue], fingerprints: DataFrame, quantum: Sequence[str], classical: Sequence[str], exclusive: Sequence[str], fields: tuple[Sequence[str], ...], salt: str = "blind") -> dict[str, DataFrame]:
    """annotations, theory_scores, passage_scores and field_ontology of (passage_id, text, ...)."""
    work, mapping = P.blind_passages(passages, salt)
    blind = A.annotate(work, cues).drop("word_count")
    annotations = P.unblind(blind, mapping).drop("anonymous_id", "text")
    values = annotations.select("passage_id", "feature_id", A.label_value(F.col("label")).alias("value"))
    scores = X.theory_scores(values, fingerprints)
    field = X.field_class(values, *fields)
    summary = X.specificity(scores, quantum, classical).join(X.exclusive_share(values, exclusive), "passage_id").join(field.select("passage_id", "field_class"), "passage_id")
    return {"annotations": annotations, "theory_scores": scores, "passage_scores": summary, "field_ontology": field}


def run(passages: DataFrame, path: str, **options) -> None:
    write_fan_out(score_passages(passages, **options), path)
