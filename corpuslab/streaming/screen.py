"""Screening of a stream of passages: the same column expressions as in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.passages import anachronism_rows, detect_leaks


def screen(passages: DataFrame, strong: Sequence[str], soft: Sequence[str], leaks: Sequence[str]) -> DataFrame:
    """(passage_id, n_strong, n_soft, contaminated, leaks); stateless, so it runs on a stream unchanged."""
    rows = detect_leaks(anachronism_rows(passages, strong, soft), leaks)
    return rows.select("passage_id", "n_strong", "n_soft", "contaminated", "leaks")
