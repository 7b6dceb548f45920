"""Scores that decide whether an input is worth processing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 0.3
# Fixed values of the scores.
LEAST_IMPORTANCE, NORM_SHARE, DISTINCT_SHARE, DISTINCT_FULL = 0.3, 0.5, 0.5, 20
NORM_BASE, NORM_GAIN, NORM_FULL, MOST_NORM = 0.3, 0.6, 5.0, 0.9
CONFIDENCE_BASE, CONFIDENCE_GAIN, FULL_LENGTH, MOST_CONFIDENCE = 0.4, 0.4, 100, 0.9
PRIORITY_BASE, PRIORITY_GAIN = 0.3, 0.7
TIMELINESS, CONTRADICTION, NO_RELEVANCE = 0.8, 0.5, 0.5
SCORES = ("importance", "confidence", "priority", "timeliness", "contradiction", "relevance")


def gate_scores(text: Column, relevance: Column | None = None) -> Column:
    """struct of six scores; all 0 for null and empty texts. Embeddings have norm 1, or 0 for texts that are empty."""
    distinct = F.size(F.array_distinct(F.split(text, "")))
    norm_score = min(MOST_NORM, NORM_BASE + NORM_GAIN * (1.0 / NORM_FULL))
    importance = F.greatest(F.lit(LEAST_IMPORTANCE), F.lit(NORM_SHARE * norm_score) + DISTINCT_SHARE * F.least(F.lit(1.0), distinct / DISTINCT_FULL))
    confidence = F.least(F.lit(MOST_CONFIDENCE), CONFIDENCE_BASE + CONFIDENCE_GAIN * (F.length(text) / FULL_LENGTH))
    relevant = F.lit(NO_RELEVANCE) if relevance is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (relevance + 1) / 2))
    values = (importance, confidence, PRIORITY_BASE + PRIORITY_GAIN * importance, F.lit(TIMELINESS), F.lit(CONTRADICTION), relevant)
    empty = F.coalesce(text, F.lit("")) == ""
    return F.struct(*[F.when(empty, 0.0).otherwise(v).alias(n) for n, v in zip(SCORES, values, strict=True)])


def gate_passes(scores: Column, threshold: float = THRESHOLD) -> Column:
    mean = sum((scores[n] for n in SCORES[1:]), scores[SCORES[0]]) / len(SCORES)
    return mean >= threshold
