"""Scoring expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import round_to

# What one prevented error saves, what one injection costs, severity factors.
BASE_SAVINGS = 1800.0
INJECTION_COST = 140.0
SEVERITY_FACTOR = {"low": 0.5, "medium": 1.0, "high": 2.5, "critical": 7.0}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def by_severity(severity: Column, values: dict[str, float], default: str = "medium") -> Column:
    found = F.lit(values[default])
    for name, value in values.items():
        found = F.when(F.coalesce(severity, F.lit(default)) == name, F.lit(value)).otherwise(found)
    return found


def _decision(savings: Column, threshold: Column, relaxation: float) -> Column:
    weight = 1 / (1 + F.exp(-0.03 * max(0.1, min(3.0, relaxation)) * (savings - threshold)))
    return F.struct(
        (weight > 0.5).alias("inject"),
        round_to(weight, 3).alias("inject_weight"),
        F.floor(savings + 0.5).cast("bigint").alias("expected_savings"),
        F.floor(threshold + 0.5).cast("bigint").alias("threshold"),
        F.floor((savings - threshold) / threshold * 100 + 0.5).cast("bigint").alias("roi"),
    )


def injection_value(similarity: Column, severity: Column, used: Column, window: float = 200_000.0, complexity: float = 0.35, relaxation: float = 1.0) -> Column:
    """Whether a record is worth its tokens: savings capped by the room left, against a threshold quadratic in pressure."""
    raw = similarity * complexity * by_severity(severity, SEVERITY_FACTOR) * BASE_SAVINGS
    savings = F.least(raw, F.greatest(F.lit(0.0), F.lit(window) - used) * 0.3)
    pressure = used / max(window, 1.0)
    return _decision(savings, INJECTION_COST * (1 + pressure * pressure * 2), relaxation)


def smooth_injection_value(similarity: Column, severity: Column, used: Column, confidence: Column, window: float = 200_000.0, complexity: float = 0.35, relaxation: float = 1.0) -> Column:
    """The same with logarithmic similarity, confidence under a root, and an exponential threshold."""
    raw = F.log1p(similarity * math.e) / math.log1p(math.e) * complexity * by_severity(severity, SEVERITY_FACTOR) * BASE_SAVINGS * F.sqrt(F.greatest(F.lit(0.05), confidence))
    savings = F.least(raw, F.greatest(F.lit(0.0), F.lit(window) - used) * 0.3)
    return _decision(savings, INJECTION_COST * F.exp(used / max(window, 1.0) * math.log(3)), relaxation)


def laplace(good: Column, tries: Column, prior: float = 0.6) -> Column:
    return F.coalesce((good + 1) / (tries + 2), F.lit(prior))


def certainty(relevance: Column, confidence: Column) -> Column:
    """Harmonic mean; 0 unless both are positive."""
    return F.when((relevance > 0) & (confidence > 0), 2 * relevance * confidence / (relevance + confidence)).otherwise(0.0)


def volatility(text: Column) -> Column:
    return F.exp(-F.length(F.coalesce(text, F.lit(""))) / 800)


def session_fit(text: Column, pressure: float = 0.0) -> Column:
    return 1 - F.abs(volatility(text) - (1 - pressure))


def normalised_score(score: Column) -> Column:
    """Any retriever's score on a scale of 0 to 1; null is neutral."""
    return F.when(score.isNull(), 0.5).when(score > 1, 1 / (1 + F.exp(-(score - 1)))).when(score < 0, F.greatest(F.lit(0.0), score + 1)).otherwise(score)


def idf(n: Column, df: Column) -> Column:
    return F.log1p(n / (1 + df))


def pmi(together: Column, n: Column, a: Column, b: Column) -> Column:
    return F.log(together * n / (a * b))


def log_edge_weight(confidence: Column) -> Column:
    return -F.log1p(-F.greatest(F.lit(0.001), F.least(F.lit(0.9999), confidence)))


def quality(symptom_tokens: Column, wrong: Column, correct: Column, symptom: Column, tags: Column) -> Column:
    """10, less 2 for each failed check and 1 for each exceeded one."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    n_tags = F.coalesce(F.size(tags), F.lit(0))
    failed = [symptom_tokens < 4, size(wrong) < 10, size(correct) < 10, n_tags <= 0]
    exceeded = [size(wrong) + size(correct) + size(symptom) > 700, n_tags > 8]
    count = lambda xs: sum((F.when(x, 1).otherwise(0) for x in xs), F.lit(0))
    return F.greatest(F.lit(0), 10 - 2 * count(failed) - count(exceeded))


def evidence_phase(tries: Column, ratio: Column) -> Column:
    return F.when(tries < 5, "new").when((ratio >= 0.25) & (ratio < 0.30), "latent").when(ratio < 0.25, "drain").otherwise("active")


def pair_score(answer: Column) -> Column:
    """Of a cross-encoder's array of (label, score): the score of LABEL_1, else 1 less that of LABEL_0, else the first one."""
    of = lambda name: F.get(F.filter(answer, lambda x: x["label"] == name), F.lit(0))["score"]
    return F.coalesce(of("LABEL_1"), 1 - of("LABEL_0"), F.get(answer, F.lit(0))["score"])
