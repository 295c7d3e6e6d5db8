"""Scores, bands and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed ranks of the model.
TRANSITION_RANK = {
    "Drafted": 0, "Submitted": 1, "Received": 2, "Acknowledged": 3, "ValidityChecking": 4, "AwaitingClarification": 4, "Valid": 5, "SearchPlanning": 6,
    "Searching": 7, "DocumentsIdentified": 8, "ConsultationRequired": 8, "ThirdPartyConsultation": 9, "ChargeAssessment": 9, "ExtensionApplied": 9,
    "DecisionDrafting": 10, "HumanDecisionRequired": 11, "DecisionApproved": 12, "ReleasedInFull": 13, "ReleasedInPart": 13, "Refused": 13,
    "NoDocumentsFound": 13, "Withdrawn": 13, "Closed": 13,
}
STATUS_RANK = {"unknown": 0, "inferred": 1, "asserted": 2, "observed": 3, "certified": 4}
SEVERITY_RANK = {"error": 3, "warning": 2, "info": 1}


def lookup(key: Column, values: dict[str, int], default: int) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(default))


def summary_band(confidence: Column) -> Column:
    """Band of summaries: ``unknown`` for what is no number, ``zero`` for NaN and below."""
    c = confidence.try_cast("double")
    return F.when(c.isNull(), "unknown").when(F.isnan(c), "zero").when(c >= 0.8, "high").when(c >= 0.5, "medium").when(c > 0, "low").otherwise("zero")


def kernel_band(score: Column) -> Column:
    """Band of the kernels, which differs from that of summaries."""
    return F.when(score <= 0, "none").when(score < 0.5, "low").when(score < 0.8, "medium").otherwise("high")


def transition_rank(state: Column) -> Column:
    return lookup(state, TRANSITION_RANK, -1)


def is_forward(source: Column, target: Column) -> Column:
    a, b = transition_rank(source), transition_rank(target)
    return (a >= 0) & (b >= 0) & (b >= a)


def kernel_risk(score: Column, health: Column) -> Column:
    return F.when(health | (score >= 5), "high").when(score >= 1, "medium").otherwise("low")


def blend(lexical: Column, vector: Column, weight: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))
    return w * lexical + (1 - w) * vector


def unit_cosine(cosine: Column) -> Column:
    return F.when(cosine <= -1, 0.0).when(cosine >= 1, 1.0).otherwise((cosine + 1) / 2)


def clamp_top_k(k: Column, most: Column) -> Column:
    return F.when(k <= 0, F.lit(1)).otherwise(F.least(k, most))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def span_iou(a: Column, b: Column) -> Column:
    """Overlap of two lists of half-open spans as sets of characters; 1 if both are empty. An empty span has none, though ``sequence`` would count down."""
    chars = lambda spans: F.flatten(F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s: F.sequence(s["start"], s["end"] - 1)))
    both, either = F.size(F.array_intersect(chars(a), chars(b))), F.size(F.array_union(chars(a), chars(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def spans_valid(spans: Column, length: Column) -> Column:
    """In bounds, not empty, sorted and not overlapping."""
    inside = F.forall(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= length))
    pairs = F.arrays_zip(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))).alias("a"), F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))).alias("b"))
    return inside & F.forall(pairs, lambda p: p["a"]["end"] <= p["b"]["start"])
