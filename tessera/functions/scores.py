"""Scores of records as columns; `age` is in days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.records import AS_OF, EVIDENCE


def days_since(day: Column, as_of: str = AS_OF) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), day)


def evidence_weight(level: Column) -> Column:
    """An unknown level weighs 1."""
    known = F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair])
    return F.coalesce(F.element_at(known, level), F.lit(1.0))


def composite(semantic: Column, text: Column, confidence: Column, age: Column, fresh_counts: Column | None = None) -> Column:
    """A blend of both scores, weighed by confidence; records updated within 30 days get a share more (where fresh_counts is not false)."""
    fresh = age < 30 if fresh_counts is None else (age < 30) & fresh_counts
    return (0.6 * semantic + 0.4 * text) * (1 + (confidence - 0.5) * 0.3) * F.when(fresh, 1.15).otherwise(1.0)


def proximity(at: Column, to: Column) -> Column:
    """1 / (1 + days between two instants); 0 for none."""
    days = F.abs(F.unix_micros(at.cast("timestamp")) - F.unix_micros(to.cast("timestamp"))) / 86_400_000_000
    return F.coalesce(1 / (1 + days), F.lit(0.0))


def usage(age: Column, accesses: Column, most: Column, confidence: Column) -> Column:
    """Recency over 90 days, share of the most accesses, confidence."""
    return 0.4 * F.greatest(F.lit(0.0), 1 - age / 90) + 0.3 * F.when(most > 0, accesses / most).otherwise(0.0) + 0.3 * confidence


def importance(confidence: Column, age: Column, accesses: Column) -> Column:
    fresh = F.when(age <= 7, 1.0).when(age <= 30, 0.5).otherwise(0.0)
    return 0.3 * confidence + 0.25 * F.greatest(F.lit(0.0), 1 - age / 90) + 0.25 * F.log(F.greatest(F.lit(1), accesses) + 1) / F.log(F.lit(51.0)) + 0.2 * fresh


def decay(age: Column, rate: Column, accesses: Column) -> Column:
    """0 in the first 30 days, then a half-life of 90, slowed by use."""
    raw = (1 - F.pow(F.lit(2.0), -(age - 30) / 90)) * rate * (1 - 0.4 * F.least(accesses / 10, F.lit(1.0)))
    return F.when(age <= 30, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


# How fast records of a type decay; other types at 1.
DECAY_RATES = {"convention": 0.7, "decision": 0.8, "architecture": 0.6, "entity": 1.0, "lesson": 0.9, "preference": 1.2, "pattern": 0.8, "execution": 1.1}


def decay_rate(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DECAY_RATES.items() for x in pair])
    return F.coalesce(F.element_at(known, kind), F.lit(1.0))


def quality_grade(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def risk(impact: Column, confidence: Column, age: Column) -> Column:
    return impact * (0.4 + 0.3 * (1 - confidence) + 0.3 * F.least(age / 30, F.lit(1.0)))


def risk_level(score: Column) -> Column:
    return F.when(score >= 5, "critical").when(score >= 3, "high").when(score >= 1, "medium").otherwise("low")
