"""Linear score of the signals of a line, clamped, and its label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of severities and upper bounds of labels (fixed values).
SEVERITY = {"very_low": 10.0, "low": 25.0, "medium": 50.0, "high": 75.0, "very_high": 100.0}
LABELS = [(24.0, "Sangat rendah"), (44.0, "Rendah"), (64.0, "Sedang"), (84.0, "Tinggi")]
HIGHEST = "Sangat tinggi"
#: Thresholds of the review modes: fuzzy and semantic (fixed values).
MODES = {"Ketat": (86.0, 72.0), "Seimbang": (78.0, 60.0), "Lebih sensitif": (68.0, 52.0)}


@dataclass(frozen=True)
class Settings:
    """Weights and thresholds of a review."""

    exact: float = 0.25
    fuzzy_weight: float = 0.20
    semantic: float = 0.30
    severity: float = 0.10
    feedback: float = 0.10
    allowable: float = 0.20
    fuzzy_threshold: float = 78.0
    semantic_threshold: float = 60.0
    fuzzy: bool = True

    @staticmethod
    def for_mode(mode: str) -> Settings:
        f, s = MODES.get(mode, MODES["Seimbang"])
        return Settings(fuzzy_threshold=f, semantic_threshold=s)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(c, F.lit(0.0))))


def severity_points(severity: Column) -> Column:
    points = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.coalesce(F.try_element_at(points, F.coalesce(severity, F.lit("medium"))), F.lit(50.0))


def confidence(exact: Column, fuzzy: Column, semantic: Column, severity: Column, feedback: Column, allowable: Column, penalty: Column, s: Settings) -> Column:
    """Weighted sum in a fixed order of terms, within 0 and 100."""
    total = s.exact * exact + s.fuzzy_weight * fuzzy + s.semantic * semantic + s.severity * severity_points(severity) + s.feedback * feedback - s.allowable * allowable - penalty
    return clamp(total)


def label(score: Column) -> Column:
    c = clamp(score)
    out = None
    for most, name in LABELS:
        out = F.when(c <= most, name) if out is None else out.when(c <= most, name)
    return out.otherwise(HIGHEST)
