"""Composite risk of a document: weighted authenticity gap plus penalties."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.arrays import compact, flag_if
from credence.functions.numbers import round_to


@dataclass(frozen=True)
class RiskSettings:
    """Per-document scoring settings; the band thresholds default to the
    published ones and may differ from those of the submission rollup."""

    weights: dict[str, float] = field(default_factory=lambda: dict(V.RISK_WEIGHTS))
    missing_penalty: float = V.MISSING_PENALTY
    high: float = V.HIGH_RISK
    medium: float = V.MEDIUM_RISK
    hard: float = V.TAMPER_HARD


def risk_band(score: Column, high: float = V.HIGH_RISK, medium: float = V.MEDIUM_RISK) -> Column:
    """high / medium / low; NULL score has no band."""
    return (F.when(score.isNull(), None).when(score >= high, "high")
            .when(score >= medium, "medium").otherwise("low"))


def _clamp(score: Column) -> Column:
    # least/greatest skip NULLs, so a missing score is kept missing by hand
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def score_document(components: dict[str, Column], tamper_confidence: Column,
                   penalty_points: Column | None = None,
                   settings: RiskSettings = RiskSettings()) -> Column:
    """STRUCT(score, level, hard_override, base, penalties, breakdown).

    ``components`` maps text, classification, signature, stamp and tamper to
    nullable authenticity scores. A missing component leaves the blend; all but
    tamper then cost the missing-component penalty."""
    weighted, present, penalties = F.lit(0.0), F.lit(0.0), penalty_points
    penalties = F.lit(0.0) if penalties is None else F.coalesce(penalties, F.lit(0.0))
    entries: list[Column] = []
    for name, weight in settings.weights.items():
        value = components[name]
        gap = F.lit(weight) * (F.lit(1.0) - _clamp(value))
        weighted = weighted + F.when(value.isNull(), 0.0).otherwise(gap)
        present = present + F.when(value.isNull(), 0.0).otherwise(weight)
        if name != "tamper":
            penalties = penalties + F.when(value.isNull(), settings.missing_penalty).otherwise(0.0)
        entry = F.struct(
            F.lit(name).alias("component"), _clamp(value).alias("score"), F.lit(weight).alias("weight"),
            round_to(gap, 4).alias("risk_contribution"), value.isNull().alias("missing"))
        entries.append(F.when(value.isNull() & F.lit(name == "tamper"), None).otherwise(entry))
    base = F.when(present > 0, weighted / present * 100.0).otherwise(0.0)
    blended = F.greatest(F.lit(0.0), F.least(F.lit(100.0), base + penalties))
    override = F.coalesce(tamper_confidence, F.lit(0.0)) >= settings.hard
    final = F.when(override, F.greatest(blended, F.lit(settings.high))).otherwise(blended)
    level = F.when(override, "high").otherwise(risk_band(blended, settings.high, settings.medium))
    return F.struct(
        round_to(final, 2).alias("score"), level.alias("level"), override.alias("hard_override"),
        round_to(base, 2).alias("base"), round_to(penalties, 2).alias("penalties"),
        compact(*entries).alias("breakdown"))


def missing_component_flags(components: dict[str, Column]) -> Column:
    """One phrase per missing component that is not tamper."""
    return compact(*[flag_if(components[name].isNull(), text) for name, text in V.MISSING_FLAGS.items()])
