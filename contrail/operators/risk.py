"""Risk of a set of impacts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RiskPolicy:
    """Points. The values are fixed ones."""

    severity: dict[str, float] = field(default_factory=lambda: {"LOW": 10.0, "MEDIUM": 25.0, "HIGH": 40.0, "CRITICAL": 50.0})
    evidence: float = 20.0
    symbol: float = 5.0
    distance: float = 5.0
    incomplete: float = 5.0
    partial: float = 3.0
    levels: tuple[tuple[float, str], ...] = ((24.0, "LOW"), (49.0, "MEDIUM"), (74.0, "HIGH"))


RISK = RiskPolicy()


def contributions(policy: RiskPolicy = RISK) -> dict[str, Column]:
    """Points by feature, from columns severity, score, direct, indirect, max_distance, incomplete and partial."""
    at_most = lambda c, n: F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(n))
    points = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in policy.severity.items() for x in kv]), F.col("severity")), F.lit(0.0))
    return {
        "change_severity": points,
        "direct_evidence": F.coalesce("score", F.lit(0.0)) * policy.evidence,
        "direct_symbol_count": at_most("direct", 3) * policy.symbol,
        "indirect_symbol_count": at_most("indirect", 5) * policy.symbol,
        "maximum_distance": at_most("max_distance", 5) * policy.distance,
        "incomplete_graph_coverage": F.when(F.col("incomplete"), policy.incomplete).otherwise(0.0),
        "partial_resolution": F.when(F.col("partial"), policy.partial).otherwise(0.0),
    }


def level(score: Column, policy: RiskPolicy = RISK) -> Column:
    out = F.when(score <= policy.levels[0][0], policy.levels[0][1])
    for most, name in policy.levels[1:]:
        out = out.when(score <= most, name)
    return out.otherwise("CRITICAL")


def assess(summaries: DataFrame, policy: RiskPolicy = RISK) -> DataFrame:
    """summaries with risk_score (0 to 100), risk_level and the contributions."""
    parts = contributions(policy)
    total = F.least(F.lit(100.0), F.greatest(F.lit(0.0), sum(parts.values())))
    listed = F.filter(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("points")) for k, v in parts.items()]), lambda x: x["points"] > 0)
    return summaries.withColumn("risk_score", total).withColumn("risk_level", level(F.col("risk_score"), policy)).withColumn("contributions", listed)
