"""Logistic fits by Newton steps, each one aggregate over the rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(rows: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None, c: float = 1.0, steps: int = 50, least: float = 1e-10) -> list[float]:
    """Coefficients of the features and, last, the intercept: L2 of strength 1 / c on all but the intercept.

    A step sums gradient and curvature, a number for each pair of features, in one pass; the driver solves that small
    system. Steps end when none moves a coefficient by least.
    """
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    w, y = (F.col(weight).cast("double") if weight else F.lit(1.0)), F.col(label).cast("double")
    at, ridge = np.zeros(len(x)), np.diag([1.0 / c] * len(features) + [0.0])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    for _ in range(steps):
        p = probability(x, at)
        sums = [F.sum(w * (p - y) * v) for v in x] + [F.sum(w * p * (1 - p) * x[i] * x[j]) for i, j in pairs]
        found = [v or 0.0 for v in rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()]
        slope, curve = np.array(found[: len(x)]) + ridge @ at, np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, found[len(x) :], strict=True):
            curve[i, j] = curve[j, i] = v
        move = np.linalg.lstsq(curve + ridge, slope, rcond=None)[0]
        at = at - move
        if np.abs(move).max() < least:
            break
    return [float(v) for v in at]


def probability(x: Sequence[Column], coefficients: Sequence[float]) -> Column:
    total = sum(F.lit(float(c)) * v for c, v in zip(coefficients, x, strict=True))
    return 1 / (1 + F.exp(-total))


def scored(rows: DataFrame, features: Sequence[str], coefficients: Sequence[float], score: str = "score") -> DataFrame:
    """rows with the probability of label 1."""
    return rows.withColumn(score, probability([*[F.col(f).cast("double") for f in features], F.lit(1.0)], coefficients))


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with weight n / (2 n_class)."""
    n = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    weight = F.lit(1.0)
    for y, k in n.items():
        weight = F.when(F.col(label) == y, sum(n.values()) / (2.0 * k)).otherwise(weight)
    return rows.withColumn("weight", weight)


def platt(validation: DataFrame, test: DataFrame, score: str = "score", label: str = "label", c: float = 1.0) -> DataFrame:
    """Test with calibrated, from a logistic fit of label on score over validation."""
    return scored(test, [score], fit(validation, [score], label, c=c), "calibrated")
