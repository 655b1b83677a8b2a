"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo folds; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def _known(labels: DataFrame, label: str, folds: int) -> DataFrame:
    """(doc_id, y) of the ids outside of fold 0 that have one label of 0 or 1."""
    known = labels.filter(F.col(label).isin(0, 1) & (fold_of(F.col("doc_id"), folds) != 0))
    return known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most")).filter("y = most").drop("most")


def class_weights(labels: DataFrame, label: str, per_class: int, folds: int = 5) -> np.ndarray:
    """How many labelled rows each row of a training sample stands for, of label 0 and of label 1; 1 where none is cut."""
    count = {r["y"]: r["count"] for r in _known(labels, label, folds).groupBy("y").count().collect()}
    return np.array([max(count.get(y, 0) / per_class, 1.0) if per_class else 1.0 for y in (0, 1)])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_text_bytes: int, folds: int = 5) -> DataFrame:
    """(doc_id, text, y): up to per_class documents of each label, in MD5 order of their ids, outside of fold 0.

    Rows without a label of 0 or 1, or with another label for the same id, are left out, as are texts of over
    max_text_bytes: at most 2 * per_class * max_text_bytes bytes whatever the corpus.
    """
    known = _known(labels, label, folds)
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= max_text_bytes)
    return found.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


class Logistic:
    """Logistic regression of a few standardised columns by Newton steps; each row counts by its weight."""

    def __init__(self, columns: np.ndarray, y: np.ndarray, ridge: float = 0.1, weight: np.ndarray | None = None) -> None:
        w = np.ones(len(y)) if weight is None else weight
        x = np.asarray(columns, float).reshape(len(y), -1)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(y) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        x = np.column_stack([np.ones(len(y)), (x - self.mean) / self.scale])
        self.weights = np.zeros(x.shape[1])
        if len(y):
            self.weights[0] = np.log(((w * y).sum() + 1) / ((w * (1 - y)).sum() + 1))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -60, 60)))
            pull = np.r_[0.0, [ridge] * (x.shape[1] - 1)]
            hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-6)
            step = np.linalg.solve(hessian, x.T @ (w * (p - y)) + pull * self.weights)
            self.weights = self.weights - np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break

    def __call__(self, columns: np.ndarray) -> np.ndarray:
        x = (np.asarray(columns, float).reshape(-1, len(self.mean)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -60, 60)))
