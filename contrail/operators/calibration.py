"""Threshold, curve and calibration metrics (L11-L17), and the decision on a calibration (L19; the fit is in newton)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def threshold_metrics(rows: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """Precision, recall and F1, 0 where undefined."""
    said, is_ = F.col(score) >= threshold, F.col(label) == 1
    c = rows.agg(F.count_if(said & is_).alias("tp"), F.count_if(said & ~is_).alias("fp"), F.count_if(~said & is_).alias("fn"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return c.select("tp", "fp", "fn", part("tp", "fp").alias("precision"), part("tp", "fn").alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def _by_score(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and rows at each score, with sums over higher scores, range by range of the score.

    Distinct scores are sorted into ranges of about equal numbers, whatever their values; sums within a range and over the
    ranges above it add up to the running sums, so no task sees all scores.
    """
    each = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    each = written(each.repartitionByRange(F.desc("s")).withColumn("r", F.spark_partition_id()), "scores")
    ranges = each.groupBy("r").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    above = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("r", F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("pos_0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_0"))
    w = Window.partitionBy("r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    each = each.join(F.broadcast(ranges), "r")
    return each.select("s", "pos", "n", (F.col("pos_0") + F.sum("pos").over(w)).alias("cum_pos"), (F.col("n_0") + F.sum("n").over(w)).alias("cum_n"))


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Mann-Whitney with ties averaged; null with one class only."""
    at = _by_score(rows, score, label).withColumn("neg", F.col("n") - F.col("pos")).withColumn("above", F.col("cum_pos") - F.col("pos"))
    s = at.agg(F.sum(F.col("neg") * (F.col("above") + F.col("pos") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("roc_auc"))


def average_precision(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum of precision times gain of recall over falling scores."""
    at = _by_score(rows, score, label)
    return at.agg(F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")), F.sum("pos")).alias("average_precision"))


def brier_log_loss(rows: DataFrame, prob: str = "score", label: str = "label", clip: float = 1e-15) -> DataFrame:
    """L14."""
    p, y = F.col(prob), F.col(label)
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return rows.agg(F.avg(F.pow(p - y, F.lit(2))).alias("brier"), F.avg(-F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))


def reliability(rows: DataFrame, bins: int = 10, prob: str = "score", label: str = "label") -> DataFrame:
    """Equal bins on [0, 1], the last one closed, empty ones with nulls."""
    own = rows.groupBy(F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("rate"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("low"), ((F.col("id") + 1) / bins).alias("high"))
    return every.join(own, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """L16."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("rate"))) / F.sum("n")).alias("ece"))


def bad_probabilities(rows: DataFrame, prob: str = "score") -> DataFrame:
    """Rows whose probability is null, not finite or outside of [0, 1]."""
    p = F.col(prob)
    return rows.filter(p.isNull() | F.isnan(p) | (p < 0) | (p > 1))


def accept_calibration(rows: DataFrame, before: str = "score", after: str = "calibrated", label: str = "label", most_ece: float = 0.10) -> DataFrame:
    """One row with both sides' figures and accepted: nothing rises and the error is at most most_ece."""
    sides = {}
    for name, c in (("before", before), ("after", after)):
        m = brier_log_loss(rows, c, label).crossJoin(expected_calibration_error(reliability(rows, prob=c, label=label)))
        sides[name] = m.select(*[F.col(k).alias(f"{k}_{name}") for k in ("brier", "log_loss", "ece")])
    both = sides["before"].crossJoin(sides["after"])
    ok = (F.col("ece_after") <= most_ece) & F.lit(True)
    for k in ("brier", "log_loss", "ece"):
        ok = ok & (F.col(f"{k}_after") <= F.col(f"{k}_before"))
    return both.withColumn("accepted", ok)
