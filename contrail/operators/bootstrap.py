"""Percentile intervals by resampling groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _poisson() -> tuple[float, ...]:
    """Distribution function of Poisson(1) at 0, 1, ..., until what is left is beyond 52 bits."""
    out, p, k = [math.exp(-1)], math.exp(-1), 1
    while p > 2.0**-53:
        p /= k
        out, k = [*out, out[-1] + p], k + 1
    return tuple(x for x in out if x < 1 - 2.0**-53)


POISSON = _poisson()
#: The same bounds for the first 13 hexadecimal digits x of a digest: (x + 0.5) / 2 ** 52 is above a bound from this text on.
DIGITS = tuple(f"{math.floor(x * 2.0**52 - 0.5) + 1:013x}" for x in POISSON)


def _draws(digest: Column) -> Column:
    """How many bounds the number of a digest's first 13 digits is above. Texts of hexadecimal digits have the order of their numbers."""
    out = F.when(digest < DIGITS[0], 0.0)
    for k, bound in enumerate(DIGITS[1:], 1):
        out = out.when(digest < bound, float(k))
    return out.otherwise(float(len(DIGITS)))


def intervals(groups: DataFrame, key: str, metrics: dict[str, Column], by: Sequence[str] = (), resamples: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(by.., metric, point, low, high): aggregates of the group rows, over all of them and over resamples.

    A group's number of draws in a resample is Poisson with mean 1, by the MD5 of seed, resample and key: the distributed form
    of drawing with replacement, which needs no numbering of the groups and no join. metrics are aggregates over the
    column w, the weight; ratios of sums stay ratios. All rows with weight 1 are resample 0, so groups are made once.
    """
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("resample").cast("string"), F.col(key).cast("string")))
    drawn = groups.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples)))).withColumn("_told", told)
    drawn = drawn.withColumn("w", F.when(F.col("resample") == 0, 1.0).otherwise(_draws(F.col("_told"))))
    each = drawn.groupBy(*by, "resample").agg(*[m.alias(k) for k, m in metrics.items()])
    each = each.select(*by, "resample", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in metrics])).alias("x")).select(*by, "resample", "x.metric", "x.value")
    tail, whole = (1 - level) / 2, F.col("resample") == 0
    spread = each.groupBy(*by, "metric").agg(F.max(F.when(whole, F.col("value"))).alias("point"), F.percentile(F.when(~whole, F.col("value")), F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return spread.select(*by, "metric", "point", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def weighted_mean(column: str) -> Column:
    """Mean of a column under the draws' weights; nulls are left out."""
    x = F.col(column)
    return F.try_divide(F.sum(F.when(x.isNotNull(), x * F.col("w"))), F.sum(F.when(x.isNotNull(), F.col("w"))))
