"""Mixing sources to target weights along a time-varying curriculum (operator 2).

Every source has a target number of words: its weight's share of all words, at most max_repeat times its own size, the
excess reshared by weight. A source serves its documents in a keyed random order, again and again, until its target is
reached; the last document is cut there. Each source also has a schedule: a piecewise linear weight over training time.
Its integral is the source's cumulative demand; inverting it at the words that the source served before a document gives
the document's training position in [0, 1], and a range sort by position gives the training order.

Null text has no words. Null sources are one source, the last one. Empty documents get size 0 and are taken 0 words.
Repeated rows count as documents of their own; ties in the order are broken by the id, the size and the caller's ties. An empty table gives an empty result. Extra columns pass through; a column that has the
name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import Words, text_udf

#: (time, weight) knots for the sources, repeating in code-point order: falling, level and rising weight.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
MIX_COLUMNS = ("size", "source_size", "weight", "target", "served", "taken", "copies", "position")


def count_words(texts: pa.Array) -> pa.Array:
    return pa.array(np.diff(Words(texts).offsets).astype(np.int64))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their number of words as size."""
    return docs.withColumn("size", text_udf(count_words, "bigint")(F.col(text)))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, place, weight, target) from (source, size): one row for each source.

    The level w such that sum(min(max_repeat * size, w * weight)) = share of all words is found from running sums over
    the sources by the level at which they are full.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("place"))
    listed = F.array(*[F.lit(float(x)) for x in weights])
    ranked = ranked.withColumn("weight", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("full", F.lit(float(max_repeat)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("full") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (
        F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), "place", "level"))).over(Window.partitionBy())
    levels = levels.withColumn("open_level", open_level["level"])
    target = F.least(F.col("full"), F.coalesce(F.col("open_level"), F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", "source_size", "place", "weight", target.alias("target"))


def order_key(docs: DataFrame, key: str = "doc_id") -> Column:
    """A keyed random order that any engine can repeat: MD5 of the document's id."""
    return F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3, share: float = 1.0, schedules=SCHEDULES, key: str = "doc_id", ties: Sequence[str] = ()) -> DataFrame:
    """docs (with source and size) with source_size, target, served (words of the source before it), taken and position.

    The order within a source is cut at the first hex digits of its key into about as many buckets as a bucket of the
    largest source has documents; sums are added up bucket by bucket, so no task sees a whole source.
    """
    docs = docs.drop(*[c for c in MIX_COLUMNS if c != "size"])
    docs = docs.withColumn("_key", order_key(docs, key))
    largest = docs.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = next(d for d in range(1, 9) if 16 ** (2 * d) >= largest)
    docs = docs.withColumn("_bucket", F.substring("_key", 1, digits))
    buckets = docs.groupBy("source", "_bucket").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source", "_bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_before"))
    known = _join_sources(buckets, targets(docs.select("source", "size"), weights, max_repeat, share))
    within = Window.partitionBy("source", "_bucket").orderBy("_key", *([key] if key in docs.columns else []), "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    docs = _join_sources(docs, known, "_bucket")
    docs = docs.withColumn("served", F.col("_before") + F.col("_within"))
    whole = F.floor("target").cast("bigint")
    taken = sum(F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("served") - epoch * F.col("source_size"))) for epoch in range(int(np.ceil(max_repeat))))
    return docs.withColumn("taken", taken.cast("bigint")).withColumn("position", position(F.col("served"), schedules)).drop("_key", "_bucket", "_before", "_within")


def _join_sources(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Join on source, nulls equal, and on more."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in ("source", *more)})
    same = F.col("source").eqNullSafe(F.col("_r_source"))
    for c in more:
        same = same & (F.col(c) == F.col(f"_r_{c}"))
    return left.join(right, same).drop(*[f"_r_{c}" for c in ("source", *more)])


def position(served: Column, schedules=SCHEDULES) -> Column:
    """The time at which the demand of the row's source (columns place, target) reaches served words."""
    u = F.least(F.lit(1.0), served / F.when(F.col("target") > 0, F.col("target")))
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        done, here = 0.0, F.lit(None).cast("double")
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            slope, left = (w1 - w0) / (t1 - t0), u * area - done
            at = t0 + left / w0 if slope == 0 else t0 + (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * left)) - w0) / slope
            here = F.when(left >= 0, at).otherwise(here)
            done += (t1 - t0) * (w0 + w1) / 2
        out = F.when(F.col("place") % len(schedules) == k, here).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def courses(steps: int, schedules=SCHEDULES) -> list[list[float]]:
    """For each schedule the part of its source that is served at 0, 1 / steps, ..., 1 of the run: its integral, scaled to end at 1."""
    out = []
    for knots in schedules:
        t, w = (np.array(x, float) for x in zip(*knots, strict=True))
        at = np.unique(np.concatenate([np.linspace(0, 1, steps + 1), t]))
        level = np.interp(at, t, w)
        area = np.concatenate([[0], np.cumsum(np.diff(at) * (level[1:] + level[:-1]) / 2)])
        out.append([float(x) for x in np.interp(np.linspace(0, 1, steps + 1), at, area / area[-1])])
    return out


def occurrences(planned: DataFrame, max_repeat: float = 3, schedules=SCHEDULES) -> DataFrame:
    """One row for each time that a document is served, with epoch, words (taken then) and its own position."""
    epochs = planned.filter("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(np.ceil(max_repeat)) - 1))))
    epochs = epochs.withColumn("served", F.col("served") + F.col("epoch") * F.col("source_size"))
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("bigint") - F.col("served")))
    return epochs.withColumn("words", words).filter("words > 0").withColumn("position", position(F.col("served"), schedules))


def in_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows range-partitioned and sorted by training position."""
    return rows.repartitionByRange("position", *ties).sortWithinPartitions("position", *ties)
