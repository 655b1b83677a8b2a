"""Places of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialise


def laid_out(df: DataFrame, order: list[Column], name: str, at: str = "_at") -> DataFrame:
    """df range-partitioned and sorted, written, with at: rising in the order, without gaps within a partition.

    The partition's number stands above the lowest 33 bits.
    """
    return materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, order: list[Column], name: str, place: str = "place") -> DataFrame:
    """df with place: 1, 2, 3... in the order. What is added up beside it has one row for each partition."""
    laid = laid_out(df, order, name)
    part = F.shiftright("_at", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    out = laid.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(place, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")
