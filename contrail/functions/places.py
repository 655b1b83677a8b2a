"""Places of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def numbered(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """df with place: 0, 1, 2... in the order. Ranges are sorted each in its task; one row a range is added up beside them."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = written(laid, "places").withColumn("_range", F.shiftright("_at", 33))
    sizes = laid.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    rows = laid.join(F.broadcast(starts), "_range")
    return rows.withColumn(place, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_at", "_before")
