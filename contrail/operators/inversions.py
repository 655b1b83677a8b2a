"""Pairs whose order two scores disagree on, counted without making pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def earlier_less(key: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """For each place, how many earlier ones that hold a point have a smaller key: merge counting, width by width."""
    n, width = len(key), 1
    out, at = np.zeros(n, np.int64), np.arange(n)
    while width < n:
        right, block = at // width % 2 == 1, at // (2 * width)
        by = np.lexsort((~right, key, block))
        running = np.concatenate([[0], np.cumsum((holds & ~right)[by])])
        asks = np.flatnonzero(right[by])
        out[by[asks]] += running[asks] - running[block[by[asks]] * 2 * width]
        width *= 2
    return out


#: Points that a range or slice holds, which bounds the memory of a task.
EACH = 500_000


def _segments(*columns: pa.Array) -> list[int]:
    """Bounds of the runs of equal rows."""
    n = len(columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), n]


def _within_ranges(points: DataFrame, kind: str, ranges: int) -> DataFrame:
    """Points sorted by (group, x, asks first), with their range's number and, where they ask, what their range alone answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        holds = np.asarray(table["holds"].combine_chunks())
        y, found = np.asarray(table["y"].combine_chunks()), np.zeros(table.num_rows, np.int64)
        bounds = _segments(table["group"].combine_chunks())
        for a, b in zip(bounds, bounds[1:], strict=False):
            found[a:b] = earlier_less(-y[a:b], holds[a:b])
        found[holds] = 0
        number = TaskContext.get().partitionId()
        columns = {"group": table["group"].combine_chunks(), "range": pa.array(np.full(len(y), number), pa.int64()), "holds": pa.array(holds), "y": pa.array(y), "found": pa.array(found)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    laid = points.repartitionByRange(ranges, "group", "x", "holds").sortWithinPartitions("group", "x", "holds")
    return laid.mapInArrow(run, f"group {kind}, range bigint, holds boolean, y double, found bigint")


def _across_ranges(rows: DataFrame, kind: str) -> DataFrame:
    """(group, found): for each asking point the points above it in earlier ranges. rows are sorted by (slice, group, starts first, falling y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(1, np.int64)
        for batch in batches:
            columns = [batch.column(c) for c in ("slice", "group", "start")]
            bounds = _segments(*columns)
            first = pa.array(bounds[:-1], pa.int64())
            firsts = list(zip(*(c.take(first).to_pylist() for c in columns), strict=True)) if batch.num_rows else []
            ranges, n, holds = (np.asarray(batch.column(c)) for c in ("range", "n", "holds"))
            sums: dict = {}
            for a, b, (slice_, group, start) in zip(bounds, bounds[1:], firsts, strict=False):
                if (slice_, group) != at:
                    at, held = (slice_, group), np.zeros(1, np.int64)
                r = ranges[a:b]
                held = np.pad(held, (0, max(0, int(r.max()) + 1 - len(held))))
                if start:
                    np.add.at(held, r, n[a:b])
                    continue
                asks = ~holds[a:b]
                before = np.concatenate([[0], np.cumsum(held)])[r] + earlier_less(r, holds[a:b])
                sums[group] = sums.get(group, 0) + int(before[asks].sum())
                held += np.bincount(r[~asks], minlength=len(held))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), batch.schema.field("group").type), pa.array(list(sums.values()), pa.int64())], names=["group", "found"])

    return rows.mapInArrow(run, f"group {kind}, found bigint")


def rank_inversions(rows: DataFrame, before: str, after: str, group: str = "group_id", tolerance: float = 1e-12) -> DataFrame:
    """(group, inversions): per group, pairs whose order flips between two scores, both differences beyond the tolerance.

    Every row holds a point (before, after) and asks for the points that lie below it in before and above it in after, each
    by more than the tolerance. Points are sorted into ranges by before, as many as keep each at about EACH points; answers from the own range are counted by merging.
    Then all are sorted by falling after, and running counts of each earlier range, carried from slice to slice by prefix
    sums, give the rest. A group of any size is many ranges and slices; the sums beside them have a row for each pair of
    the two. Rows with a null score are left out; groups without a row have none here.
    """
    b, a = F.col(before).cast("double"), F.col(after).cast("double")
    known = rows.filter(b.isNotNull() & a.isNotNull())
    both = F.array(F.struct((b - tolerance).alias("x"), F.lit(False).alias("holds"), (a + tolerance).alias("y")), F.struct(b.alias("x"), F.lit(True).alias("holds"), a.alias("y")))
    points = known.select(F.col(group).alias("group"), F.explode(both).alias("p")).select("group", "p.*")
    kind = points.schema["group"].dataType.simpleString()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * known.count() // EACH))
    own = written(_within_ranges(points, kind, parts), "inversions")
    order = [F.col("group"), F.desc("y"), F.col("holds")]
    cut = written(own.repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id()), "inversions")

    counts = cut.filter("holds").groupBy("group", "range", "slice").agg(F.count("*").alias("n"))
    grid = cut.select("group", "slice").distinct().join(cut.select(F.col("group").alias("_g"), "range").distinct(), F.col("group").eqNullSafe(F.col("_g"))).drop("_g")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("group", "slice", "range")]
    filled = grid.alias("l").join(counts.alias("r"), same, "left").select("l.*", F.coalesce("r.n", F.lit(0)).alias("n"))
    earlier = Window.partitionBy("group", "range").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.withColumn("n", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter("n > 0")
    starts = starts.select("slice", "group", F.lit(True).alias("start"), "range", "n", F.lit(True).alias("holds"), F.lit(None).cast("double").alias("y"))
    rest = cut.select("slice", "group", F.lit(False).alias("start"), "range", F.lit(0).cast("long").alias("n"), "holds", "y").unionByName(starts)
    rest = rest.repartition("slice").sortWithinPartitions("slice", "group", F.desc("start"), F.desc("y"), "holds")
    found = own.select("group", "found").unionByName(_across_ranges(rest, kind))
    return found.groupBy(F.col("group").alias(group)).agg(F.sum("found").alias("inversions"))
