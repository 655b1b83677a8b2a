"""Choosing bounded evidence for a repair."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import unsafe_path

#: Default limits in characters and files.
BUDGET, MAX_FILES, CALLER_DISTANCE = 8000, 8, 2
ROLES = {"API_CHANGE": 1, "CALL_SITE": 2, "OWNING_SYMBOL": 3, "REQUEST_EVIDENCE": 4, "PLAN_EVIDENCE": 5, "CALLER": 6}


def context_candidates(parts: dict[str, DataFrame], required: Sequence[str] = ("API_CHANGE", "CALL_SITE", "OWNING_SYMBOL")) -> DataFrame:
    """Tables by role, each (context_id, file, symbol, start_line, end_line, content, graph_distance, provenance_ids), as one."""
    out = None
    for role, df in parts.items():
        if role == "CALLER":
            df = df.filter(F.col("graph_distance") <= CALLER_DISTANCE)
        own = df.select("context_id", F.lit(role).alias("role"), "file", "symbol", "start_line", "end_line", "content", F.sha2("content", 256).alias("content_hash"), F.lit(ROLES[role]).alias("priority"), F.lit(role in required).alias("required"), "graph_distance", "provenance_ids")
        out = own if out is None else out.unionByName(own)
    return out


def cut_spans(spans: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans with content, omissions with reason): lines start_line to end_line of each span's file."""
    rows = spans.drop("content").join(files.select("repo_id", F.col("path").alias("file"), F.col("content").alias("source")), ["repo_id", "file"], "left")
    lines = F.split("source", "(?<=\n)")
    count = F.size(F.filter(lines, lambda x: x != ""))
    reason = F.coalesce(unsafe_path(F.col("file")), F.when(F.col("source").isNull(), "FILE_MISSING"), F.when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > count), "SPAN_OUT_OF_RANGE"))
    text = F.array_join(F.slice(lines, F.greatest(F.lit(1), F.col("start_line")), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)), "")
    rows = rows.withColumn("reason", reason).withColumn("content", F.when(F.col("reason").isNull(), text)).drop("source")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").drop("content")


def merge(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, omissions): equal span and content, then equal role and content, become one item; repeats are logged."""
    span, role = ["context_id", "file", "start_line", "end_line", "content_hash"], ["context_id", "role", "content_hash"]
    order = ("priority", F.coalesce("graph_distance", F.lit(1 << 20)), "file", "start_line", "end_line", "role")

    def once(df: DataFrame, keys: list[str]) -> DataFrame:
        kept = [c for c in df.columns if c not in (*keys, "required", "provenance_ids", "graph_distance")]
        best = F.min_by(F.struct(*kept), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("b")
        g = df.groupBy(*keys).agg(best, F.bool_or("required").alias("required"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("provenance_ids")))).alias("provenance_ids"), F.min("graph_distance").alias("graph_distance"))
        return g.select(*keys, *[F.col(f"b.{c}").alias(c) for c in kept], "required", "provenance_ids", "graph_distance").select(*df.columns)

    n = F.row_number().over(Window.partitionBy(*span).orderBy(*order))
    repeats = candidates.withColumn("_n", n).filter("_n > 1").select("context_id", "role", "file", "start_line", "end_line", F.lit("DUPLICATE").alias("reason"))
    # both keys hold the context and the content: rows dealt by these two move once
    return once(once(candidates.repartition("context_id", "content_hash"), span), role), repeats


def required_status(items: DataFrame, budget: int = BUDGET, files: int = MAX_FILES) -> DataFrame:
    """(context_id, status): required items that alone break a limit refuse the whole context."""
    need = F.col("required")
    g = items.groupBy("context_id").agg(F.coalesce(F.sum(F.when(need, F.length("content"))), F.lit(0)).alias("c"), F.count_distinct(F.when(need, F.col("file"))).alias("f"))
    return g.select("context_id", F.when(F.col("c") > budget, "BUDGET_EXCEEDED").when(F.col("f") > files, "TOO_MANY_FILES").otherwise("OK").alias("status"))


FILL_ORDER = ("priority", "graph_distance", "file", "start_line", "end_line", "role", "content_hash")


def fill(
    items: DataFrame, key: str = "context_id", order: Sequence[str | Column] = FILL_ORDER, size: str | Column = "size", file: str = "file",
    required: str | None = "required", budget: int = BUDGET, files: int = MAX_FILES,
) -> DataFrame:
    """Items with selected: required ones first, then in order; one that does not fit is skipped, later ones may fit.

    Of items of one context, size and file the taken ones are the first in order: room and files only get less. So only the
    first budget / size of them are candidates, numbered apart, and a hot context does not go whole to one task. Candidates
    go through a fold sorted by context and order, which holds the used size and the files, files at most. Where any size is
    below 0, room can grow again, and all items are candidates. Items without a size never fit; items without a file count
    for none.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    sorting = {"_first": ~F.col(required) if required else F.lit(False), **{f"_o{i}": column(o) for i, o in enumerate(order)}, "_size": column(size).cast("long"), "_file": F.col(file), "_tie": F.xxhash64(*items.columns)}
    rows = items.select(F.struct(*items.columns).alias("row"), F.col(key).alias("_key"), *[c.alias(n) for n, c in sorting.items()])
    may = F.col("_size").isNotNull()
    if rows.filter("_size < 0").isEmpty():
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_size", "_file").orderBy(*sorting)))
        may &= F.col("_n").cast("decimal(20,0)") * F.col("_size") <= budget
    never = rows.filter(~may).select("row.*", F.lit(False).alias("selected"))
    rows = rows.filter(may).repartition("_key").sortWithinPartitions("_key", *sorting).select("row", "_key", "_size", "_file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, context, used, held = False, None, 0, set()
        for batch in batches:
            picked = []
            for of, n, f in zip(*(batch.column(c).to_pylist() for c in ("_key", "_size", "_file")), strict=True):
                if not begun or of != context:
                    begun, context, used, held = True, of, 0, set()
                fits = n is not None and used + n <= budget and (f is None or f in held or len(held) < files)
                if fits:
                    used += n
                    held |= {f} - {None}
                picked.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(picked, pa.bool_())], names=["row", "selected"])

    out = rows.mapInArrow(run, StructType().add("row", rows.schema["row"].dataType).add("selected", "boolean"))
    return out.select("row.*", "selected").unionByName(never)


def selection_summary(items: DataFrame, budget: int = BUDGET) -> DataFrame:
    """X7."""
    s = F.col("selected")
    return items.groupBy("context_id").agg(
        F.count_if(s & F.col("required")).alias("required_items"), F.count_if(s & ~F.col("required")).alias("optional_items"), F.count_distinct(F.when(s, F.col("file"))).alias("files"), F.count_distinct(F.when(s, F.col("symbol"))).alias("symbols"),
        F.max(F.when(s, F.col("graph_distance"))).alias("max_distance"), F.coalesce(F.sum(F.when(s, F.length("content"))), F.lit(0)).alias("used"), F.lit(budget).alias("budget"), F.count_if(~s).alias("omitted"),
    )


def context_manifest(items: DataFrame) -> DataFrame:
    """(context_id, items, checksum) over the selected items' hashes."""
    chosen = items.filter("selected").groupBy("context_id").agg(F.array_sort(F.collect_list("content_hash")).alias("h"))
    return chosen.select("context_id", F.size("h").alias("items"), F.sha2(F.array_join("h", "\n"), 256).alias("checksum"))
