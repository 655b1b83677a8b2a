"""Repair plans and edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the one category that rules can repair.
SUPPORTED = ("request_property_removed",)
LIMITS = {"edits": 20, "characters": 20_000, "one": 8_000}


def repair_support(changes: DataFrame, supported: Sequence[str] = SUPPORTED) -> DataFrame:
    """X9."""
    ok = F.col("category").isin(*supported)
    return changes.withColumn("repairability", F.when(ok, "SUPPORTED").otherwise("UNSUPPORTED")).withColumn("reason", F.when(~ok, F.concat(F.lit("no rule for "), "category")))


def exact_evidence(rows: DataFrame) -> DataFrame:
    """Rows of struct columns change, impact and call, with the conditions that fail and the outcome."""
    c = F.col
    field = F.regexp_replace("change.location", r"^request\.[^\]]*\]?\.?", "")
    conditions = {
        "CHANGE_CERTAINTY": c("change.certainty").isin("EXACT", "CONDITIONAL"), "URL_STATE": c("call.url_state") == "EXACT", "REQUEST_STATE": c("call.request_state") == "EXACT",
        "RESPONSE_STATE": F.coalesce(c("call.response_state"), F.lit("EXACT")) == "EXACT", "IMPACT_CERTAINTY": c("impact.certainty") == "EXACT", "METHOD": F.lower("call.method") == F.lower("change.method"),
        "PATH": c("call.path") == c("change.path"), "HOST": c("call.host").isNotNull(), "REQUEST_LOCATION": c("change.location").startswith("request."), "FIELD_NAMED": field != "",
        "FIELD_USED": F.array_contains("call.request_fields", field), "SUPPORTED": c("change.category").isin(*SUPPORTED),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in conditions.items()]))
    return rows.withColumn("failed", failed).withColumn("outcome", F.when(~c("change.category").isin(*SUPPORTED), "UNSUPPORTED").when(F.size("failed") == 0, "DETERMINISTIC_CANDIDATE").otherwise("AI_REQUIRED"))


def edit_conflicts(edits: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """X11: neighbouring edits of a file with the same range, or that start before an earlier one ends."""
    w = Window.partitionBy(*by).orderBy("start_offset", "end_offset", "edit_id")
    reach = F.max("end_offset").over(w.rowsBetween(Window.unboundedPreceding, -1))
    same = (F.lag("start_offset").over(w) == F.col("start_offset")) & (F.lag("end_offset").over(w) == F.col("end_offset"))
    rows = edits.select(*by, "edit_id", F.lag("edit_id").over(w).alias("previous_id"), F.when(same, "DUPLICATE_EDIT").when(F.col("start_offset") < reach, "OVERLAPPING_EDIT").alias("code"))
    return rows.filter("code is not null")


def apply_edits(files: DataFrame, edits: DataFrame, key: Sequence[str] = ("file",), text: str = "source") -> DataFrame:
    """(key.., new_text, applied, stale): edits whose original text still stands, put in from the end of the file."""
    rows = edits.join(files.select(*key, F.col(text).alias("_s")), [*key])
    now = F.expr("substring(_s, start_offset + 1, end_offset - start_offset)")
    rows = rows.withColumn("fresh", (now == F.col("original_text")) & (F.sha2(now, 256) == F.col("original_hash"))).drop("_s")
    g = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("fresh"), F.struct((-F.col("start_offset")).alias("o"), "start_offset", "end_offset", "replacement")))).alias("e"), F.count_if("fresh").alias("applied"), F.count_if(~F.col("fresh")).alias("stale"))
    put = F.expr(f"aggregate(e, {text}, (s, x) -> concat(substring(s, 1, x.start_offset), x.replacement, substring(s, x.end_offset + 1)))")
    return files.join(g, [*key]).select(*key, put.alias("new_text"), "applied", "stale")


def occurrences(text: Column, part: Column) -> Column:
    """How often a non-empty part stands in a text, overlapping ones too."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.length(part) + 1))
    return F.when(F.length(part) == 0, F.lit(0)).otherwise(F.size(F.filter(places, lambda i: F.substr(text, i, F.length(part)) == part)))


def screen(proposed: DataFrame, items: DataFrame) -> DataFrame:
    """Proposed edits (patch_id, edit_id, context_id, file, item_hash, original_text, replacement) with the first check they fail.

    Passed edits have a null code; offsets say where the text stands in its item.
    """
    known = items.select("context_id", "file", F.col("content_hash").alias("item_hash"), F.col("content").alias("_content"))
    files = items.select("context_id", "file", F.lit(True).alias("_allowed")).distinct()
    rows = proposed.join(files, ["context_id", "file"], "left").join(known, ["context_id", "file", "item_hash"], "left")
    w = Window.partitionBy("patch_id")
    rows = rows.withColumn("_n", F.count("*").over(w)).withColumn("_size", F.sum(F.length("replacement")).over(w))
    times = F.when(F.col("_content").isNotNull(), occurrences(F.col("_content"), F.col("original_text")))
    start = F.expr("locate(original_text, _content)") - 1
    rows = rows.withColumn("start_offset", F.when(times == 1, start)).withColumn("end_offset", F.when(times == 1, start + F.length("original_text")))
    order = Window.partitionBy("patch_id", "file", "item_hash").orderBy("start_offset", "end_offset", "edit_id")
    overlap = F.col("start_offset") < F.max("end_offset").over(order.rowsBetween(Window.unboundedPreceding, -1))
    code = (
        F.when(F.col("original_text").isNull() | F.col("replacement").isNull() | F.col("file").isNull(), "SCHEMA")
        .when((F.col("_n") > LIMITS["edits"]) | (F.col("_size") > LIMITS["characters"]), "PATCH_TOO_LARGE")
        .when(F.length("replacement") > LIMITS["one"], "EDIT_TOO_LARGE").when(F.col("_allowed").isNull(), "FILE_NOT_ALLOWED").when(F.col("_content").isNull(), "STALE_ITEM")
        .when(times == 0, "TEXT_NOT_FOUND").when(times > 1, "TEXT_AMBIGUOUS").when(overlap, "OVERLAPPING_EDIT")
    )
    return rows.withColumn("code", code).drop("_allowed", "_content", "_n", "_size")


def merge_proposed(edits: DataFrame) -> DataFrame:
    """Equal edits of several responses as one, with the indexes of the responses."""
    return edits.groupBy("file", "item_hash", "original_hash", "replacement").agg(F.array_sort(F.collect_set("response_index")).alias("response_indexes"))


def plan_summary(results: DataFrame, edits: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row."""
    a = results.agg(F.count_if(F.expr("outcome = 'DETERMINISTIC_CANDIDATE'")).alias("repairable"), F.count_if(F.expr("outcome = 'UNSUPPORTED'")).alias("unsupported"), F.count_if(F.expr("outcome = 'AI_REQUIRED'")).alias("ambiguous"))
    return a.crossJoin(edits.agg(F.count("*").alias("edits"), F.count_distinct("file").alias("files"))).crossJoin(conflicts.agg(F.count("*").alias("conflicts")))
