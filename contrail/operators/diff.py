"""Differences between two contract versions (D1-D14), as anti, semi and equi-joins of normalised tables.

Every function takes the old and the new side as tables without version columns other than the keys named, so that many
contracts are compared at once; `api_id` is part of every key when both sides have it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stable_id

OP = ("path", "method")


def _large(side: DataFrame) -> DataFrame:
    """A side of as many rows as its contracts have parts: joined by sorting, whatever the size of the files it comes from."""
    return side.hint("merge")


def _keys(old: DataFrame, *keys: str) -> list[str]:
    return [*(["api_id"] if "api_id" in old.columns else []), *keys]


def changes(rows: DataFrame, category: str | Column, severity: str, classification: str, location: Column | None = None, certainty: Column | str = "EXACT", detail: Sequence[str] = ()) -> DataFrame:
    """Rows as changes with a stable id; equal ids collapse."""
    api = [F.col("api_id")] if "api_id" in rows.columns else []
    out = rows.select(
        *api, (F.lit(category) if isinstance(category, str) else category).alias("category"), "path", "method", (location if location is not None else F.lit("operation")).alias("location"),
        F.lit(severity).alias("severity"), F.lit(classification).alias("classification"), (F.lit(certainty) if isinstance(certainty, str) else certainty).alias("certainty"), *detail,
    )
    return out.withColumn("change_id", stable_id("api-change-", *([F.col("api_id")] if api else []), "category", "path", "method", "location")).dropDuplicates(["change_id"])


def removed_operations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Operations of old that new lacks: the endpoint is gone, or only the method."""
    gone = old.select(*_keys(old, *OP)).distinct().join(_large(new), _keys(old, *OP), "left_anti")
    alive = new.select(*_keys(old, "path"), F.lit(True).alias("_alive")).distinct()
    split = gone.join(_large(alive), _keys(old, "path"), "left")
    return changes(split, F.when(F.col("_alive").isNull(), "endpoint_removed").otherwise("http_method_removed"), "HIGH", "CLIENT_BREAKING")


def added_required_parameters(old: DataFrame, new: DataFrame) -> DataFrame:
    """D3: parameters that new requires and old did not, in operations of both."""
    keys = _keys(old, *OP, "location", "name")
    before = old.select(*keys, F.col("required").alias("_was"))
    rows = new.filter("required").join(_large(before), keys, "left").filter(~F.coalesce("_was", F.lit(False)))
    return changes(rows, "required_parameter_added", "HIGH", "CLIENT_BREAKING", F.concat_ws(".", F.lit("parameter"), "location", "name"))


def changed_security(old: DataFrame, new: DataFrame) -> DataFrame:
    """Operations of both whose effective security differs; from none to some breaks clients."""
    keys = _keys(old, *OP)
    rows = old.select(*keys, F.col("security").alias("_a")).join(_large(new.select(*keys, F.col("security").alias("_b"))), keys).filter(~F.col("_a").eqNullSafe(F.col("_b")))
    none = F.coalesce(F.size("_a"), F.lit(0)) <= 0
    out = changes(rows.withColumn("_none", none), "security_requirement_changed", "HIGH", "POTENTIALLY_BREAKING", detail=["_none"])
    return out.withColumn("classification", F.when(F.col("_none"), "CLIENT_BREAKING").otherwise("POTENTIALLY_BREAKING")).drop("_none")


NODE = (*OP, "context", "code", "media_type")


def certainty(a: str, b: str) -> Column:
    """From the support status of either node."""
    either = lambda s: (F.col(a) == s) | (F.col(b) == s)
    return F.when(either("UNSUPPORTED"), "UNRESOLVED").when(either("PARTIALLY_SUPPORTED"), "PARTIAL").otherwise("EXACT")


def node_location(node_path: str = "node_path") -> Column:
    """request.body[media].path or response.code[media].path."""
    head = F.concat(F.when(F.col("context") == "request", "request.body").otherwise(F.concat(F.lit("response."), "code")), F.lit("["), "media_type", F.lit("]"))
    return F.concat_ws(".", head, F.when(F.col(node_path) != "", F.col(node_path)))


def removed_properties(old: DataFrame, new: DataFrame) -> DataFrame:
    """Properties of old missing in new below a parent that both have; what lies below them is not told again."""
    keys = _keys(old, *NODE)
    parents = new.select(*keys, F.col("node_path").alias("parent_path"), F.col("support_status").alias("_new")).distinct()
    gone = old.join(_large(new), [*keys, "node_path"], "left_anti").join(_large(parents), [*keys, "parent_path"])
    sure = F.when(certainty("support_status", "_new") == "EXACT", F.when(F.col("context") == "request", "CONDITIONAL").otherwise("EXACT")).otherwise(certainty("support_status", "_new"))
    request = changes(gone.filter("context = 'request'"), "request_property_removed", "MEDIUM", "POTENTIALLY_BREAKING", node_location(), sure)
    return request.unionByName(changes(gone.filter("context = 'response'"), "response_property_removed", "HIGH", "CLIENT_BREAKING", node_location(), sure))


def changed_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of nodes on both sides: types that differ, null no longer allowed, enum values taken away."""
    keys = [*_keys(old, *NODE), "node_path"]
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("types", "nullable", "enum_json", "support_status")])
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in ("types", "nullable", "enum_json", "support_status")])
    both = a.join(_large(b), keys).withColumn("removed_values", F.array_except("old_enum_json", "new_enum_json"))
    sure, at, request = certainty("old_support_status", "new_support_status"), node_location(), F.col("context") == "request"
    types = both.filter("old_types <> new_types")
    out = changes(types, F.when(request, "request_type_changed").otherwise("response_type_changed"), "HIGH", "CLIENT_BREAKING", at, sure)
    nulls = both.filter("old_nullable and not new_nullable")
    null = changes(nulls.withColumn("_request", request), "nullable_removed", "MEDIUM", "POTENTIALLY_BREAKING", at, sure, ["_request"])
    null = null.withColumn("classification", F.when(F.col("_request"), "CLIENT_BREAKING").otherwise("POTENTIALLY_BREAKING")).drop("_request")
    enums = both.filter((F.size("old_enum_json") > 0) & (F.size("new_enum_json") > 0) & (F.size("removed_values") > 0))
    enum = changes(enums, "enum_restricted", "MEDIUM", "POTENTIALLY_BREAKING", at, sure, ["removed_values"])
    return out.unionByName(null).unionByName(enum, allowMissingColumns=True)


def compare(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """All changes between two sides, each a dict of operations, parameters and schema_nodes.

    Nodes below compositions and additionalProperties (compared is false) are not told apart.
    """
    shared = old["operations"].select(*_keys(old["operations"], *OP)).join(_large(new["operations"]), _keys(old["operations"], *OP), "left_semi").distinct()
    keys = _keys(old["operations"], *OP)
    both = lambda side, name: side[name].join(_large(shared), keys, "left_semi")
    nodes = lambda side: both(side, "schema_nodes").filter("compared") if "compared" in side["schema_nodes"].columns else both(side, "schema_nodes")
    parts = [
        removed_operations(old["operations"], new["operations"]),
        added_required_parameters(both(old, "parameters"), both(new, "parameters")),
        changed_security(old["operations"], new["operations"]),
        removed_properties(nodes(old), nodes(new)),
        changed_nodes(nodes(old), nodes(new)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def in_order(rows: DataFrame) -> DataFrame:
    """The order of reports; for sinks."""
    return rows.orderBy("path", "method", "category", "location", "change_id")
