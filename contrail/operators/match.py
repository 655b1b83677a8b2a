"""Matching changes to the calls that they touch (M1-M8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_variable, segments, stable_id, worst


@dataclass(frozen=True)
class MatchPolicy:
    """Weights of the evidence of a match."""

    host: float = 0.20
    host_unknown: float = 0.05
    path_exact: float = 0.30
    path_template: float = 0.24
    path_partial: float = 0.18
    method: float = 0.20
    field: float = 0.20
    direct: float = 0.05
    url_exact: float = 0.05
    url_partial: float = 0.02

    @property
    def operation_maximum(self) -> float:
        return self.host + self.path_exact + self.method + self.direct + self.url_exact


POLICY = MatchPolicy()
OPERATION_LEVEL = ("endpoint_removed", "http_method_removed", "security_requirement_changed")


def _mask(parts: Column) -> Column:
    """1 for each variable segment, 0 for the others."""
    return F.array_join(F.transform(parts, lambda x: F.when(is_variable(x), "1").otherwise("0")), "")


def _blanked(parts: Column, *masks: str) -> Column:
    """The path without the segments that are variable in any of the masks."""
    open_ = lambda i: F.greatest(*[F.substr(F.col(m), i + 1, F.lit(1)) for m in masks]) == "1"
    return F.array_join(F.transform(parts, lambda x, i: F.when(open_(i), "*").otherwise(x)), "/")


def candidate_pairs(changes: DataFrame, calls: DataFrame) -> DataFrame:
    """M1, M2: changes and calls of equal method whose paths match segment by segment.

    A mask says which segments are variable. Each side joins the few masks of the other one of as many segments, blanks
    the segments that either leaves open, and then the whole paths are equal: the join makes matches only. Calls that are a
    stream are asked for no masks (see _open_pairs).
    """
    if calls.isStreaming:
        return _open_pairs(changes, calls)
    masked = lambda df, as_: df.withColumn("_p", segments(F.col("path"))).select(F.lower("method").alias("_m"), F.size("_p").alias("_n"), _mask(F.col("_p")).alias(as_), "_p", F.struct(*df.columns).alias("_row"))
    a, b = masked(changes, "_a"), masked(calls.filter(F.col("url_state").isin("EXACT", "PARTIAL")), "_b")
    keyed = lambda df, other, mask: df.join(other.select("_n", mask).distinct(), "_n").select("_m", "_a", "_b", _blanked(F.col("_p"), "_a", "_b").alias("_key"), "_row")
    left = keyed(a, b, "_b").withColumnRenamed("_row", "change")
    return left.join(keyed(b, a, "_a").withColumnRenamed("_row", "call"), ["_m", "_a", "_b", "_key"]).select("change", "call")


def _open_pairs(changes: DataFrame, calls: DataFrame) -> DataFrame:
    """candidate_pairs of changes with a stream of calls, without state: every call is joined with static tables alone.

    A call is blanked by the masks of the changes of as many segments and by its own; a change by its own mask and by
    every set of its other segments, so its rows are two to the power of its path's fixed segments.
    """
    parts = lambda df: df.withColumn("_p", segments(F.col("path"))).withColumns({"_m": F.lower("method"), "_n": F.size("_p"), "_own": _mask(F.col("_p"))})
    either = lambda a, b, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.greatest(F.substr(a, i, F.lit(1)), F.substr(b, i, F.lit(1)))), "")
    own = F.struct(*changes.columns).alias("change")
    left = parts(changes).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.col("_n")).cast("long") - 1)))
    left = left.filter("_n > 0").withColumn("_u", either(F.lpad(F.bin("_k"), F.col("_n"), F.lit("0")), F.col("_own"), F.col("_n")))
    left = left.select("_m", F.col("_own").alias("_a"), "_u", _blanked(F.col("_p"), "_u", "_u").alias("_key"), own).distinct()
    masks = parts(changes).select("_n", F.col("_own").alias("_a")).distinct()
    right = parts(calls.filter(F.col("url_state").isin("EXACT", "PARTIAL"))).filter("_n > 0").join(masks, "_n").withColumn("_u", either(F.col("_a"), F.col("_own"), F.col("_n")))
    right = right.select("_m", "_a", "_u", _blanked(F.col("_p"), "_u", "_u").alias("_key"), F.struct(*calls.columns).alias("call"))
    return right.join(left, ["_m", "_a", "_u", "_key"]).select("change", "call")


def path_weight(policy: MatchPolicy = POLICY) -> tuple[Column, Column]:
    """M2: (weight, state) of the path evidence."""
    same, partial = F.col("change.path") == F.col("call.path"), (F.col("call.url_state") == "PARTIAL") | F.col("call.path").contains("{dynamic}")
    return F.when(same, policy.path_exact).when(partial, policy.path_partial).otherwise(policy.path_template), F.when(partial, "PARTIAL").otherwise("EXACT")


def host_weight(hosts: Column, policy: MatchPolicy = POLICY) -> tuple[Column, Column]:
    """M3: (weight, state) of the host evidence; a null weight is another host."""
    known, host = F.coalesce(F.size(hosts), F.lit(0)) > 0, F.lower("call.host")
    hit = F.array_contains(F.transform(hosts, F.lower), host)
    weight = F.when(~known, 0.0).when(host.isNull(), policy.host_unknown).when(hit, policy.host)
    return weight, F.when(known & hit, "EXACT").otherwise("PARTIAL")


def _plain(field: Column) -> Column:
    """Field names as calls have them: items before items[] says nothing."""
    return F.replace(field, F.lit("items.items[]"), F.lit("items[]"))


def used_names() -> Column:
    """M4: what of the change the call uses; empty is a call that the change does not touch, null an operation-level change."""
    location = F.col("change.location")
    parameter = F.split(location, r"\.", 3)
    where, name = F.element_at(parameter, 2), F.element_at(parameter, 3)
    used = F.when(where == "query", F.array_contains("call.query_parameters", name)).when(where == "header", F.array_contains(F.transform("call.headers", F.lower), F.lower(name))).otherwise((where == "path") & F.col("call.path").isNotNull())
    field = _plain(F.regexp_replace(location, r"^(request|response)\.[^\]]*\]?\.?", ""))
    matching = lambda fields: F.array_sort(F.filter(F.col(fields), lambda f: (_plain(f) == field) & (field != "")))
    none = F.array().cast("array<string>")
    return (
        F.when(F.col("change.category").isin(*OPERATION_LEVEL), F.lit(None).cast("array<string>"))
        .when(F.col("change.category") == "required_parameter_added", F.when(F.coalesce(used, F.lit(False)), F.array(F.concat_ws(".", where, name))).otherwise(none))
        .when(location.startswith("request."), F.coalesce(matching("call.request_fields"), none))
        .when(location.startswith("response."), F.coalesce(matching("call.response_fields"), none))
        .otherwise(none)
    )


def impacts(changes: DataFrame, calls: DataFrame, hosts: DataFrame | None = None, policy: MatchPolicy = POLICY) -> DataFrame:
    """M5-M7: one row a change and call that it touches: score in [0, 1], certainty, evidence.

    hosts (api_id, hosts) is joined on the change's api_id; without it hosts are unknown.
    """
    pairs = candidate_pairs(changes, calls)
    if hosts is not None:
        pairs = pairs.join(hosts.select(F.col("api_id").alias("_api"), "hosts"), F.col("change.api_id") == F.col("_api"), "left").drop("_api")
    else:
        pairs = pairs.withColumn("hosts", F.lit(None).cast("array<string>"))
    host, host_state = host_weight(F.col("hosts"), policy)
    path, path_state = path_weight(policy)
    rows = pairs.select("change", "call", used_names().alias("used"), host.alias("host"), host_state.alias("host_state"), path.alias("path"), path_state.alias("path_state"))
    rows = rows.filter("host is not null and (used is null or size(used) > 0)")
    location = F.col("change.location")
    field = F.col("change.category") != "required_parameter_added"
    field_state = F.when(field & location.startswith("request."), F.coalesce("call.request_state", F.lit("EXACT"))).when(field & location.startswith("response."), F.when(location.rlike(r"^response\.(default|200)"), F.coalesce("call.response_state", F.lit("EXACT"))).otherwise(worst(F.coalesce("call.response_state", F.lit("EXACT")), F.lit("PARTIAL")))).otherwise("EXACT")
    url = F.when(F.col("call.url_state") == "EXACT", policy.url_exact).otherwise(policy.url_partial)
    with_field = F.col("used").isNotNull()
    maximum = F.lit(policy.operation_maximum) + F.when(with_field, policy.field).otherwise(0.0)
    parts = [("api_identity", F.col("host"), F.col("host_state")), ("endpoint_path_match", F.col("path"), F.col("path_state")), ("http_method_match", F.lit(policy.method), F.lit("EXACT")), ("direct_http_invocation", F.lit(policy.direct), F.lit("EXACT")), ("url_resolution", url, F.col("call.url_state")), ("changed_name_used", F.when(with_field, policy.field), F.when(with_field, field_state))]
    evidence = F.array_compact(F.array(*[F.when(w.isNotNull(), F.struct(F.lit(n).alias("feature"), (w / maximum).alias("contribution"), s.alias("state"))) for n, w, s in parts]))
    total = sum(F.coalesce(w, F.lit(0.0)) for _, w, _ in parts)
    return rows.select(
        stable_id("direct-impact-", "change.change_id", "call.call_id").alias("impact_id"), "change.change_id", "call.call_id", F.col("call.repo_id").alias("repo_id"), F.col("call.symbol_id").alias("symbol_id"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / maximum)).alias("score"), worst(F.col("path_state"), F.col("host_state"), F.col("call.url_state"), field_state).alias("certainty"), F.coalesce("used", F.array().cast("array<string>")).alias("used"), evidence.alias("evidence"),
    )


def evaluated(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """M8: (change_id, call_id) of the calls that were looked at for changes without an impact, a row each."""
    looked = pairs.select(F.col("change.change_id").alias("change_id"), F.col("call.call_id").alias("call_id")).distinct()
    return looked.join(found.select("change_id").distinct(), "change_id", "left_anti")


def unmatched(changes: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """M8: changes without an impact, with the number of calls that were looked at (evaluated names them)."""
    looked = evaluated(pairs, found).groupBy("change_id").agg(F.count("*").alias("looked_at"))
    return changes.join(found, "change_id", "left_anti").join(looked, "change_id", "left").fillna(0, ["looked_at"])
