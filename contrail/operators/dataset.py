"""Candidate rows, features, splits and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SEPARATOR, hash_partition, stable_id
from ..schemas import PARTITIONS
from .graph import components

SPLIT_FIELDS = ("scenario_id", "repository_family_id", "api_family_id", "migration_id")
FINGERPRINTS = ("source_fp", "candidate_fp", "structural_fp", "heuristic_fp", "template_family_id")

#: Candidates that a task takes where their features are joined.
EACH = 100_000


def candidates(changes: DataFrame, symbols: DataFrame, truth: DataFrame) -> DataFrame:
    """B1: every change with every symbol of its scenario (an equi-join on scenario_id), labelled from the truth table."""
    rows = changes.join(symbols, "scenario_id")
    told = truth.select("scenario_id", "change_id", "symbol_id", "truth_type", "truth_distance")
    rows = rows.join(told, ["scenario_id", "change_id", "symbol_id"], "left")
    return rows.withColumn("label", F.col("truth_type").isNotNull().cast("int")).withColumn("row_id", stable_id("candidate-", "scenario_id", "change_id", "symbol_id"))


#: The features that a candidate row may show a model.
FEATURES = (
    "change_category", "change_severity", "change_certainty", "breaking_classification", "compatibility_direction", "evidence", "endpoint_path_match", "host_match", "method_match",
    "request_field_overlap", "response_field_overlap", "parameter_overlap", "direct_reference", "url_resolution_state", "request_resolution_state", "response_resolution_state", "graph_distance",
    "direct_caller_count", "upstream_caller_count", "coverage_unresolved_calls", "coverage_failed_files", "m4_impact_score", "m6_risk_score", "m6_risk_level",
)


def features(rows: DataFrame, changes: DataFrame, direct: DataFrame, impacted: DataFrame, calls: DataFrame, counts: DataFrame, coverage: DataFrame, risk: DataFrame) -> DataFrame:
    """B2: candidates (scenario_id, change_id, symbol_id and more) with their 24 observed features. No truth column enters.

    changes: change_id with category, severity, certainty, classification, direction, location; direct: the impacts; impacted:
    symbol_id, distance; calls: the call sites; counts: symbol_id with both numbers of callers; coverage and risk: a row a
    scenario_id. A candidate shows its best impact's call, else its symbol's first call. What an impact used is overlap of
    the side that the change's location names. Candidates are dealt over tasks by their number: they shuffle as few bytes.
    """
    none = F.array().cast("array<string>")
    told = changes.select("change_id", *[F.col(c).alias(f"_{c}") for c in ("category", "severity", "certainty", "classification", "direction", "location")])
    best = direct.groupBy("change_id", "symbol_id").agg(F.min_by(F.struct("call_id", "score", "evidence", "used"), F.struct(-F.col("score"), "call_id")).alias("_direct"))
    site = F.struct("url_state", "request_state", "response_state")
    own = calls.groupBy("symbol_id").agg(F.min_by(site, "call_id").alias("_first"))
    by_call = calls.select(F.col("call_id").alias("_call_id"), site.alias("_called"))
    best = best.join(by_call, F.col("_direct.call_id") == F.col("_call_id"), "left").drop("_call_id")  # here, as most candidates have no call and would meet in one task
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // EACH))
    out = rows.repartition(n, "change_id").join(told, "change_id", "left")
    out = out.repartition(n, "change_id", "symbol_id").join(best, ["change_id", "symbol_id"], "left").join(own, "symbol_id", "left")
    out = out.join(impacted.select("symbol_id", F.col("distance").alias("_distance")), "symbol_id", "left").join(counts.select("symbol_id", "direct_callers", "upstream_callers"), "symbol_id", "left")
    out = out.join(coverage.select("scenario_id", "calls_unresolved", "files_failed"), "scenario_id", "left").join(risk.select("scenario_id", "risk_score", "risk_level"), "scenario_id", "left")
    call, names = F.when(F.col("_direct").isNotNull(), F.col("_called")).otherwise(F.col("_first")), F.transform("_direct.evidence", lambda e: e["feature"])
    has = lambda name: F.when(F.array_contains(names, name), True)
    parameter = F.col("_category") == "required_parameter_added"
    used = lambda where: F.coalesce(F.when(where, F.col("_direct.used")), none)
    values = (
        F.col("_category"), F.col("_severity"), F.col("_certainty"), F.col("_classification"), F.col("_direction"), F.coalesce("_direct.evidence", F.array().cast(direct.schema["evidence"].dataType)), has("endpoint_path_match"), has("api_identity"), has("http_method_match"),
        used(~parameter & F.col("_location").startswith("request.")), used(~parameter & F.col("_location").startswith("response.")), used(parameter), F.col("_direct").isNotNull(), call["url_state"], call["request_state"], call["response_state"], F.col("_distance"),
        F.coalesce("direct_callers", F.lit(0)), F.coalesce("upstream_callers", F.lit(0)), F.coalesce("calls_unresolved", F.lit(0)), F.coalesce("files_failed", F.lit(0)), F.col("_direct.score"), F.col("risk_score"), F.col("risk_level"),
    )
    return out.select(*rows.columns, *[v.alias(n) for n, v in zip(FEATURES, values, strict=True)])


def flags() -> Column:
    """What is odd about a feature row, sorted (columns as features gives them, with label and truth_type)."""
    rules = (
        ((F.col("label") == 1) & ~F.col("direct_reference"), "GROUND_TRUTH_POSITIVE_NO_DIRECT_MATCH"),
        ((F.col("truth_type") == "INDIRECT") & F.col("graph_distance").isNull(), "GROUND_TRUTH_INDIRECT_NO_GRAPH_PATH"),
        ((F.col("label") == 0) & F.col("url_resolution_state").isNotNull() & (F.col("m6_risk_score") >= 50), "HARD_NEGATIVE_HEURISTIC_SCORE"),
        (F.col("url_resolution_state") != "EXACT", "PARTIAL_OR_UNRESOLVED_URL"),
        (F.col("coverage_failed_files") > 0, "FAILED_FILE_COVERAGE"),
        (F.col("coverage_unresolved_calls") > 0, "UNRESOLVED_CALL_COVERAGE"),
    )
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules])))


def split(rows: DataFrame, field: str, seed: int) -> DataFrame:
    """Partition by the hash of one of the allowed group fields; equal groups share a partition."""
    if field not in SPLIT_FIELDS:
        raise ValueError(f"cannot split by {field}; allowed: {', '.join(SPLIT_FIELDS)}")
    return rows.withColumn("split_group_id", F.col(field)).withColumn("split_partition", hash_partition(F.col(field), seed))


def scenario_fingerprints(rows: DataFrame, scenario: str, sets: dict[str, Sequence[str]]) -> DataFrame:
    """Per scenario a digest of each named set of columns, whatever the order of its rows.

    The MD5 of each row is added up as four numbers of 32 bits, with the number of rows, so that no scenario's rows meet in
    one array.
    """
    parts = []
    for name, columns in sets.items():
        told = F.md5(F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
        words = [F.sum(F.conv(F.substring(told, 1 + 8 * k, 8), 16, 10).cast("bigint")) for k in range(4)]
        parts.append(F.sha2(F.concat_ws(SEPARATOR, F.count("*"), *words), 256).alias(name))
    return rows.groupBy(scenario).agg(*parts)


def template_text(code: Column) -> Column:
    """Code without literals, names of strings and numbers, so that clones have one text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"\"[^\"\n]*\"|'[^'\n]*'", "S"), r"\b\d+(\.\d+)?\b", "N"), r"\s+", " "))


def clone_components(rows: DataFrame, key: str, fields: Sequence[str] = FINGERPRINTS) -> DataFrame:
    """(key, component): rows that share a value of any field, directly or by others, are one component.

    Each value links its members to its smallest member: as many links as rows, however frequent the value.
    """
    long = rows.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).filter("x.value is not null")
    heads = long.groupBy("x").agg(F.min(key).alias("head"))
    links = long.join(heads, "x").select(F.col(key).alias("a"), F.col("head").alias("b"))
    found = components(links).withColumnRenamed("node", key)
    return rows.select(key).distinct().join(found, key, "left").withColumn("component", F.coalesce("component", key))


def component_split(members: DataFrame, key: str, restricted: DataFrame | None = None, names: Sequence[str] = PARTITIONS) -> DataFrame:
    """Whole components to partitions in turn, in the order of their digests; the counter is shared.

    A component with a member in restricted may only go to the first two partitions. The window runs over one row a
    component, dealt into ranges of the digest first, so that no task orders them all.
    """
    marked = members if restricted is None else members.join(restricted.select(key, F.lit(True).alias("_held")).distinct(), key, "left")
    held = F.lit(False) if restricted is None else F.coalesce(F.max("_held"), F.lit(False))
    parts = marked.groupBy("component").agg(held.alias("held")).withColumn("digest", F.sha2(F.col("component").cast("string"), 256)).withColumn("range", F.substring("digest", 1, 3))
    sizes = parts.groupBy("range").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = parts.join(starts, "range").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("digest")) - 1)
    turn = lambda allowed: F.element_at(F.array(*[F.lit(x) for x in allowed]), (F.col("place") % len(allowed) + 1).cast("int"))
    chosen = ranked.withColumn("split_partition", F.when(F.col("held"), turn(names[:2])).otherwise(turn(names)))
    return members.join(chosen.select("component", "split_partition"), "component")


def partition_counts(rows: DataFrame, partition: str = "split_partition", group: str = "split_group_id", label: str = "label", hidden: Sequence[str] = ("TEST",)) -> DataFrame:
    """Rows, groups, positives and negatives of each partition; labels of hidden partitions stay null."""
    shown = ~F.col(partition).isin(*hidden)
    return rows.groupBy(partition).agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"), F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n")).select(partition, "rows", "groups", F.when(shown, F.col("_p")).alias("positives"), F.when(shown, F.col("_n")).alias("negatives"))


def slice_counts(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, rows) for the values of several fields, in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"))
    return long.groupBy("x.field", "x.value").agg(F.count("*").alias("rows"))


class SealedError(ValueError):
    """Rows of a sealed partition were asked for."""


def partition(rows: DataFrame, name: str, opened: bool = False, column: str = "split_partition", sealed: str = "TEST") -> DataFrame:
    """The rows of a partition; the sealed one is refused until it is opened."""
    if name == sealed and not opened:
        raise SealedError(f"the partition {sealed} is sealed")
    return rows.filter(F.col(column) == name)


def unsealed(rows: DataFrame, column: str = "split_partition", sealed: str = "TEST") -> DataFrame:
    """Rows of which none is sealed: the read fails where one is, and names it."""
    refused = F.raise_error(F.concat(F.lit("row of the sealed partition "), F.col(column)))
    return rows.withColumn(column, F.when(F.coalesce(F.col(column) == sealed, F.lit(False)), refused.cast("string")).otherwise(F.col(column)))


def sealed_view(rows: DataFrame, column: str = "split_partition", sealed: str = "TEST", label: str = "label") -> DataFrame:
    """The sealed partition without its labels."""
    return rows.filter(F.col(column) == sealed).drop(label)
