"""Audits of datasets and logs: violations, duplicates, leakage, hash chains, seals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SEPARATOR

ZERO = "0" * 64
#: Ids that a task counts, which bounds its memory.
EACH = 500_000


def dataset_violations(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(row_id, code): repeated ids, unknown scenarios, fingerprints that differ, paths that start elsewhere."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // EACH))
    repeated = rows.select("row_id").repartition(parts, "row_id").groupBy("row_id").count().filter("count > 1").select("row_id", F.lit("DUPLICATE_ID").alias("code"))
    known = scenarios.select("scenario_id", F.col("scenario_fingerprint").alias("_fp"), F.lit(True).alias("_known"))
    told = rows.select("row_id", "scenario_id", "scenario_fingerprint").join(known.hint("merge"), "scenario_id", "left")
    code = F.when(F.col("_known").isNull(), "UNKNOWN_SCENARIO").when(~F.col("scenario_fingerprint").eqNullSafe(F.col("_fp")), "FINGERPRINT")
    unlike = told.select("row_id", code.alias("code")).filter("code is not null")
    path = rows.filter((F.size("truth_path") > 0) & (F.element_at("truth_path", 1) != F.col("symbol"))).select("row_id", F.lit("PATH_START").alias("code"))
    return repeated.unionByName(unlike).unionByName(path)


def duplicate_counts(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, duplicates): rows beyond the first of each value."""
    return shared_values(rows, fields).groupBy("field").agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("duplicates"))


def shared_values(rows: DataFrame, fields: Sequence[str], partition: str | None = None) -> DataFrame:
    """(field, value, n, partitions) of the non-null values of several fields, in one shuffle."""
    own = F.col(partition) if partition else F.lit(None).cast("string")
    long = rows.select(own.alias("_p"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).filter("x.value is not null")
    return long.groupBy("x.field", "x.value").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("_p")).alias("partitions"))


def overlap_matrix(rows: DataFrame, fields: Sequence[str], partition: str = "split_partition") -> DataFrame:
    """(field, a, b, shared): values of a field that partitions a < b both hold. Pairs without any are left out."""
    several = shared_values(rows, fields, partition).filter("size(partitions) > 1")
    pairs = several.select("field", F.explode(F.flatten(F.transform("partitions", lambda a: F.transform(F.filter("partitions", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy("field", "p.a", "p.b").agg(F.count("*").alias("shared"))


def split_violations(rows: DataFrame, fields: Sequence[str], partition: str = "split_partition") -> DataFrame:
    """Values that two partitions own, and rows without a partition."""
    owned = shared_values(rows, fields, partition).filter("size(partitions) > 1").select("field", "value", "partitions")
    lost = rows.filter(F.col(partition).isNull()).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(partition).alias("field"), F.col("n").cast("string").alias("value"), F.array().cast("array<string>").alias("partitions"))
    return owned.unionByName(lost)


def historical_overlap(fresh: DataFrame, history: Sequence[DataFrame], fields: Sequence[str]) -> DataFrame:
    """(field, fresh, old, overlap): distinct values of each field in the fresh rows, in the old ones, in both."""
    mark = lambda df, name: shared_values(df, fields).select("field", "value", F.lit(name).alias("side"))
    both = mark(fresh, "fresh")
    for h in history:
        both = both.unionByName(mark(h, "old"))
    each = both.groupBy("field", "value").agg(F.max(F.col("side") == "fresh").alias("f"), F.max(F.col("side") == "old").alias("o"))
    return each.groupBy("field").agg(F.count_if("f").alias("fresh"), F.count_if("o").alias("old"), F.count_if(F.expr("f and o")).alias("overlap"))


def event_digest(*body: Column) -> Column:
    """SHA-256 over an event's body, the fields in the order given."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(c.cast("string"), F.lit("")) for c in body]), 256)


def canonical_event() -> Column:
    """Digest of an event of AUDIT_LOG: its canonical JSON without the hash itself."""
    entries = F.map_from_entries(F.array_sort(F.map_entries("artifact_digests")))
    return F.sha2(F.to_json(F.struct(entries.alias("artifact_digests"), "configuration_digest", "event_index", "event_type", "previous_event_hash")), 256)


def chain_violations(log: DataFrame, digest: Column, order: Sequence[str] | None = None, key: str = "log_id") -> DataFrame:
    """(key, event_index, code): indexes with gaps, hashes that do not follow, digests and states that are wrong."""
    w = Window.partitionBy(key).orderBy("event_index")
    rows = log.select(key, "event_index", "event_type" if order else F.lit(None).cast("string").alias("event_type"), "previous_event_hash", "event_hash", digest.alias("_own"), F.row_number().over(w).alias("_n"), F.lag("event_hash", 1, ZERO).over(w).alias("_before"))
    codes = [(F.col("event_index") != F.col("_n") - 1, "INDEX"), (~F.col("previous_event_hash").eqNullSafe(F.col("_before")), "CHAIN"), (~F.col("event_hash").eqNullSafe(F.col("_own")), "DIGEST")]
    if order:
        codes.append((~F.element_at(F.array(*[F.lit(s) for s in order], F.lit(None).cast("string")), F.least(F.col("_n"), F.lit(len(order) + 1)).cast("int")).eqNullSafe(F.col("event_type")), "STATE"))
    return rows.select(key, "event_index", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in codes]))).alias("code"))


def opened(rows: DataFrame, current: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows of a sealed table, if a frozen digest equals the current one (content_sha256); else none."""
    agree = current.join(frozen, "content_sha256", "left_semi").select(F.lit(True).alias("_open")).limit(1)
    return rows.join(F.broadcast(agree), F.lit(True), "left_semi")
