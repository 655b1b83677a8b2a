"""Scans and sinks: contract documents, source trees, JSON lines, checksums, manifests, artifacts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_json
from ..schemas import EXCLUDED_DIRS


def scan_contracts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, format, text, error_category) of contract documents: JSON if the first character is { or [, otherwise YAML.

    text is JSON for either; documents that are empty, cannot be parsed or are no mapping keep a row with their error.
    """
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return parse_contracts(raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def parse_contracts(docs: DataFrame) -> DataFrame:
    """docs (with text) as scan_contracts gives them. YAML goes through Python workers, JSON stays in the JVM."""
    head = F.substring(F.ltrim(F.regexp_replace("text", "^[\\s\\uFEFF]+", "")), 1, 1)
    docs = docs.withColumn("format", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(head.isin("{", "["), "json").otherwise("yaml"))
    yaml = docs.filter("format = 'yaml'")
    schema = yaml.schema

    def to_json(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml as reader

        def one(text: str) -> str | None:
            try:
                return json.dumps(reader.safe_load(text), sort_keys=True, default=str)
            except (reader.YAMLError, ValueError, TypeError):
                return None

        for frame in frames:
            yield frame.assign(text=frame["text"].map(one))

    both = docs.filter("format <> 'yaml'").unionByName(yaml.mapInPandas(to_json, schema))
    parsed = F.try_parse_json(F.col("text"))
    error = F.when(F.col("format") == "empty", "EMPTY").when(parsed.isNull(), "UNPARSABLE").when(~F.ltrim("text").startswith("{"), "NOT_A_MAPPING")
    return both.withColumn("error_category", error)


def scan_sources(spark: SparkSession, path: str, languages: Sequence[str] = ("py", "ts", "tsx", "js", "jsx")) -> DataFrame:
    """(path, language, content, source_hash, state, error_type) of source files; bad UTF-8 is a row, not a failure."""
    glob = "*.{" + ",".join(languages) + "}"
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    inside = F.split(F.col("path"), "/")
    kept = raw.filter(~F.arrays_overlap(inside, F.array(*[F.lit(x) for x in EXCLUDED_DIRS])))
    text = F.try_validate_utf8(F.decode("content", "UTF-8"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    language = F.when(F.col("path").endswith(".py"), "python").when(F.col("path").rlike(r"\.tsx?$"), "typescript").otherwise("javascript")
    return kept.select("path", language.alias("language"), F.when(valid, text).alias("content"), F.sha2("content", 256).alias("source_hash"), F.when(valid, "PARSED").otherwise("FAILED").alias("state"), F.when(~valid, "ENCODING").alias("error_type"))


def read_jsonl(spark: SparkSession, path: str, schema: str, version: str | None = None) -> DataFrame:
    """Typed rows of JSON lines; a malformed line, or another schema_version, fails the read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if version is None:
        return rows
    wrong = F.raise_error(F.concat(F.lit("unknown schema version "), F.coalesce("schema_version", F.lit("null"))))
    return rows.withColumn("schema_version", F.when(F.col("schema_version") == version, F.col("schema_version")).otherwise(wrong.cast("string")))


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_jsonl, but malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").json(path)


def canonical_lines(rows: DataFrame, key: str = "id") -> DataFrame:
    """(value): canonical JSON of each row, range-sorted by key."""
    return rows.repartitionByRange(key).sortWithinPartitions(key).select(canonical_json(*rows.columns).alias("value"))


def write_canonical(rows: DataFrame, path: str, key: str = "id") -> None:
    canonical_lines(rows, key).write.mode("errorifexists").text(path)


def checksum(rows: DataFrame, key: str = "id", buckets: int = 256) -> DataFrame:
    """One row (content_sha256, rows): digest of the row digests, by bucket of the key's hash and key, then by bucket.

    A bucket's digests meet in one task; take more buckets for more rows. Equal rows in any order have equal checksums.
    """
    digest = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.struct(F.col(key).cast("string").alias("key"), F.sha2(canonical_json(*rows.columns), 256).alias("digest")).alias("row"))
    by = digest.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["digest"]), "\n"), 256).alias("digest"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda r: r["digest"]), "\n")
    return by.agg(F.sha2(whole, 256).alias("content_sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row (rows, digest_xor, digest_sum): a checksum without any order, for tables of any size."""
    h = F.xxhash64(canonical_json(*rows.columns))
    return rows.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("digest_xor"), F.sum(h.cast("decimal(38,0)")).alias("digest_sum"))


def write_once(rows: DataFrame, path: str) -> str:
    """Write a Parquet table; an existing one with the same content is accepted, another is an error."""
    spark = rows.sparkSession
    try:
        rows.write.mode("errorifexists").parquet(path)
        return "written"
    except Exception as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
    if fingerprint(spark.read.schema(rows.schema).parquet(path)).first() != fingerprint(rows).first():
        raise ValueError(f"{path} holds other content")
    return "unchanged"


def manifest(rows: DataFrame, fields: Sequence[str], key: str = "row_id", label: str = "label") -> DataFrame:
    """(field, value, rows, positives, distinct_keys): counts for each value of each field, and in all."""
    long = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.explode(F.map_from_arrays(F.array(F.lit("*"), *[F.lit(f) for f in fields]), F.array(F.lit("*"), *[F.col(f).cast("string") for f in fields]))).alias("field", "value"))
    return long.groupBy("field", "value").agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_distinct("key").alias("distinct_keys"))


def workspace_state(analysis: DataFrame, plans: DataFrame, validations: DataFrame, requests: DataFrame) -> DataFrame:
    """One row a workspace_id with what each step left (null if none) and the step that comes next."""
    out = analysis
    for other in (plans, validations, requests):
        out = out.join(other, "workspace_id", "full")
    step = (
        F.when(F.col("analysis_status").isNull(), "ANALYZE")
        .when(F.col("plan_status").isNull(), "PLAN")
        .when(F.col("validation_status").isNull(), "VALIDATE")
        .when(F.col("validation_status") != "TESTS_PASSED", "REPAIR")
        .when(F.col("request_status").isNull(), "APPLY")
        .otherwise("DONE")
    )
    return out.withColumn("next_step", step)
