"""Facts from script files: functions, HTTP calls and their states (F1, F2, F7), by Spark's own expressions.

Facts of other languages come as tables of the schema FACT, one row a fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stable_id, url_host, url_path, worst

VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "request")
FACT = (
    "repo_id string, file string, fact string, name string, kind string, owner string, line int, end_line int, target string, library string, method string, url string, "
    "url_state string, request_fields array<string>, request_state string, query_parameters array<string>, headers array<string>, response_fields array<string>, response_state string"
)
_CALL = r"(?s)\b(axios|client|apiClient)\.(get|post|put|patch|delete)\(\s*[`'\"]([^`'\"]+)[`'\"]\s*(?:,\s*(\{[^}]*\}))?|\bfetch\(\s*[`'\"]([^`'\"]+)[`'\"]\s*(?:,\s*(\{(?:[^{}]|\{[^{}]*\})*\}))?"


def script_functions(files: DataFrame) -> DataFrame:
    """functions of script files by line; a file without any has one MODULE symbol."""
    lines = files.select("repo_id", F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("at", "text"))
    name = F.coalesce(F.nullif(F.regexp_extract("text", r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>", 1), F.lit("")))
    found = lines.select("repo_id", "file", name.alias("qualified_name"), (F.col("at") + 1).alias("line")).filter("qualified_name is not null").withColumn("kind", F.lit("FUNCTION"))
    rest = files.select("repo_id", F.col("path").alias("file")).join(found, ["repo_id", "file"], "left_anti").select("repo_id", "file", F.lit("<module>").alias("qualified_name"), F.lit(1).alias("line"), F.lit("MODULE").alias("kind"))
    return found.unionByName(rest).withColumn("symbol_id", stable_id("symbol-", "repo_id", "file", "qualified_name"))


def _matches(texts: DataFrame, column: str, pattern: str, group: int = 0) -> DataFrame:
    """texts with at, match (a group of the pattern) and the line it begins on, a row for each match.

    Line breaks are added up once along the matches and the pieces between them; equal matches keep their own lines.
    """
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    whole, pieces = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0)), F.split(F.col(column), pattern)
    begun = F.array().cast("array<int>")
    gaps = F.zip_with(F.transform(pieces, breaks), F.transform(whole, breaks), lambda gap, own: F.struct(F.coalesce(gap, F.lit(0)).alias("gap"), F.coalesce(own, F.lit(0)).alias("own")))
    add = lambda s, x: F.struct((s["n"] + x["gap"] + x["own"]).alias("n"), F.array_append(s["lines"], s["n"] + x["gap"] + 1).alias("lines"))
    lines = F.aggregate(gaps, F.struct(F.lit(0).alias("n"), begun.alias("lines")), add, lambda s: s["lines"])
    both = F.arrays_zip(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(group)).alias("match"), F.slice(lines, 1, F.size(whole)).alias("line"))
    return texts.select("*", F.posexplode(both).alias("at", "_m")).select(*texts.columns, "at", "_m.match", "_m.line")


def link_scan(texts: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """(key, ordinal, match, line): matches of a pattern's first group and the line each stands on."""
    return _matches(texts.select(key, column), column, pattern, 1).select(key, F.col("at").alias("ordinal"), "match", "line")


def script_calls(files: DataFrame) -> DataFrame:
    """axios, client and fetch calls with method, URL, body keys and line; the owner is the file's first function."""
    rows = _matches(files.select("repo_id", F.col("path").alias("file"), "content"), "content", _CALL).withColumnRenamed("match", "call")
    part = lambda i: F.regexp_extract("call", _CALL, i)
    url = F.coalesce(F.nullif(part(3), F.lit("")), part(5))
    body = F.coalesce(F.nullif(part(4), F.lit("")), F.nullif(F.regexp_extract(part(6), r"body\s*:\s*JSON\.stringify\((\{[^}]*\})", 1), F.lit("")))
    keys = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"[{,]\s*['\"]?([A-Za-z_$][\w$]*)['\"]?\s*(?=[:,}])"), F.lit(1))))
    method = F.coalesce(F.nullif(F.lower(part(2)), F.lit("")), F.nullif(F.lower(F.regexp_extract(part(6), r"method\s*:\s*['\"](\w+)", 1)), F.lit("")), F.lit("get"))
    resolved = F.regexp_replace(url, r"\$\{[^}]*\}", "{dynamic}")
    first = script_functions(files).groupBy("repo_id", "file").agg(F.min_by(F.struct("symbol_id", F.col("qualified_name").alias("symbol")), "line").alias("s"))
    out = rows.select("repo_id", "file", "at", "line", F.when(part(1) == "", "fetch").otherwise("axios").alias("library"), method.alias("method"), resolved.alias("url"), F.when(body.isNotNull(), keys).otherwise(F.array().cast("array<string>")).alias("request_fields"))
    out = _located(out).join(first, ["repo_id", "file"], "left")
    none = F.array().cast("array<string>")
    return out.select(stable_id("call-", "repo_id", "file", "line", "at").alias("call_id"), "repo_id", "file", "s.symbol_id", "s.symbol", "line", "library", F.lit("direct").alias("invocation_kind"), "method", "host", "path", "url_state", "request_fields", F.lit("EXACT").alias("request_state"), none.alias("query_parameters"), none.alias("headers"), none.alias("response_fields"), F.lit("EXACT").alias("response_state"))


def _located(rows: DataFrame) -> DataFrame:
    """host and path of a URL, PARTIAL where a part is dynamic."""
    absolute = F.col("url").rlike("^https?://")
    safe = F.replace(F.replace("url", F.lit("{"), F.lit("%7B")), F.lit("}"), F.lit("%7D"))
    back = lambda c: F.replace(F.replace(c, F.lit("%7B"), F.lit("{")), F.lit("%7D"), F.lit("}"))
    return rows.withColumn("host", F.when(absolute, url_host(safe))).withColumn("path", F.when(absolute, F.coalesce(F.nullif(back(url_path(safe)), F.lit("")), F.lit("/"))).otherwise(F.regexp_replace("url", r"[?#].*$", ""))).withColumn("url_state", F.when(F.col("url").isNull(), "UNRESOLVED").when(F.col("url").contains("{dynamic}"), "PARTIAL").otherwise("EXACT"))


def overall_state(calls: DataFrame) -> DataFrame:
    """the worst of URL, request (if it has fields) and response states."""
    request = F.when((F.size("request_fields") > 0) | (F.col("request_state") != "EXACT"), F.col("request_state")).otherwise("EXACT")
    return calls.withColumn("state", worst(F.col("url_state"), request, F.col("response_state")))
