"""Linking call expressions to symbols across files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stable_id


def module_names(files: DataFrame) -> DataFrame:
    """F8: (repo_id, file, module): each file answers to every suffix of its dotted path."""
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace("file", r"\.pyi?$", ""), r"(^|/)__init__$", ""), "/", ".")
    parts = F.split(dotted, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return files.select("repo_id", "file").distinct().select("repo_id", "file", F.posexplode(F.array_distinct(suffixes)).alias("skipped", "module")).filter("module <> ''")


def bindings(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_id, file, name, kind, member, target_file): imports whose module is one file: the full path first, else the one file of that suffix."""
    rows = facts.filter("fact = 'import'").select("repo_id", "file", "name", "kind", F.split_part(F.col("target"), F.lit(":"), F.lit(1)).alias("module"), F.nullif(F.split_part(F.col("target"), F.lit(":"), F.lit(2)), F.lit("")).alias("member"))
    level = F.length("module") - F.length(F.regexp_replace("module", r"^\.+", ""))
    package = F.split(F.regexp_replace("file", r"/?[^/]*$", ""), "/")
    base = F.array_join(F.slice(package, 1, F.greatest(F.lit(0), F.size(package) - level + 1)), ".")
    rows = rows.withColumn("module", F.when(level > 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(F.regexp_replace("module", r"^\.+", ""), F.lit("")))).otherwise(F.col("module")))
    owners = modules.groupBy("repo_id", "module").agg(F.count_distinct("file").alias("n"), F.min("file").alias("only"), F.min(F.when(F.col("skipped") == 0, F.col("file"))).alias("whole"))
    owners = owners.select("repo_id", "module", F.coalesce("whole", F.when(F.col("n") == 1, F.col("only"))).alias("target_file")).filter("target_file is not null")
    direct = rows.join(owners, ["repo_id", "module"], "left")
    inner = owners.select(F.col("repo_id").alias("_repo"), F.col("module").alias("_inner"), F.col("target_file").alias("_inner_file"))
    both = direct.join(inner, (F.col("repo_id") == F.col("_repo")) & (F.concat_ws(".", "module", "member") == F.col("_inner")), "left")
    as_module = F.col("_inner_file").isNotNull()
    return both.select("repo_id", "file", "name", F.when(as_module, "module").otherwise(F.col("kind")).alias("kind"), F.when(~as_module, F.col("member")).alias("member"), F.coalesce("_inner_file", "target_file").alias("target_file"))


def link(facts: DataFrame, symbols: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): calls of own names, imported names, module members, own methods and local classes' methods."""
    calls = facts.filter("fact = 'call'").select("repo_id", "file", "owner", "line", "name", F.col("kind").alias("how"), "target")
    own = symbols.select("repo_id", F.col("file").alias("_f"), F.col("qualified_name").alias("_q"), F.col("symbol_id").alias("callee_id"))
    known = bound.select("repo_id", "file", F.col("name").alias("_name"), F.col("kind").alias("_kind"), "member", "target_file").dropDuplicates(["repo_id", "file", "_name"])
    key = F.when(F.col("how") == "module", F.col("target")).when(F.col("how") == "object", F.split_part(F.col("name"), F.lit("."), F.lit(1))).otherwise(F.col("name"))
    rows = calls.withColumn("_name", key).join(known, ["repo_id", "file", "_name"], "left")
    rest = F.when(F.col("how") == "object", F.concat(F.lit("."), F.split_part(F.col("name"), F.lit("."), F.lit(2)))).otherwise("")
    imported = F.when(F.col("target_file").isNotNull() & (F.col("_kind") == "name"), F.concat(F.coalesce("member", "_name"), rest)).when(F.col("target_file").isNotNull() & (F.col("how") == "module"), F.col("name"))
    rows = rows.withColumn("_f", F.when(imported.isNotNull(), F.col("target_file")).when(F.col("how").isin("name", "self", "object"), F.col("file"))).withColumn("_q", F.when(imported.isNotNull(), imported).when(F.col("how").isin("name", "self", "object"), F.col("name")))
    rows = rows.join(own, ["repo_id", "_f", "_q"], "left").withColumn("caller_id", stable_id("symbol-", "repo_id", "file", "owner"))
    edges = rows.filter("callee_id is not null").select(stable_id("edge-", "caller_id", "callee_id", "line").alias("edge_id"), "repo_id", "caller_id", "callee_id", "line", F.lit("EXACT").alias("state")).dropDuplicates(["edge_id"])
    reason = F.when(F.col("how") == "dynamic", "DYNAMIC_CALL").when(F.col("target_file").isNotNull(), "SYMBOL_NOT_FOUND").when(F.col("how") == "module", "UNKNOWN_OBJECT").otherwise("UNKNOWN_NAME")
    return edges, rows.filter("callee_id is null").select("repo_id", "file", "caller_id", "name", "line", reason.alias("reason"))


def coverage(files: DataFrame, facts: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """one row a repository."""
    a = files.groupBy("repo_id").agg(F.count("*").alias("files_found"))
    b = facts.groupBy("repo_id").agg(F.count_if(F.expr("fact = 'error'")).alias("files_failed"), F.count_if(F.expr("fact = 'symbol'")).alias("symbols"), F.count_if(F.expr("fact = 'http'")).alias("http_calls"), F.count_if(F.expr("fact = 'call'")).alias("calls_inspected"))
    c, d = edges.groupBy("repo_id").agg(F.count("*").alias("edges")), unresolved.groupBy("repo_id").agg(F.count("*").alias("calls_unresolved"))
    out = a.join(b, "repo_id", "left").join(c, "repo_id", "left").join(d, "repo_id", "left").na.fill(0)
    return out.withColumn("files_parsed", F.col("files_found") - F.col("files_failed"))
