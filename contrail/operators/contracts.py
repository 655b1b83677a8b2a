"""Normalising contract documents, many at once.

Documents are JSON text (api_id, version_no, text); they stay VARIANT until their parts are exploded into typed rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import url_host
from ..schemas import METHODS
from ..storage import written

KEYS = ("api_id", "version_no")
KNOWN_KEYWORDS = ("type", "nullable", "enum", "properties", "items", "required", "allOf", "oneOf", "anyOf", "additionalProperties", "$ref", "description", "title", "format", "example", "default", "minimum", "maximum", "minLength", "maxLength", "pattern", "readOnly", "writeOnly", "deprecated")


def parsed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc", F.try_parse_json("text"))


def _get(variant: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(variant if isinstance(variant, Column) else F.col(variant), path, kind)


def _entries(rows: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """Explode an object of VARIANT column value into (key, out)."""
    kept = [F.col(c) for c in rows.columns if c != value]
    listed = F.map_entries(F.try_variant_get(F.col(value), "$", "map<string,variant>"))
    return rows.select(*kept, F.explode(listed).alias("_e")).select(*kept, F.col("_e.key").alias(key), F.col("_e.value").alias(out))


def _joined(*lists: Column) -> Column:
    """Some arrays as one; null ones are left out. What they hold is exploded in one pass over the rows."""
    return F.flatten(F.array_compact(F.array(*lists)))


def rejects(docs: DataFrame, hosts: bool = False) -> DataFrame:
    """(api_id, version_no, reasons) of documents that break a rule; an empty array is an accepted document.

    With hosts, N11's hosts of the same document come from the same pass over its text; null if it lists no servers.
    """
    rows = parsed(docs).withColumn("_listed", _get("doc", "$.paths", "map<string,variant>")).withColumns({"_paths": F.map_keys("_listed"), "_items": F.map_values("_listed")})
    paths, items = F.col("_paths"), F.col("_items")
    no = F.lit(False)
    optional = lambda item, at: F.coalesce(F.exists(_get(item, at, "array<variant>"), lambda p: (_get(p, "$.in", "string") == "path") & ~F.coalesce(_get(p, "$.required", "boolean"), no)), no)
    silent = lambda item, m: _get(item, f"$.{m}", "variant").isNotNull() & (F.coalesce(F.cardinality(_get(item, f"$.{m}.responses", "map<string,variant>")), F.lit(0)) <= 0)
    either = lambda conditions: reduce(lambda a, b: a | b, conditions)
    rules = (
        (F.col("doc").isNull(), "UNPARSABLE"),
        (~F.coalesce(_get("doc", "$.openapi", "string").rlike(r"^3\.\d+(\.\d+)?([-+][A-Za-z0-9.-]+)?$"), no), "VERSION"),
        (F.coalesce(F.trim(_get("doc", "$.info.title", "string")), F.lit("")) == "", "TITLE"),
        (F.coalesce(F.trim(_get("doc", "$.info.version", "string")), F.lit("")) == "", "INFO_VERSION"),
        (paths.isNull(), "PATHS"),
        (F.exists(paths, lambda p: ~p.startswith("/") | p.rlike(r"\s")), "PATH_FORM"),
        (F.exists(items, lambda item: either(optional(item, at) for at in ("$.parameters", *(f"$.{m}.parameters" for m in METHODS)))), "PATH_PARAMETER"),
        (F.exists(items, lambda item: either(silent(item, m) for m in METHODS)), "RESPONSES"),
    )
    return rows.select(*KEYS, F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules])).alias("reasons"), *([_hosts(F.col("doc")).alias("hosts")] if hosts else []))


def _hosts(doc: Column) -> Column:
    urls = F.try_variant_get(doc, "$.servers", "array<struct<url:string>>")
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(urls, lambda s: url_host(s["url"])))))


def accepted(docs: DataFrame) -> DataFrame:
    return docs.join(rejects(docs).filter("size(reasons) = 0"), [*KEYS], "left_semi")


def operations(docs: DataFrame) -> DataFrame:
    """One row a path and method, with the effective security (an operation's own list, also an empty one, wins)."""
    rows = parsed(docs).select(*KEYS, _get("doc", "$.paths", "variant").alias("paths"), _get("doc", "$.security", "variant").alias("root"))
    rows = _entries(_entries(rows, "paths", "path", "item"), "item", "method", "op").filter(F.lower("method").isin(*METHODS))
    own = _get("op", "$.security", "variant")
    security = F.when(own.isNull(), F.col("root")).otherwise(own)
    return rows.select(*KEYS, "path", F.lower("method").alias("method"), F.concat_ws(" ", F.upper("method"), "path").alias("op_id"), _security(security).alias("security"), "op")


def _security(value: Column) -> Column:
    """Alternatives of joint requirements, both sorted; nothing is an empty array."""
    listed = F.try_variant_get(value, "$", "array<map<string,array<string>>>")
    one = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("scheme"), F.array_sort(e["value"]).alias("scopes"))))
    return F.array_sort(F.transform(F.coalesce(listed, F.array().cast("array<map<string,array<string>>>")), one))


def parameters(docs: DataFrame) -> DataFrame:
    """Parameters of each operation; of one (name, location) the operation's entry wins over the path's."""
    rows = parsed(docs).select(*KEYS, _get("doc", "$.paths", "variant").alias("paths"))
    items = _entries(rows, "paths", "path", "item").withColumn("shared", _get("item", "$.parameters", "array<variant>"))
    own = _entries(items, "item", "method", "op").filter(F.lower("method").isin(*METHODS))
    listed = lambda list_, level: F.transform(list_, lambda p, at: F.struct(F.lit(level).alias("level"), at.alias("at"), p.alias("p")))
    both = own.select(*KEYS, "path", F.lower("method").alias("method"), F.explode(_joined(listed(F.col("shared"), "path"), listed(_get("op", "$.parameters", "array<variant>"), "operation"))).alias("e"))
    place = F.when(F.col("e.level") == "operation", 0).otherwise(1 << 32).cast("long") - F.col("e.at")
    typed = both.select(*KEYS, "path", "method", _get("e.p", "$.name", "string").alias("name"), _get("e.p", "$.in", "string").alias("location"), (place * 2 + F.coalesce(_get("e.p", "$.required", "boolean"), F.lit(False)).cast("long")).alias("best"))
    found = typed.groupBy(*KEYS, "path", "method", "name", "location").agg(F.min("best").alias("best")).withColumn("place", F.expr("best >> 1"))
    shared = F.col("place") > 1 << 31
    at = F.when(shared, F.lit(1 << 32)).otherwise(0) - F.col("place")
    return found.select(*KEYS, "path", "method", "name", "location", (F.col("best") % 2 != 0).alias("required"), F.when(shared, "path").otherwise("operation").alias("level"), F.lpad(at.cast("string"), 4, "0").alias("ordinal"))


def media(docs: DataFrame) -> DataFrame:
    """(.., context, code, media_type, schema) of request bodies and responses."""
    ops = operations(docs).select(*KEYS, "path", "method", "op")
    body = lambda context, code, content: F.struct(F.lit(context).alias("context"), code.alias("code"), content.alias("content"))
    request = F.array(body("request", F.lit(""), _get("op", "$.requestBody.content", "variant")))
    responses = F.transform(F.map_entries(_get("op", "$.responses", "map<string,variant>")), lambda e: body("response", e["key"], _get(e["value"], "$.content", "variant")))
    bodies = ops.select(*KEYS, "path", "method", F.explode(_joined(request, responses)).alias("b")).select(*KEYS, "path", "method", "b.*")
    entries = _entries(bodies, "content", "media_type", "m")
    return entries.withColumn("schema", _get("m", "$.schema", "variant")).drop("m")


def headers(docs: DataFrame) -> DataFrame:
    """(.., code, header, required) of response headers."""
    ops = operations(docs).select(*KEYS, "path", "method", "op")
    rows = _entries(ops.select(*KEYS, "path", "method", _get("op", "$.responses", "variant").alias("r")), "r", "code", "response")
    rows = rows.select(*KEYS, "path", "method", "code", _get("response", "$.headers", "variant").alias("h"))
    return _entries(rows, "h", "header", "v").select(*KEYS, "path", "method", "code", "header", F.coalesce(_get("v", "$.required", "boolean"), F.lit(False)).alias("required"))


def components(docs: DataFrame) -> DataFrame:
    """(api_id, version_no, pointer, target) of the schemas under #/components."""
    rows = parsed(docs).select(*KEYS, _get("doc", "$.components", "variant").alias("c"))
    rows = _entries(_entries(rows, "c", "section", "s"), "s", "name", "target")
    name = F.replace(F.replace("name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return rows.select(*KEYS, F.concat(F.lit("#/components/"), "section", F.lit("/"), name).alias("pointer"), "target")


def resolve(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Follow references in column schema; what stays (cycles, external or dangling targets) is in ref, with trail.

    Nodes are written once; only those that hold a reference go round, until a target is met twice or is none.
    """
    begun = nodes.withColumn("trail", F.array().cast("array<string>")).withColumn("ref", _get("schema", "$['$ref']", "string"))
    out = written(begun, "references")
    done, follow = out.filter("ref is null"), out.filter("ref is not null")
    while not follow.isEmpty():
        hop = follow.join(known.withColumnRenamed("pointer", "ref").hint("merge"), [*KEYS, "ref"], "left")
        go = F.col("target").isNotNull() & ~F.array_contains("trail", F.col("ref"))
        hop = hop.withColumn("moved", go).withColumn("schema", F.when(go, F.col("target")).otherwise(F.col("schema")))
        hop = hop.withColumn("trail", F.when(F.col("moved"), F.array_append("trail", F.col("ref"))).otherwise(F.col("trail")))
        hop = hop.withColumn("ref", F.when(F.col("moved"), _get("schema", "$['$ref']", "string")).otherwise(F.col("ref")))
        hop = written(hop.drop("target"), "references")
        done = done.unionByName(hop.filter("not moved or ref is null").drop("moved"))
        follow = hop.filter("moved and ref is not null").drop("moved")
    return done


def _below(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sub-schemas one level down: properties, items, additionalProperties and the parts of compositions.

    compared is true below properties and items alone, as version diffs descend.
    """
    part = lambda name, required, compared, schema: F.struct(name.alias("name"), required.alias("required"), compared.alias("compared"), schema.alias("schema"))
    yes, no, compared = F.lit(True), F.lit(False), F.col("compared")
    names = F.coalesce(_get("schema", "$.required", "array<string>"), F.array().cast("array<string>"))
    items, more = _get("schema", "$.items", "variant"), _get("schema", "$.additionalProperties", "variant")
    lists = [
        F.transform(F.map_entries(_get("schema", "$.properties", "map<string,variant>")), lambda e: part(e["key"], F.array_contains(names, e["key"]), compared, e["value"])),
        F.when(items.isNotNull(), F.array(part(F.lit("items[]"), yes, compared, items))),
        F.when(F.schema_of_variant(more).startswith("OBJECT"), F.array(part(F.lit("additionalProperties{}"), yes, no, more))),
    ]
    numbered = lambda word: lambda p, at: part(F.concat(F.lit(f"{word}["), at.cast("string"), F.lit("]")), yes, no, p)
    lists += [F.transform(_get("schema", f"$.{word}", "array<variant>"), numbered(word)) for word in ("allOf", "oneOf", "anyOf")]
    out = rows.select(*keys, "node_path", "above", F.explode(_joined(*lists)).alias("e"))
    child = F.concat_ws(".", F.when(F.col("node_path") != "", F.col("node_path")), "e.name")
    return out.select(*keys, child.alias("node_path"), F.col("node_path").alias("parent_path"), "e.required", "above", "e.compared", "e.schema")


def schema_nodes(docs: DataFrame) -> DataFrame:
    """Flat schema nodes with a path, to any depth; a reference met again on its own path ends there."""
    known = written(components(docs), "components")
    roots = media(docs).withColumns({"node_path": F.lit(""), "parent_path": F.lit(None).cast("string"), "required": F.lit(True), "above": F.array().cast("array<string>"), "compared": F.lit(True)})
    front = resolve(roots, known)
    keys = [*KEYS, "path", "method", "context", "code", "media_type"]
    out = None
    while True:
        front = front.withColumn("cycle", F.size(F.array_intersect("above", "trail")) > 0)
        level = _normal(front, keys)
        out = level if out is None else out.unionByName(level)
        front = resolve(_below(front.filter("not cycle").withColumn("above", F.array_union("above", "trail")), keys), known)
        if front.isEmpty():
            return out


def _normal(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    one, many = _get("schema", "$.type", "string"), _get("schema", "$.type", "array<string>")
    types = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    keywords = F.map_keys(_get("schema", "$", "map<string,variant>"))
    unknown = F.size(F.array_except(F.filter(keywords, lambda k: ~k.startswith("x-")), F.array(*[F.lit(k) for k in KNOWN_KEYWORDS]))) > 0
    composed = F.arrays_overlap(keywords, F.array(F.lit("allOf"), F.lit("oneOf"), F.lit("anyOf")))
    plain = normal_types(types)
    status = F.when(F.col("ref").isNotNull(), "UNSUPPORTED").when(unknown | composed | F.col("cycle") | (F.size(plain) > 1), "PARTIALLY_SUPPORTED").otherwise("SUPPORTED")
    enum = F.transform(_get("schema", "$.enum", "array<variant>"), lambda v: F.to_json(v))
    null = F.coalesce(_get("schema", "$.nullable", "boolean"), F.lit(False)) | F.array_contains(types, "null")
    return rows.select(*keys, "node_path", "parent_path", plain.alias("types"), null.alias("nullable"), F.array_sort(F.coalesce(enum, F.array().cast("array<string>"))).alias("enum_json"), "required", F.coalesce(status, F.lit("SUPPORTED")).alias("support_status"), "ref", "compared")


def normal_types(types: Column) -> Column:
    """Types sorted, without null."""
    return F.array_sort(F.array_remove(types, "null"))


def normal_enum(values: Column) -> Column:
    """JSON texts of an enum, sorted."""
    return F.array_sort(values)


def server_hosts(docs: DataFrame) -> DataFrame:
    """(api_id, version_no, hosts)."""
    urls = F.try_variant_get(F.try_parse_json("text"), "$.servers", "array<struct<url:string>>")
    rows = docs.select(*KEYS, F.explode_outer(urls).alias("s")).withColumn("host", url_host(F.col("s.url")))
    return rows.groupBy(*KEYS).agg(F.array_sort(F.collect_set("host")).alias("hosts"))
