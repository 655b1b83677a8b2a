"""Registered queries on whole contract documents, one a part and version, and on calls with hosts and fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, diff, edits, match
from ..schemas import CATEGORIES
from ..storage import written
from .queries import _page_calls, dealt, query, table

_NODE = '"Node":{"type":"object","additionalProperties":{"type":"integer"},"properties":{"next":{"$ref":"#/components/schemas/Node"},"far":{"$ref":"other.yaml#/X"}<gone>}}'
_GET = (
    '"get":{"parameters":[{"name":"q","in":"query","required":<q>}],"responses":{"200":{"headers":{"X-Page":{"required":<page>}},"content":{"application/json":{"schema":{"type":"object","required":["id"],"properties":'
    '{"id":{"type":"<id>"},"node":{"$ref":"#/components/schemas/Alias"},"tags":{"type":"array","items":{"type":["string"<null>],"enum":["b"<enum>]}}}}}<xml>}}}}'
)
_POST = ',"post":{"security":[],"requestBody":{"content":{"application/json":{"schema":{"oneOf":[{"type":"object","properties":{"a":{"type":"number"}}},{"type":"string"}],"properties":{<b>"c":{"type":"number"}}}}}},"responses":{}}'
_DOC = (
    '{"openapi":"<openapi>","info":{"title":"t<k>","version":"1"},"servers":[{"url":"https://API<host>.example.com/v1"},{"url":"/local"}],"security":<security>,'
    '"paths":{"/items/{id}":{"parameters":[{"name":"id","in":"path","required":true},{"name":"q","in":"query"}],' + _GET + "<post>}<old>},"
    '"components":{"schemas":{"Alias":{"$ref":"#/components/schemas/Node"},' + _NODE + "}}}"
)


def _filled(template: str, parts: dict[str, Column]) -> Column:
    pieces = re.split(r"<(\w+)>", template)
    return F.concat(*[parts[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces)])


def _documents(spark: SparkSession, sf_dir: str, fresh: bool) -> DataFrame:
    """A contract document a part; the new version differs by arithmetic on the part's key."""
    k = F.col("p_partkey")
    unless = lambda n, text, other="": F.when((k % n == 0) & F.lit(fresh), other).otherwise(text)
    yes = lambda c: F.when(c, "true").otherwise("false")
    post = _filled(_POST, {"b": unless(15, '"b":{"type":"string"},')})
    parts = {
        "openapi": F.when(k % 16 == 0, "2.0").otherwise("3.0.3"), "k": F.when(k % 18 == 0, " ").otherwise(k.cast("string")), "host": (k % 7).cast("string"), "q": yes(k % (2 if fresh else 3) == 0), "page": yes(k % 2 == 0),
        "security": F.when(k % (6 if fresh else 4) == 0, '[{"key":["a","b"]}]' if fresh else '[{"key":["b","a"]}]').otherwise("[]"), "gone": unless(14, ',"gone":{"type":"string"}'), "id": unless(9, "integer", "string"),
        "null": unless(10, ',"null"'), "enum": unless(11, ',"a"'), "xml": unless(12, F.concat(F.lit(',"application/xml":{"schema":{"type":"'), unless(13, "string", "integer"), F.lit('"}}'))),
        "post": F.when((k % 8 == 0) & F.lit(fresh), "").otherwise(post), "old": unless(5, ',"/old":{"delete":{"responses":{}}}'),
    }
    return dealt(table(spark, sf_dir, "part").select("p_partkey", k.cast("string").alias("api_id")), "api_id").select("api_id", F.lit(2 if fresh else 1).alias("version_no"), F.lit("json").alias("format"), _filled(_DOC, parts).alias("text"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part), r AS (SELECT k, CASE WHEN k % 23 = 0 THEN ['UNPARSABLE', 'VERSION', 'TITLE', 'INFO_VERSION', 'PATHS'] ELSE list_filter([CASE WHEN k % 16 = 0 THEN 'VERSION' END, CASE WHEN k % 18 = 0 THEN 'TITLE' END, CASE WHEN k % 19 = 0 THEN 'INFO_VERSION' END,
  CASE WHEN k % 21 = 0 THEN 'PATHS' END, CASE WHEN k % 21 > 0 AND k % 17 = 0 THEN 'PATH_FORM' END, CASE WHEN k % 21 > 0 AND k % 22 = 0 THEN 'PATH_PARAMETER' END, CASE WHEN k % 21 > 0 AND k % 20 = 0 THEN 'RESPONSES' END], lambda x: x IS NOT NULL) END AS reasons FROM p)
SELECT CAST(k AS VARCHAR) AS api_id, array_to_string(reasons, ',') AS reasons, CASE WHEN k % 23 = 0 THEN '' ELSE 'api' || k % 7 || '.example.com' END AS hosts FROM r""")
def contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules and server hosts of each document; documents break the eight rules in turn."""
    k, text = F.col("api_id").cast("long"), F.col("text")
    change = lambda text, n, old, new: F.when(k % n == 0, F.replace(text, F.lit(old), F.lit(new))).otherwise(text)
    text = F.when(k % 20 == 0, text).otherwise(F.replace(text, F.lit('"responses":{}'), F.lit('"responses":{"200":{}}')))
    for n, old, new in ((18, '"title":"t', '"title":"'), (19, '"version":"1"', '"version":""'), (21, '"paths":', '"ways":'), (17, '"/items/{id}"', '"items/{id}"'), (22, '"in":"path","required":true', '"in":"path"')):
        text = change(text, n, old, new)
    docs = _documents(spark, sf_dir, False).withColumn("text", F.when(k % 23 == 0, F.lit('{"openapi')).otherwise(text))
    return contracts.rejects(docs, hosts=True).select("api_id", F.array_join("reasons", ",").alias("reasons"), F.coalesce(F.array_join("hosts", ","), F.lit("")).alias("hosts"))


@query("""WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS api_id, CASE WHEN p_partkey % 4 = 0 THEN 'key:a+b' ELSE '' END AS root FROM part)
SELECT api_id, path, method, op_id, CASE WHEN own THEN '' ELSE root END AS security FROM s, (VALUES ('/items/{id}', 'get', 'GET /items/{id}', false), ('/items/{id}', 'post', 'POST /items/{id}', true), ('/old', 'delete', 'DELETE /old', false)) o(path, method, op_id, own)""")
def contract_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1, N6."""
    told = F.transform("security", lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["scheme"], F.array_join(x["scopes"], "+"))), "&"))
    return contracts.operations(_documents(spark, sf_dir, False)).select("api_id", "path", "method", "op_id", F.array_join(told, "|").alias("security"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS api_id, method, name, location, CASE WHEN level = 'operation' THEN p_partkey % 3 = 0 ELSE name = 'id' END AS required, level
FROM part, (VALUES ('get', 'id', 'path', 'path'), ('get', 'q', 'query', 'operation'), ('post', 'id', 'path', 'path'), ('post', 'q', 'query', 'path')) o(method, name, location, level)""")
def contract_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2."""
    return contracts.parameters(_documents(spark, sf_dir, False)).select("api_id", "method", "name", "location", "required", "level")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS api_id, context, code, entry, CASE WHEN context = 'header' THEN p_partkey % 2 = 0 END AS required
FROM part, (VALUES ('response', '200', 'application/json'), ('response', '200', 'application/xml'), ('request', '', 'application/json'), ('header', '200', 'X-Page')) o(context, code, entry)""")
def contract_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media types of bodies and headers of responses."""
    docs = _documents(spark, sf_dir, False)
    bodies = contracts.media(docs).select("api_id", "context", "code", F.col("media_type").alias("entry"), F.lit(None).cast("boolean").alias("required"))
    return bodies.unionByName(contracts.headers(docs).select("api_id", F.lit("header").alias("context"), "code", F.col("header").alias("entry"), "required"))


_NODES = """(VALUES
('get', 'application/json', '', 'object', false, '', true, 'SUPPORTED', NULL), ('get', 'application/json', 'id', 'integer', false, '', true, 'SUPPORTED', NULL),
('get', 'application/json', 'node', 'object', false, '', false, 'SUPPORTED', NULL), ('get', 'application/json', 'node.additionalProperties{}', 'integer', false, '', true, 'SUPPORTED', NULL),
('get', 'application/json', 'node.next', 'object', false, '', false, 'PARTIALLY_SUPPORTED', NULL), ('get', 'application/json', 'node.far', '', false, '', false, 'UNSUPPORTED', 'other.yaml#/X'),
('get', 'application/json', 'node.gone', 'string', false, '', false, 'SUPPORTED', NULL), ('get', 'application/json', 'tags', 'array', false, '', false, 'SUPPORTED', NULL),
('get', 'application/json', 'tags.items[]', 'string', true, '"a","b"', true, 'SUPPORTED', NULL), ('get', 'application/xml', '', 'string', false, '', true, 'SUPPORTED', NULL),
('post', 'application/json', '', '', false, '', true, 'PARTIALLY_SUPPORTED', NULL), ('post', 'application/json', 'b', 'string', false, '', false, 'SUPPORTED', NULL),
('post', 'application/json', 'c', 'number', false, '', false, 'SUPPORTED', NULL), ('post', 'application/json', 'oneOf[0]', 'object', false, '', true, 'SUPPORTED', NULL),
('post', 'application/json', 'oneOf[0].a', 'number', false, '', false, 'SUPPORTED', NULL), ('post', 'application/json', 'oneOf[1]', 'string', false, '', true, 'SUPPORTED', NULL))
n(method, media_type, node_path, types, nullable, enum_json, required, support_status, ref)"""


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS api_id, n.* FROM part, {_NODES}")
def contract_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested schemas, compositions, references in chains, in cycles and to other files."""
    rows = contracts.schema_nodes(_documents(spark, sf_dir, False))
    return rows.select("api_id", "method", "media_type", "node_path", F.array_join("types", ",").alias("types"), "nullable", F.array_join("enum_json", ",").alias("enum_json"), "required", "support_status", "ref")


_COMPARED = """c AS (
SELECT k, 'endpoint_removed' AS category, '/old' AS path, 'delete' AS method, 'operation' AS location, 'CLIENT_BREAKING' AS classification, 'EXACT' AS certainty FROM p WHERE k % 5 = 0
UNION ALL SELECT k, 'http_method_removed', '/items/{id}', 'post', 'operation', 'CLIENT_BREAKING', 'EXACT' FROM p WHERE k % 8 = 0
UNION ALL SELECT k, 'required_parameter_added', '/items/{id}', 'get', 'parameter.query.q', 'CLIENT_BREAKING', 'EXACT' FROM p WHERE k % 2 = 0 AND k % 3 <> 0
UNION ALL SELECT k, 'security_requirement_changed', path, method, 'operation', CASE WHEN k % 4 = 0 THEN 'POTENTIALLY_BREAKING' ELSE 'CLIENT_BREAKING' END, 'EXACT' FROM p, (VALUES ('/items/{id}', 'get'), ('/old', 'delete')) o(path, method) WHERE (k % 4 = 0) <> (k % 6 = 0) AND (method = 'get' OR k % 5 <> 0)
UNION ALL SELECT k, 'response_type_changed', '/items/{id}', 'get', 'response.200[application/json].id', 'CLIENT_BREAKING', 'EXACT' FROM p WHERE k % 9 = 0
UNION ALL SELECT k, 'response_type_changed', '/items/{id}', 'get', 'response.200[application/xml]', 'CLIENT_BREAKING', 'EXACT' FROM p WHERE k % 13 = 0 AND k % 12 <> 0
UNION ALL SELECT k, 'nullable_removed', '/items/{id}', 'get', 'response.200[application/json].tags.items[]', 'POTENTIALLY_BREAKING', 'EXACT' FROM p WHERE k % 10 = 0
UNION ALL SELECT k, 'enum_restricted', '/items/{id}', 'get', 'response.200[application/json].tags.items[]', 'POTENTIALLY_BREAKING', 'EXACT' FROM p WHERE k % 11 = 0
UNION ALL SELECT k, 'response_property_removed', '/items/{id}', 'get', 'response.200[application/json].node.gone', 'CLIENT_BREAKING', 'EXACT' FROM p WHERE k % 14 = 0
UNION ALL SELECT k, 'request_property_removed', '/items/{id}', 'post', 'request.body[application/json].b', 'POTENTIALLY_BREAKING', 'PARTIAL' FROM p WHERE k % 15 = 0 AND k % 8 <> 0)"""


@query(f"""WITH p AS (SELECT p_partkey AS k FROM part), {_COMPARED}
SELECT CAST(k AS VARCHAR) AS api_id, category, path, method, location, classification, certainty, 'api-change-' || substr(sha256(k || chr(31) || category || chr(31) || path || chr(31) || method || chr(31) || location), 1, 24) AS change_id FROM c""")
def contract_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents of two versions, normalised and compared."""
    parts = {"operations": contracts.operations, "parameters": contracts.parameters, "schema_nodes": contracts.schema_nodes}
    old, new = ({k: written(f(_documents(spark, sf_dir, fresh)).drop("version_no", "op"), k) for k, f in parts.items()} for fresh in (False, True))
    return diff.compare(old, new).select("api_id", "category", "path", "method", "location", "classification", "certainty", "change_id")


@query(f"""SELECT category, CASE WHEN category = 'request_property_removed' THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS repairability, CASE WHEN category <> 'request_property_removed' THEN 'no rule for ' || category END AS reason, count(*) AS n
FROM (SELECT [{", ".join(f"'{c}'" for c in CATEGORIES)}][p_partkey % 10 + 1] AS category FROM part) GROUP BY ALL""")
def repair_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a change of one of the ten categories."""
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return edits.repair_support(table(spark, sf_dir, "part").select(category.alias("category"))).groupBy("category", "repairability", "reason").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT page_id AS i, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages),
c AS (SELECT h AS api, p AS path, list_filter(string_split(p, '/'), lambda x: x <> '') AS x, category, location FROM (SELECT DISTINCT h, p FROM a), (VALUES ('endpoint_removed', 'operation'), ('required_parameter_added', 'parameter.query.q'), ('response_property_removed', 'response.200[json].id')) o(category, location)),
d AS (SELECT i, p, list_filter(string_split(p, '/'), lambda x: x <> '') AS x, CASE WHEN i % 11 <> 0 THEN h END AS host, i % 7 = 0 AS part, i % 5 = 0 AS loose FROM a),
m AS (SELECT *, length(api) % 3 <> 0 AS known, c.path = d.p AS same FROM c JOIN d USING (x) WHERE category = 'endpoint_removed' OR category = 'required_parameter_added' AND i % 2 = 0 OR category = 'response_property_removed' AND i % 3 = 0),
s AS (SELECT *, CASE WHEN NOT known THEN 0.0 WHEN host IS NULL THEN 0.05 WHEN host = api THEN 0.2 END AS hw, CASE WHEN known AND host = api THEN 'EXACT' ELSE 'PARTIAL' END AS hs, CASE WHEN part THEN 'PARTIAL' ELSE 'EXACT' END AS us,
  CASE WHEN category = 'response_property_removed' AND loose THEN 'PARTIAL' ELSE 'EXACT' END AS fs FROM m)
SELECT 'c-' || substr(sha256(api || chr(31) || path || chr(31) || category), 1, 24) AS change_id, CAST(i AS VARCHAR) AS call_id,
  round((hw::DOUBLE + CASE WHEN same THEN 0.3 WHEN part THEN 0.18 ELSE 0.24 END + 0.25 + CASE WHEN part THEN 0.02 ELSE 0.05 END + CASE WHEN category <> 'endpoint_removed' THEN 0.2 ELSE 0 END) / CASE WHEN category = 'endpoint_removed' THEN 0.8 ELSE 1.0 END, 6) AS score,
  CASE WHEN hs = 'PARTIAL' OR us = 'PARTIAL' OR fs = 'PARTIAL' THEN 'PARTIAL' ELSE 'EXACT' END AS certainty, CASE category WHEN 'required_parameter_added' THEN 'query.q' WHEN 'response_property_removed' THEN 'id' ELSE '' END AS used,
  'api_identity:' || hs || ',endpoint_path_match:' || us || ',http_method_match:EXACT,direct_http_invocation:EXACT,url_resolution:' || us || CASE WHEN category <> 'endpoint_removed' THEN ',changed_name_used:' || fs ELSE '' END AS evidence
FROM s WHERE hw IS NOT NULL""")
def impact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M7 with hosts, parameters and fields: each path of a host as three changes, each page as a call."""
    i = F.col("call_id").cast("bigint")
    listed = lambda n, name: F.when(i % n == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    calls = _page_calls(spark, sf_dir).withColumns({"host": F.when(i % 11 != 0, F.col("host")), "query_parameters": listed(2, "q"), "response_fields": listed(3, "id"), "response_state": F.when(i % 5 == 0, "PARTIAL").otherwise("EXACT")})
    paths = table(spark, sf_dir, "pages").select(F.try_parse_url("url", F.lit("HOST")).alias("api_id"), F.try_parse_url("url", F.lit("PATH")).alias("path")).distinct()
    kinds = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(at).alias("location")) for c, at in (("endpoint_removed", "operation"), ("required_parameter_added", "parameter.query.q"), ("response_property_removed", "response.200[json].id"))])
    changes = paths.withColumn("x", F.explode(kinds)).select("api_id", "path", F.lit("get").alias("method"), "x.*")
    changes = changes.withColumn("change_id", match.stable_id("c-", "api_id", "path", "category"))
    hosts = paths.select("api_id").distinct().filter("length(api_id) % 3 <> 0").select("api_id", F.array(F.upper("api_id")).alias("hosts"))
    told = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["feature"], e["state"])), ",")
    return match.impacts(changes, calls, hosts).select("change_id", "call_id", F.round("score", 6).alias("score"), "certainty", F.array_join("used", ",").alias("used"), told.alias("evidence"))
