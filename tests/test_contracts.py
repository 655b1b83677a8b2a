"""The contract pair of FIXTURES.md, section 1, and normalisation.

Documents, paths, names and scores of the cases are fixed values: they are those of FIXTURES.md.
"""

import json
from collections import Counter

from contrail.operators import contracts, diff
from contrail.sources import tables


def spec(paths, security=None, components=None):
    out = {"openapi": "3.0.3", "info": {"title": "t", "version": "1"}, "servers": [{"url": "https://API.example.com/v1"}], "paths": paths}
    return json.dumps(out | ({"security": security} if security else {}) | ({"components": components} if components else {}))


def body(schema):
    return {"content": {"application/json": {"schema": schema}}}


def pair():
    state = lambda values, null: {"type": ["string", "null"] if null else "string", "enum": values}
    old = spec({
        "/removed": {"get": {"responses": {}}}, "/methods": {"get": {"responses": {}}, "post": {"responses": {}}},
        "/orders": {"post": {"parameters": [{"name": "status", "in": "query"}], "requestBody": body({"type": "object", "properties": {"legacy": {"type": "string"}, "amount": {"type": "number"}, "state": state(["pending", "paid"], True)}}),
            "responses": {"200": body({"type": "object", "properties": {"receipt_url": {"type": "string"}, "id": {"type": "integer"}, "state": state(["pending", "paid"], True)}})}}},
    })
    new = spec({
        "/methods": {"get": {"responses": {}}},
        "/orders": {"post": {"parameters": [{"name": "status", "in": "query", "required": True}], "requestBody": body({"type": "object", "properties": {"amount": {"type": "integer"}, "state": state(["paid"], False)}}),
            "responses": {"200": body({"type": "object", "properties": {"id": {"type": "string"}, "state": state(["paid"], False)}})}}},
    }, [{"apiKey": []}])
    return old, new


def sides(spark, old, new):
    out = []
    for version, text in ((1, old), (2, new)):
        docs = spark.createDataFrame([("orders", version, "json", text)], "api_id string, version_no int, format string, text string")
        out.append({k: f(docs).drop("version_no") for k, f in (("operations", contracts.operations), ("parameters", contracts.parameters), ("schema_nodes", contracts.schema_nodes))})
    return out


def test_pair(spark):
    rows = diff.compare(*sides(spark, *pair())).collect()
    assert Counter(r["category"] for r in rows) == {
        "endpoint_removed": 1, "http_method_removed": 1, "security_requirement_changed": 2, "required_parameter_added": 1, "request_property_removed": 1, "request_type_changed": 1,
        "response_property_removed": 1, "response_type_changed": 1, "enum_restricted": 2, "nullable_removed": 2,
    }
    assert len({r["change_id"] for r in rows}) == 13
    assert {r["classification"] for r in rows if r["category"] == "security_requirement_changed"} == {"CLIENT_BREAKING"}
    assert next(r["certainty"] for r in rows if r["category"] == "request_property_removed") == "CONDITIONAL"


def test_equal_pair(spark):
    old, _ = pair()
    assert diff.compare(*sides(spark, old, old)).count() == 0


def test_references_and_cycles(spark):
    components = {"schemas": {"Node": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "next": {"$ref": "#/components/schemas/Node"}, "far": {"$ref": "other.yaml#/X"}}}}}
    docs = spark.createDataFrame([("a", 1, "json", spec({"/n": {"get": {"responses": {"200": body({"type": "array", "items": {"$ref": "#/components/schemas/Node"}})}}}}, components=components))], "api_id string, version_no int, format string, text string")
    rows = {r["node_path"]: r for r in contracts.schema_nodes(docs).collect()}
    assert {"", "items[]", "items[].id", "items[].next", "items[].far"} <= set(rows)
    assert rows["items[].id"]["required"] and rows["items[].far"]["support_status"] == "UNSUPPORTED" and "items[].next.next.next" not in rows
    assert contracts.server_hosts(docs).first()["hosts"] == ["api.example.com"]


def test_parameters_inherit(spark):
    text = spec({"/a": {"parameters": [{"name": "x", "in": "query", "required": True}, {"name": "y", "in": "query"}], "get": {"parameters": [{"name": "x", "in": "query"}], "responses": {}}}})
    docs = spark.createDataFrame([("a", 1, "json", text)], "api_id string, version_no int, format string, text string")
    assert {(r["name"], r["required"], r["level"]) for r in contracts.parameters(docs).collect()} == {("x", False, "operation"), ("y", False, "path")}


def test_rejects_and_yaml(spark):
    docs = spark.createDataFrame([("a", 1, '{"openapi": "2.0", "info": {"title": "", "version": "1"}, "paths": {"x y": {}}}'), ("b", 1, "openapi: 3.0.1\ninfo: {title: t, version: '1'}\npaths: {/a: {}}"), ("c", 1, ""), ("d", 1, "[1]"), ("e", 1, "a: [")], "api_id string, version_no int, text string")
    rows = {r["api_id"]: r for r in tables.parse_contracts(docs).collect()}
    assert [rows[k]["error_category"] for k in "abcde"] == [None, None, "EMPTY", "NOT_A_MAPPING", "UNPARSABLE"]
    reasons = {r["api_id"]: r["reasons"] for r in contracts.rejects(tables.parse_contracts(docs)).collect()}
    assert reasons["a"] == ["VERSION", "TITLE", "PATH_FORM"] and reasons["b"] == []
