"""FIXTURES.md, sections 3 and 4.

Documents, paths, names and scores of the cases are fixed values: they are those of FIXTURES.md.
"""

import pytest
from pyspark.sql import functions as F

from contrail.operators import graph, match, risk
from contrail.operators import reach as reach_sets

CALL = "call_id string, repo_id string, symbol_id string, method string, host string, path string, url_state string, request_fields array<string>, request_state string, query_parameters array<string>, headers array<string>, response_fields array<string>, response_state string"
CHANGE = "change_id string, api_id string, category string, path string, method string, location string"


def call(spark, **x):
    base = {"call_id": "k", "repo_id": "r", "symbol_id": "s", "method": "post", "host": "payments.example.com", "path": "/payments", "url_state": "EXACT", "request_fields": ["amount"], "request_state": "EXACT", "query_parameters": [], "headers": [], "response_fields": [], "response_state": "EXACT"}
    return spark.createDataFrame([tuple((base | x).values())], CALL)


def change(spark, category, path, method, location):
    return spark.createDataFrame([("c", "a", category, path, method, location)], CHANGE)


@pytest.fixture
def hosts(spark):
    return spark.createDataFrame([("a", ["payments.example.com"])], "api_id string, hosts array<string>")


def test_exact(spark, hosts):
    r = match.impacts(change(spark, "request_property_removed", "/payments", "post", "request.body[application/json].amount"), call(spark), hosts).collect()
    assert len(r) == 1 and r[0]["score"] == pytest.approx(1.0) and r[0]["certainty"] == "EXACT" and sum(e["contribution"] for e in r[0]["evidence"]) == pytest.approx(1.0)


def test_others(spark, hosts):
    field = change(spark, "request_property_removed", "/payments", "post", "request.body[application/json].amount")
    assert match.impacts(field, call(spark, path="/refunds"), hosts).count() == 0
    assert match.impacts(field, call(spark, host="other.example.com"), hosts).count() == 0
    assert match.impacts(field, call(spark, url_state="UNRESOLVED"), hosts).count() == 0
    assert match.impacts(field, call(spark, request_fields=["other"]), hosts).count() == 0
    r = match.impacts(change(spark, "security_requirement_changed", "/orders/{order_id}", "get", "operation"), call(spark, method="get", path="/orders/{dynamic}", url_state="PARTIAL"), hosts).collect()
    assert len(r) == 1 and r[0]["certainty"] == "PARTIAL" and r[0]["score"] < 1
    needed = change(spark, "required_parameter_added", "/payments", "post", "parameter.query.status")
    found = match.impacts(needed, call(spark), hosts)
    pairs = match.candidate_pairs(needed, call(spark))
    assert found.count() == 0 and match.unmatched(needed, pairs, found).first()["looked_at"] == 1
    assert [r["call_id"] for r in match.evaluated(pairs, found).collect()] == ["k"]
    assert match.impacts(needed, call(spark, query_parameters=["status"]), hosts).first()["used"] == ["query.status"]
    assert match.impacts(field, call(spark)).first()["score"] == pytest.approx(0.8)


def edges(spark, *pairs):
    return spark.createDataFrame([(f"{a}-{b}", a, b, "EXACT") for a, b in pairs], "edge_id string, caller_id string, callee_id string, state string")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "symbol_id string")


def reach(spark, ids, *pairs):
    return {(r["symbol_id"], r["seed_id"]): r for r in graph.propagate(seeds(spark, *ids), edges(spark, *pairs)).collect()}


def test_propagation(spark):
    assert {k[0]: r["distance"] for k, r in reach(spark, ["direct"], ("a", "b"), ("b", "a"), ("b", "direct")).items()} == {"direct": 0, "b": 1, "a": 2}
    found = reach(spark, ["direct"], ("a", "b"), ("a", "c"), ("b", "direct"), ("c", "direct"))
    assert {k[0]: r["distance"] for k, r in found.items()} == {"direct": 0, "b": 1, "c": 1, "a": 2} and found["a", "direct"]["path"] == ["direct", "b", "a"]
    found = reach(spark, ["first", "second"], ("up", "first"), ("up", "second"), ("first", "second"), ("lone", "other"))
    assert found["up", "first"]["distance"] == found["up", "second"]["distance"] == 1 and ("lone", "first") not in found


def test_counts_and_components(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("c", "a"))
    rows = {r["symbol_id"]: (r["direct_callers"], r["upstream_callers"]) for r in reach_sets.upstream_counts(e).collect()}
    assert rows == {"a": (2, 3), "b": (1, 3)}
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101)], "a int, b int")
    found = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert all(found[k] == 0 for k in range(31)) and found[101] == 100


def test_impacted_and_risk(spark):
    impacts = spark.createDataFrame([("i", "d", "c1", 0.9, "EXACT")], "impact_id string, symbol_id string, change_id string, score double, certainty string")
    found, _ = reach_sets.spread(impacts, spark.createDataFrame([("u", "d", "e", "PARTIAL")], "caller_id string, callee_id string, edge_id string, state string"))
    impacted = reach_sets.impacted(found)
    rows = {x["symbol_id"]: x for x in impacted.collect()}
    assert rows["u"]["impact_type"] == "INDIRECT" and rows["u"]["state"] == "PARTIAL" and rows["d"]["impact_type"] == "DIRECT"
    summary = graph.summary(impacted).withColumns({"severity": F.lit("HIGH"), "score": F.lit(0.9), "incomplete": F.lit(True), "partial": F.lit(True)})
    out = risk.assess(summary).first()
    assert out["risk_score"] == pytest.approx(40 + 18 + 5 + 5 + 5 + 5 + 3) and out["risk_level"] == "CRITICAL"
    level = lambda x: spark.range(1).select(risk.level(F.lit(x)).alias("l")).first()["l"]
    assert [level(x) for x in (24.0, 24.5, 49.0, 74.0, 74.1)] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL"]
