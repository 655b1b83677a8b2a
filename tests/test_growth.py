"""What queries must not do as their tables grow."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contrail.llm import suffix_dedup
from contrail.operators import audit, bootstrap, contracts, dataset, inversions, selection
from contrail.plans import contract_queries, feature_queries, model_queries
from contrail.plans import queries as plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["policy_metrics", "learned_abstention", "policy_intervals", "contract_compare"])
def test_no_side_goes_through_the_driver(spark, sf, name):
    assert "BroadcastHashJoin" not in plan(plans.QUERIES[name](spark, sf))


def test_parameters_are_folded_without_sorting(spark, sf):
    text = plan(contracts.parameters(contract_queries._documents(spark, sf, False)))
    assert "Window" not in text and "Sort" not in text


def test_documents_are_dealt_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(plans, "EACH", 10)
    assert contract_queries._documents(spark, sf, True).rdd.getNumPartitions() == 20


def test_the_tree_of_many_orders_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    at = f"{tmp_path}/orders.parquet"
    rows = spark.range(1_000_001).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    rows.write.parquet(at)
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{at}/*.parquet'")
    found = sorted(map(tuple, model_queries.content_tree(spark, str(tmp_path)).collect()))
    assert found == sorted(con.sql(plans.SQL["content_tree"]).fetchall())


def _filled(items, budget, files):
    used, held, out = 0, set(), {}
    for k, size, file in sorted(items):
        fits = size is not None and used + size <= budget and (file is None or file in held or len(held) < files)
        if fits:
            used, held = used + size, held | ({file} - {None})
        out[k] = fits
    return out


@pytest.mark.parametrize("least", [0, -3])
def test_fill_is_the_plain_fold(spark, least):
    rng = random.Random(least)
    items = [(i, rng.choice([None, *range(least, 9)]), rng.choice([None, "a", "b", "c"])) for i in range(400)]
    rows = spark.createDataFrame([(1, *x) for x in items], "context_id int, k int, size int, file string")
    out = selection.fill(rows, order=["k"], required=None, budget=60, files=2)
    assert {r["k"]: r["selected"] for r in out.collect()} == _filled(items, 60, 2)


def test_one_task_does_not_read_a_whole_context(spark):
    rows = spark.range(20_000).selectExpr("1 as context_id", "id as k", "id % 50 + 1 as size", "cast(null as string) as file")
    text = selection.fill(rows, order=["k"], required=None, budget=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text and "row_number()" in text.split("MapInArrow")[1]


def test_candidates_of_a_context_move_once(spark, sf):
    text = plan(plans.QUERIES["merged_candidates"](spark, sf))
    assert text.count("Exchange hashpartitioning") == 1


def test_ranges_of_inversions_are_bounded(spark, monkeypatch):
    made = []
    within = inversions._within_ranges
    monkeypatch.setattr(inversions, "EACH", 100)
    monkeypatch.setattr(inversions, "_within_ranges", lambda points, kind, ranges: made.append(ranges) or within(points, kind, ranges))
    rows = spark.range(1000).selectExpr("if(id % 2 = 0, null, 'g') as group_id", "id * 7 % 31 / 3.0D as before", "id * 11 % 17 / 3.0D as after")
    points = rows.collect()
    plain = {g: sum(y.before < x.before - 1e-12 and y.after > x.after + 1e-12 for x in points for y in points if x.group_id == y.group_id == g) for g in (None, "g")}
    assert {r["group_id"]: r["inversions"] for r in inversions.rank_inversions(rows, "before", "after").collect()} == plain
    assert made == [20]


def test_ids_are_counted_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(audit, "EACH", 100)
    rows = spark.range(1000).selectExpr("id % 999 as row_id", "if(id = 5, null, id % 4) as scenario_id", "'a' as scenario_fingerprint", "array('s') as truth_path", "'s' as symbol")
    scenarios = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "scenario_id long, scenario_fingerprint string")
    out = audit.dataset_violations(rows, scenarios)
    assert "hashpartitioning(row_id" in plan(out) and "REPARTITION_BY_NUM" in plan(out) and "BroadcastHashJoin" not in plan(out)
    found = {r["code"]: r["count"] for r in out.groupBy("code").count().collect()}
    assert found == {"DUPLICATE_ID": 1, "UNKNOWN_SCENARIO": 251, "FINGERPRINT": 500}


def test_sub_schemas_are_made_in_one_pass(spark):
    rows = spark.sql("select 'a' as api_id, 1 as version_no, '' as node_path, cast(array() as array<string>) as above, true as compared, parse_json('{\"items\": {}, \"allOf\": [{}, 1], \"additionalProperties\": true, \"properties\": {\"p\": {}}}') as schema")
    out = contracts._below(rows, contracts.KEYS)
    assert sorted(r["node_path"] for r in out.collect()) == ["allOf[0]", "allOf[1]", "items[]", "p"]
    assert "Union" not in plan(out)


def _bucket(n, words):
    """The contexts of n texts of words that repeat, as the one bucket of a run gets them from its chunks."""
    rng = random.Random(n)
    chunks = []
    for part in range(3):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))).encode() for _ in range(n)]
        row = {"ids": [part * n + i for i in range(n)], "lengths": np.array([len(x) for x in texts], np.int64).tobytes(), "data": b"".join(texts)}
        anchors = suffix_dedup._row_anchors(row, 50)
        items = suffix_dedup.Items(anchors, np.ones(len(anchors.key), np.int64), 1)
        data = b"".join(anchors.data[a : a + s].tobytes() for a, s in zip(items.at, items.size, strict=True))
        chunks.append({"bucket": 0, "chunk": part, "keys": items.key.tobytes(), "contents": items.content.tobytes(), "least": items.least.tobytes(), "sizes": items.size.astype(np.uint16).tobytes(), "data": data})
    return pa.Table.from_pylist(chunks)


def test_a_bucket_sorts_slices_of_its_contexts(monkeypatch):
    table = _bucket(60, [f"{x} some words that often come back {x}" for x in "abcdef"])
    whole = suffix_dedup._judge_items(50)(table).to_pylist()
    sorted_at_once, two_stage = [], suffix_dedup.two_stage
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "two_stage", lambda text: sorted_at_once.append(len(text)) or two_stage(text))
    assert suffix_dedup._judge_items(50)(table).to_pylist() == whole
    assert max(sorted_at_once) < sum(len(x) for x in table.column("data").to_pylist()) / 4
    assert any(set(suffix_dedup._unpacked(len(x["answer"]).to_bytes(4, "little") + x["answer"])) != {0} for x in whole)


def test_candidates_are_dealt_by_their_number_and_calls_join_impacts(spark, sf, monkeypatch):
    monkeypatch.setattr(dataset, "EACH", 500)
    monkeypatch.setattr(feature_queries.reach, "upstream_counts", lambda edges: edges.selectExpr("callee_id as symbol_id", "1L as direct_callers", "1L as upstream_callers").limit(0))
    rows = feature_queries._feature_rows(spark, sf)
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    tasks = -(-feature_queries._feature_rows(spark, sf).count() // 500)
    assert "RepartitionByExpression [change_id" in text and text.count(f"], {tasks}") >= 2
    above, below = text.split("RepartitionByExpression [change_id", 1)
    assert "_call_id" not in above.split("Join LeftOuter, ((change_id")[0]


def test_intervals_make_their_groups_once(spark):
    groups = spark.range(50).selectExpr("id as g", "id % 2 as side", "cast(id as double) as m")
    out = bootstrap.intervals(groups, "g", {"m": bootstrap.weighted_mean("m")}, ["side"], resamples=20, seed=3)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and text.count("Range (") == 1
    assert {r["side"]: r["point"] for r in out.collect()} == {0: 24.0, 1: 25.0}


def test_draws_by_digits_are_those_by_numbers(spark):
    at = [(math.floor(x * 2**52) + d) for x in bootstrap.POISSON for d in range(-2, 3)]
    rows = spark.createDataFrame([(f"{x:013x}{tail}", x) for x in at if 0 <= x < 2**52 for tail in ("0" * 19, "f" * 19)], "told string, x long")
    assert all(r["w"] == sum((r["x"] + 0.5) / 2.0**52 > p for p in bootstrap.POISSON) for r in rows.select("x", bootstrap._draws(F.col("told")).alias("w")).collect())


def test_rules_and_hosts_are_read_in_one_pass(spark, sf):
    text = plan(plans.QUERIES["contract_rules"](spark, sf))
    assert "Join" not in text and text.count("FileScan parquet") == 1
    docs = contract_queries._documents(spark, sf, False).limit(50)
    odd = spark.createDataFrame([("a", '{"servers":[{"url":"http://B.x"},{"url":"http://b.x/1"},{"url":"/l"},{}]}'), ("b", "{"), ("c", '{"servers":[]}')], "api_id string, text string").selectExpr("api_id", "1 as version_no", "'json' as format", "text")
    docs = docs.unionByName(odd)
    joined = lambda df: {r["api_id"]: r["hosts"] or [] for r in df.collect()}
    assert joined(contracts.rejects(docs, hosts=True)) == joined(contracts.server_hosts(docs))


def test_parameters_are_folded_where_documents_lie(spark, sf):
    text = plan(plans.QUERIES["contract_parameters"](spark, sf))
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text
