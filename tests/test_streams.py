"""Streams over several triggers: timers, batches that run again, plans without state."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contrail.operators import match
from contrail.plans import stream_queries
from contrail.streaming import feedback as streams

ATTEMPTS = "patch_id string, attempt_number int, status string, strategy string, budget int, ts timestamp"


def test_patches_at_rest_are_given_up(spark):
    streams.keep_state_on_disk(spark)
    at = datetime(2024, 1, 1)
    rows = [("a", 1, "TIMEOUT", "SMALL", 100, at), ("b", 1, "TIMEOUT", "SMALL", None, at), ("b", 2, "TIMEOUT", "SMALL", 50, at + timedelta(days=9)), ("c", 1, "TESTS_PASSED", "SMALL", 1, at + timedelta(days=20)), ("a", 2, "TIMEOUT", "SMALL", 100, at + timedelta(days=21))]
    table = spark.createDataFrame(rows, ATTEMPTS)
    day = F.dayofmonth("ts")
    out = stream_queries.in_slices(table, F.when(day < 9, 0).when(day < 20, 1).otherwise(2), lambda s: streams.retry_actions(s, idle=timedelta(days=5)))
    found = sorted((r["patch_id"], r["attempt_number"], r["action"], r["next_budget"]) for r in out.collect())
    assert [x for x in found if x[0] == "a"] == [("a", 1, "ABANDONED", 100), ("a", 1, "RETRY_WITH_MORE_CONTEXT", 200), ("a", 2, "RETRY_WITH_MORE_CONTEXT", 200)]
    b = [x for x in found if x[0] == "b"]
    assert ("b", 1, "RETRY_WITH_MORE_CONTEXT", 32000) in b and sum(x[2] == "ABANDONED" for x in b) >= 1


def test_a_batch_that_runs_again_writes_once(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x"), ("{", None)], "value string, id string").select("value", F.when(F.col("id").isNotNull(), F.struct("id")).alias("row"))
    keep = streams.split_malformed(str(tmp_path / "good"), str(tmp_path / "bad"))
    for number in (0, 1, 1, 0):
        keep(rows, number)
    assert spark.read.parquet(str(tmp_path / "good")).count() == spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"record_id": "1"}\n\n{"record_id": 2, "more": 1}\n[1]\nnull\n{"record_id": "3"\n')
    seen = []
    lines = streams.read_lines(spark, str(tmp_path), "record_id string")
    lines.writeStream.foreachBatch(lambda b, _: seen.extend(map(tuple, b.select("value", "row.record_id").collect()))).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((v, i) for v, i in seen if i) == [('{"record_id": "1"}', "1"), ('{"record_id": 2, "more": 1}', "2")] and '{"record_id": "3"' in [v for v, i in seen if not i]


def test_new_calls_keep_no_state(spark, sf, tmp_path):
    from contrail.plans.queries import _page_calls, _page_changes

    calls, changes = _page_calls(spark, sf), _page_changes(spark, sf)
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    rows = []
    run = streams.new_impacts(stream, changes).writeStream.foreachBatch(lambda b, _: rows.append(b.count())).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(rows) > 0 and all(not p["stateOperators"] for p in run.recentProgress)


def test_open_pairs_with_variable_calls(spark):
    paths = ["/a/{x}/c", "/a/b/{y}", "/{z}/b/c", "/a/b/c", "/a", "/{w}", "/a/b/c/d", ""]
    changes = spark.createDataFrame([(f"c{i}", p, "GET") for i, p in enumerate(paths)], "change_id string, path string, method string")
    calls = spark.createDataFrame([(f"k{i}", p, "get", "EXACT") for i, p in enumerate([*paths, "/a/{dynamic}/{dynamic}", "/q/b/c"])], "call_id string, path string, method string, url_state string")
    rows = lambda f: {(r[0], r[1]) for r in f(changes, calls).select("change.change_id", "call.call_id").collect()}
    whole = {(c, k) for c, k in rows(match.candidate_pairs) if paths[int(c[1:])]}
    assert rows(match._open_pairs) == whole and len(whole) > 15


def test_logs_are_sorted_once(spark, sf, monkeypatch):
    """chain_stream gives its slices a written table, not the windows over all logs once a slice."""
    class Seen(Exception):
        pass

    def slices(rows, *_):
        raise Seen(rows._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(stream_queries, "in_slices", slices)
    with pytest.raises(Seen) as seen:
        stream_queries.chain_stream(spark, sf)
    assert "Window" not in str(seen.value)
