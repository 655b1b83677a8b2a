"""FIXTURES.md, section 8, code facts and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from contrail.functions.columns import redacted, stable_id
from contrail.operators import audit, code_facts, edits, evidence, linking, selection
from contrail.sources import tables
from contrail.streaming import feedback as streams


def test_fill_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("c", i, n, f"f{i}", i == 3) for i, n in enumerate([50, 60, 40, 30])], "context_id string, k int, size int, file string, required boolean")
    out = {r["k"]: r["selected"] for r in selection.fill(rows, order=["k"], budget=120).collect()}
    assert out == {0: True, 1: False, 2: True, 3: True}


def test_spans_and_merge(spark):
    files = spark.createDataFrame([("r", "a.py", "one\ntwo\nthree\n")], "repo_id string, path string, content string")
    spans = spark.createDataFrame([("r", "c", "a.py", 2, 3), ("r", "c", "a.py", 3, 9), ("r", "c", "../x.py", 1, 1), ("r", "c", "b.py", 1, 1)], "repo_id string, context_id string, file string, start_line int, end_line int")
    kept, lost = selection.cut_spans(spans.withColumn("content", F.lit(None).cast("string")), files)
    assert [r["content"] for r in kept.collect()] == ["two\nthree\n"] and {r["reason"] for r in lost.collect()} == {"SPAN_OUT_OF_RANGE", "PARENT_TRAVERSAL", "FILE_MISSING"}
    item = kept.select("context_id", "file", F.lit("s").alias("symbol"), "start_line", "end_line", "content", F.lit(1).alias("graph_distance"), F.array(F.lit("p")).alias("provenance_ids"))
    items = selection.context_candidates({"CALL_SITE": item, "CALLER": item})
    merged, repeats = selection.merge(items)
    assert merged.count() == 1 and repeats.count() == 1 and merged.first()["priority"] == 2 and merged.first()["required"]


def test_edits(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    files = spark.createDataFrame([("a", "0123456789")], "file string, source string")
    rows = [("a", "e1", 2, 4, sha("23"), "23", "XX!"), ("a", "e2", 7, 8, sha("7"), "7", ""), ("a", "e3", 5, 6, sha("z"), "z", "no")]
    table = spark.createDataFrame(rows, "file string, edit_id string, start_offset int, end_offset int, original_hash string, original_text string, replacement string")
    r = edits.apply_edits(files, table).first()
    assert (r["new_text"], r["applied"], r["stale"]) == ("01XX!45689", 2, 1)
    over = spark.createDataFrame([("a", "x", 0, 10), ("a", "y", 2, 3), ("a", "z", 5, 6), ("a", "w", 5, 6), ("b", "v", 0, 1)], "file string, edit_id string, start_offset int, end_offset int")
    assert {(r["edit_id"], r["code"]) for r in edits.edit_conflicts(over).collect()} == {("y", "OVERLAPPING_EDIT"), ("w", "OVERLAPPING_EDIT"), ("z", "DUPLICATE_EDIT")}
    items = spark.createDataFrame([("c", "a", "h", "aaa b")], "context_id string, file string, content_hash string, content string")
    proposed = spark.createDataFrame([("p", "1", "c", "a", "h", "b", "x"), ("p", "2", "c", "a", "h", "aa", "x"), ("p", "3", "c", "q", "h", "b", "x"), ("p", "4", "c", "a", "i", "b", "x"), ("p", "5", "c", "a", "h", "zz", "x")], "patch_id string, edit_id string, context_id string, file string, item_hash string, original_text string, replacement string")
    assert {r["edit_id"]: r["code"] for r in edits.screen(proposed, items).collect()} == {"1": None, "2": "TEXT_AMBIGUOUS", "3": "FILE_NOT_ALLOWED", "4": "STALE_ITEM", "5": "TEXT_NOT_FOUND"}


RUN = "patch_id string, patch_checksum string, patch_applied boolean, syntax_ok boolean, tests_collected int, tests_passed int, tests_failed int, tests_errors int, exit_code int, timeout boolean, workspace_created boolean, workspace_cleaned boolean"


def test_gate(spark):
    runs = spark.createDataFrame([("p", "x", True, True, 3, 3, 0, 0, 0, False, True, True), ("q", "y", True, True, 3, 2, 1, 0, 1, False, True, True)], RUN).withColumn("status", evidence.validation_status())
    plans = spark.createDataFrame([("p", "x"), ("q", "y"), ("r", "z")], "patch_id string, patch_checksum string")
    out = {r["patch_id"]: r for r in evidence.apply_gate(plans, runs).collect()}
    assert out["p"]["may_apply"] and "STATUS" in out["q"]["failed"] and len(out["r"]["failed"]) == 14
    assert evidence.inconsistent(runs).count() == 0


def test_logs(spark):
    log = "start\nAPI_TOKEN=abc\n2 passed\n10 passed, 1 failed\n" + "x" * 300
    r = evidence.test_counts(spark.createDataFrame([(log,)], "log string")).first()
    assert (r["tests_passed"], r["tests_failed"], r["tests_errors"]) == (10, 1, 0) and "abc" not in r["tail"] and max(map(len, r["tail"].split("\n"))) == 200
    assert spark.range(1).select(redacted(F.lit("\n".join(map(str, range(60))))).alias("t")).first()["t"].split("\n") == [str(k) for k in range(10, 60)]


def test_links(spark):
    fact = "repo_id string, file string, fact string, name string, kind string, owner string, line int, target string"
    rows = [
        ("app/main.py", "import", "helper", "name", None, 1, "app.util:helper"), ("app/main.py", "import", "util", "module", None, 2, "app.util"), ("app/main.py", "import", "gone", "name", None, 3, "nowhere:gone"),
        ("app/main.py", "symbol", "Gate", "CLASS", None, 4, None), ("app/main.py", "symbol", "Gate.pay", "METHOD", None, 5, None), ("app/main.py", "symbol", "main", "FUNCTION", None, 9, None), ("app/util.py", "symbol", "helper", "FUNCTION", None, 1, None),
        ("app/main.py", "call", "helper", "name", "main", 10, None), ("app/main.py", "call", "helper", "module", "Gate.pay", 6, "util"), ("app/main.py", "call", "Gate.pay", "self", "Gate.pay", 7, None), ("app/main.py", "call", "gone", "name", "main", 11, None),
        ("app/main.py", "call", "x", "dynamic", "main", 12, None), ("app/bad.py", "error", "SyntaxError", None, None, 1, None),
    ]
    facts = spark.createDataFrame([("r", *r) for r in rows], fact)
    files = spark.createDataFrame([("r", f) for f in ("app/main.py", "app/util.py", "app/bad.py")], "repo_id string, file string")
    symbols = facts.filter("fact = 'symbol'").select("repo_id", "file", F.col("name").alias("qualified_name"), stable_id("symbol-", "repo_id", "file", "name").alias("symbol_id"))
    edges, rest = linking.link(facts, symbols, linking.bindings(facts, linking.module_names(files)))
    names = {r["symbol_id"]: r["qualified_name"] for r in symbols.collect()}
    assert {(names[r["caller_id"]], names[r["callee_id"]]) for r in edges.collect()} == {("main", "helper"), ("Gate.pay", "helper"), ("Gate.pay", "Gate.pay")}
    assert {r["name"]: r["reason"] for r in rest.collect()} == {"gone": "UNKNOWN_NAME", "x": "DYNAMIC_CALL"}
    out = linking.coverage(files, facts, edges, rest).first()
    assert (out["files_found"], out["files_failed"], out["files_parsed"], out["edges"], out["calls_unresolved"]) == (3, 1, 2, 3, 2)


def test_lines_of_equal_calls(spark):
    text = "// x\nfetch('/v')\n\nlet a = 1\nfetch('/v'); fetch('/v')\naxios.get(\n '/w')\nfetch('/v')"
    rows = code_facts.script_calls(spark.createDataFrame([("r", "a.js", text), ("r", "b.js", None)], "repo_id string, path string, content string")).collect()
    assert sorted((r["line"], r["path"]) for r in rows) == [(2, "/v"), (5, "/v"), (5, "/v"), (6, "/w"), (8, "/v")] and len({r["call_id"] for r in rows}) == 5


def test_script_facts(spark):
    text = "function load() {\n  axios.post(`https://a.example.com/u/${id}`, {name: 1, 'age': 2});\n}\nconst go = async (x) => fetch('/v', {method: 'PUT', body: JSON.stringify({k: 1})});\n"
    files = spark.createDataFrame([("r", "a.ts", text), ("r", "b.ts", "let x = 1")], "repo_id string, path string, content string")
    assert {(r["file"], r["qualified_name"], r["kind"]) for r in code_facts.script_functions(files).collect()} == {("a.ts", "load", "FUNCTION"), ("a.ts", "go", "FUNCTION"), ("b.ts", "<module>", "MODULE")}
    rows = {r["method"]: r for r in code_facts.script_calls(files).collect()}
    assert rows["post"]["path"] == "/u/{dynamic}" and rows["post"]["request_fields"] == ["age", "name"] and rows["post"]["line"] == 2 and rows["put"]["path"] == "/v" and rows["put"]["symbol"] == "load"


def stream(spark, rows, schema, run, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "x.json").write_text("\n".join(map(json.dumps, rows)))
    out = run(spark.readStream.schema(schema).json(str(at)))
    out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_retry_stream_equals_batch(spark, tmp_path):
    rows = [{"patch_id": f"p{i % 3}", "attempt_number": i // 3 + 1, "status": ("TESTS_FAILED", "TIMEOUT", "TESTS_PASSED", "RUNNER_ERROR")[(i * 7 + i // 3) % 4], "strategy": ("SMALL", "MEDIUM", "STRONG")[i % 3], "budget": 8000} for i in range(15)]
    schema = "patch_id string, attempt_number int, status string, strategy string, budget int"
    ours = stream(spark, rows, schema, streams.retry_actions, tmp_path)
    batch = evidence.next_actions(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).select(*ours.columns)
    assert sorted(map(str, ours.collect())) == sorted(map(str, batch.collect()))


def test_chain_stream_equals_batch(spark, tmp_path):
    rows, before = [], "0" * 64
    for i in range(6):
        h = hashlib.sha256(f"{i}{before}".encode()).hexdigest()
        rows.append({"log_id": "l", "event_index": i, "previous_event_hash": before, "event_hash": "bad" if i == 3 else h})
        before = h
    schema, digest = "log_id string, event_index int, previous_event_hash string, event_hash string", F.sha2(F.concat(F.col("event_index").cast("string"), "previous_event_hash"), 256)
    ours = stream(spark, rows, schema, lambda s: streams.chain_violations(s, digest), tmp_path)
    table = spark.createDataFrame([tuple(r.values()) for r in rows], schema).withColumn("event_type", F.lit(None).cast("string"))
    batch = audit.chain_violations(table, digest)
    assert sorted(map(str, ours.collect())) == sorted(map(str, batch.collect())) and batch.count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 3)], "id int, z string, a int")
    tables.write_canonical(rows, str(tmp_path / "c"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert sorted(lines) == ['{"a":3,"id":1,"z":"a"}', '{"id":2,"z":"b"}']
    assert tables.checksum(rows).first() == tables.checksum(rows.orderBy("id")).first()
    assert tables.write_once(rows, str(tmp_path / "w")) == "written" and tables.write_once(rows.orderBy("id"), str(tmp_path / "w")) == "unchanged"
    with pytest.raises(ValueError):
        tables.write_once(rows.limit(1), str(tmp_path / "w"))
