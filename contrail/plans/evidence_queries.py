"""Registered queries on contexts, edits, runs, feedback and candidate data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, dataset, edits, evidence, reach, selection
from .queries import _DOCS, _SPLIT, _doc_prints, query, table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as candidates of a context: change, call site or caller by the turn's number."""
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("context_id"), F.concat(F.lit("f"), t % 3, F.lit(".py")).alias("file"), F.col("role").alias("symbol"), t.alias("start_line"), (t + 1).alias("end_line"),
        F.coalesce("text", F.lit("")).alias("content"), (t % 4).cast("int").alias("graph_distance"), F.array(t.cast("string")).alias("provenance_ids"),
    )
    roles = ("API_CHANGE", "CALL_SITE", "CALLER")
    return selection.context_candidates({role: rows.filter(F.col("start_line") % 3 == i) for i, role in enumerate(roles)})


_T = """t AS (SELECT conv_id AS context_id, turn, 'f' || turn % 3 || '.py' AS file, role AS symbol, coalesce(text, '') AS content, turn % 4 AS graph_distance, ['API_CHANGE', 'CALL_SITE', 'CALLER'][turn % 3 + 1] AS kind, turn % 3 < 2 AS required
FROM conversations WHERE turn % 3 < 2 OR turn % 4 <= 2)"""


@query(f"WITH {_T} SELECT context_id, kind AS role, turn AS start_line, CASE kind WHEN 'API_CHANGE' THEN 1 WHEN 'CALL_SITE' THEN 2 ELSE 6 END AS priority, required, sha256(content) AS content_hash FROM t")
def context_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1."""
    return _turns(spark, sf_dir).select("context_id", "role", "start_line", "priority", "required", "content_hash")


@query(f"WITH {_T} SELECT context_id, CASE WHEN coalesce(sum(length(content)) FILTER (required), 0) > 600 THEN 'BUDGET_EXCEEDED' WHEN count(DISTINCT file) FILTER (required) > 1 THEN 'TOO_MANY_FILES' ELSE 'OK' END AS status FROM t GROUP BY context_id")
def required_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 with limits of 600 characters and one file."""
    return selection.required_status(_turns(spark, sf_dir), budget=600, files=1)


def _half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).withColumn("selected", F.col("start_line") % 2 == 0)


@query(f"""WITH {_T}, s AS (SELECT *, turn % 2 = 0 AS sel FROM t) SELECT context_id, count(*) FILTER (sel AND required) AS required_items, count(*) FILTER (sel AND NOT required) AS optional_items, count(DISTINCT file) FILTER (sel) AS files,
  count(DISTINCT symbol) FILTER (sel) AS symbols, max(graph_distance) FILTER (sel) AS max_distance, CAST(coalesce(sum(length(content)) FILTER (sel), 0) AS BIGINT) AS used, 8000 AS budget, count(*) FILTER (NOT sel) AS omitted FROM s GROUP BY context_id""")
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7."""
    return selection.selection_summary(_half(spark, sf_dir))


@query(f"WITH {_T} SELECT context_id, count(*) AS items, sha256(string_agg(sha256(content), chr(10) ORDER BY sha256(content))) AS checksum FROM t WHERE turn % 2 = 0 GROUP BY context_id")
def context_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8."""
    return selection.context_manifest(_half(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l, CASE doc_id % 9 WHEN 1 THEN '/d' || doc_id || '.py' WHEN 2 THEN '../d' || doc_id || '.py' WHEN 3 THEN 'a/my_secret' || doc_id || '.py' WHEN 4 THEN 'd' || doc_id || '.pem' WHEN 5 THEN 'd' || doc_id || '.txt' ELSE 'd' || doc_id || '.py' END AS file FROM documents),
n AS (SELECT *, doc_id_mod AS s, doc_id_mod + k % 3 AS e, len(list_filter(list_transform(range(1, len(l) + 1), lambda i: i < len(l) OR l[i] <> ''), lambda x: x)) AS lines FROM (SELECT *, k % 2 + 1 AS doc_id_mod FROM d)),
r AS (SELECT *, CASE k % 9 WHEN 1 THEN 'ABSOLUTE_PATH' WHEN 2 THEN 'PARENT_TRAVERSAL' WHEN 3 THEN 'SECRET_NAME' WHEN 4 THEN 'KEY_FILE' WHEN 5 THEN 'NOT_PYTHON' ELSE CASE WHEN k % 10 = 0 THEN 'FILE_MISSING' WHEN e > lines THEN 'SPAN_OUT_OF_RANGE' END END AS reason FROM n)
SELECT file, reason, CASE WHEN reason IS NULL THEN sha256(array_to_string(list_slice(l, s, e), chr(10)) || CASE WHEN e < len(l) THEN chr(10) ELSE '' END) END AS cut FROM r""")
def cut_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as files, with unsafe paths, missing files and spans beyond the end."""
    k = F.col("doc_id")
    name = lambda head, tail: F.concat(F.lit(head), k, F.lit(tail))
    odd = {1: name("/d", ".py"), 2: name("../d", ".py"), 3: name("a/my_secret", ".py"), 4: name("d", ".pem"), 5: name("d", ".txt")}
    path = name("d", ".py")
    for n, other in odd.items():
        path = F.when(k % 9 == n, other).otherwise(path)
    docs = table(spark, sf_dir, "documents").select(F.lit("r").alias("repo_id"), k, path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    spans = docs.select("repo_id", F.col("path").alias("file"), (k % 2 + 1).cast("int").alias("start_line"), (k % 2 + 1 + k % 3).cast("int").alias("end_line"), F.lit("").alias("content"))
    kept, left = selection.cut_spans(spans, docs.filter("doc_id % 10 <> 0").drop("doc_id"))
    return kept.select("file", F.lit(None).cast("string").alias("reason"), F.sha2("content", 256).alias("cut")).unionByName(left.select("file", "reason", F.lit(None).cast("string").alias("cut")))


@query("SELECT l_orderkey AS file, l_returnflag AS item_hash, l_linestatus AS original_hash, l_shipmode AS replacement, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS response_indexes FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS l_shipmode FROM lineitem) GROUP BY ALL")
def merged_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("item_hash"), F.col("l_linestatus").alias("original_hash"), F.when(F.col("l_partkey") % 2 == 0, "a").otherwise("b").alias("replacement"), F.col("l_linenumber").alias("response_index"))
    return edits.merge_proposed(rows).withColumn("response_indexes", F.array_join(F.transform("response_indexes", lambda x: x.cast("string")), ","))


@query("""WITH e AS (SELECT l_orderkey AS file, CASE l_partkey % 3 WHEN 0 THEN 'DETERMINISTIC_CANDIDATE' WHEN 1 THEN 'UNSUPPORTED' ELSE 'AI_REQUIRED' END AS outcome FROM lineitem)
SELECT count(*) FILTER (outcome = 'DETERMINISTIC_CANDIDATE') AS repairable, count(*) FILTER (outcome = 'UNSUPPORTED') AS unsupported, count(*) FILTER (outcome = 'AI_REQUIRED') AS ambiguous, count(*) AS edits, count(DISTINCT file) AS files, (SELECT count(*) FROM lineitem WHERE l_linenumber > 3) AS conflicts FROM e""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15."""
    rows = table(spark, sf_dir, "lineitem")
    third = F.col("l_partkey") % 3
    results = rows.select(F.when(third == 0, "DETERMINISTIC_CANDIDATE").when(third == 1, "UNSUPPORTED").otherwise("AI_REQUIRED").alias("outcome"))
    return edits.plan_summary(results, rows.select(F.col("l_orderkey").alias("file")), rows.filter("l_linenumber > 3"))


@query("SELECT o_orderkey AS k, CAST(o_orderkey % 5 AS INTEGER) AS tests_passed, CAST(o_orderkey % 3 AS INTEGER) AS tests_failed, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS tests_errors FROM orders")
def test_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last counts of logs that tell several."""
    k = F.col("o_orderkey")
    log = F.concat(k % 7, F.lit(" passed, 9 failed\n"), k % 5, F.lit(" passed, "), k % 3, F.lit(" failed"), F.when(k % 4 == 0, ", 1 error").otherwise(""))
    return evidence.test_counts(table(spark, sf_dir, "orders").select(k.alias("k"), log.alias("log"))).select("k", "tests_passed", "tests_failed", "tests_errors")


@query("""WITH o AS (SELECT o_orderkey AS k, ['NOT_REQUIRED', 'REFUSED', 'PROVIDER_ERROR', 'REJECTED', 'GENERATED', 'GENERATED'][o_orderkey % 6 + 1] AS g, CASE WHEN o_orderkey % 4 > 0 THEN ['TESTS_PASSED', 'TESTS_FAILED', 'TIMEOUT', 'SYNTAX_ERROR', 'RUNNER_ERROR'][o_orderkey % 5 + 1] END AS s FROM orders)
SELECT CAST(k AS VARCHAR) AS run_id, 'p' || k AS patch_id, CASE g WHEN 'NOT_REQUIRED' THEN 'NO_REPAIR_NEEDED' WHEN 'REFUSED' THEN g WHEN 'PROVIDER_ERROR' THEN g WHEN 'REJECTED' THEN 'REJECTED_OUTPUT'
  ELSE CASE WHEN s IS NULL THEN 'NOT_VALIDATED' WHEN k % 9 = 0 THEN 'INVALID_EVIDENCE' WHEN s = 'TESTS_PASSED' THEN 'SUCCESS' WHEN s IN ('TESTS_FAILED', 'SYNTAX_ERROR') THEN 'FAILURE' ELSE 'INFRASTRUCTURE_ERROR' END END AS outcome FROM o""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5."""
    k = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    orders = table(spark, sf_dir, "orders")
    plans = orders.select(k.cast("string").alias("run_id"), F.concat(F.lit("p"), k).alias("patch_id"), pick(6, "NOT_REQUIRED", "REFUSED", "PROVIDER_ERROR", "REJECTED", "GENERATED", "GENERATED").alias("generation_status"))
    runs = orders.filter("o_orderkey % 4 > 0").select(k.cast("string").alias("run_id"), F.when(k % 9 == 0, "stale").otherwise(F.concat(F.lit("p"), k)).alias("patch_id"), pick(5, "TESTS_PASSED", "TESTS_FAILED", "TIMEOUT", "SYNTAX_ERROR", "RUNNER_ERROR").alias("status"))
    return evidence.run_outcomes(plans, runs)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS patch_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END AS user_action, o_custkey AS context, CASE WHEN o_orderkey % 3 = 0 THEN 'SMALL' END AS strategy, CASE WHEN o_orderkey % 5 = 0 THEN 'TESTS_PASSED' END AS status FROM orders""")
def feedback_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8."""
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    patch = k.cast("string").alias("patch_id")
    actions = orders.select(patch, F.when(k % 2 == 0, "ACCEPTED").otherwise("REJECTED").alias("user_action"))
    routes, runs = orders.filter(k % 3 == 0).select(patch, F.lit("SMALL").alias("strategy")), orders.filter(k % 5 == 0).select(patch, F.lit("TESTS_PASSED").alias("status"))
    return evidence.feedback(orders.select(patch), orders.select(patch, F.col("o_custkey").alias("context")), routes, runs, actions)


@query("""WITH c AS (SELECT c_nationkey AS n, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'DIRECT' ELSE 'INDIRECT' END AS t, c_custkey % 5 AS d FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY n, t ORDER BY d, k) AS i FROM c)
SELECT n AS repo_id, count(*) FILTER (t = 'DIRECT') AS direct_count, count(*) FILTER (t = 'INDIRECT') AS indirect_count, coalesce(string_agg(k, ',' ORDER BY i) FILTER (t = 'DIRECT' AND i <= 8), '') AS direct, coalesce(string_agg(k, ',' ORDER BY i) FILTER (t = 'INDIRECT' AND i <= 12), '') AS indirect FROM r GROUP BY n""")
def impact_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first customers of each nation."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo_id"), k.alias("symbol_id"), F.when(k % 3 == 0, "DIRECT").otherwise("INDIRECT").alias("impact_type"), (k % 5).alias("distance"))
    out = evidence.impact_overview(rows)
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("direct", "indirect")})


@query("""WITH x AS (SELECT l_orderkey AS o, l_linenumber AS c FROM lineitem), y AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), z AS (SELECT l_orderkey AS o, l_linenumber AS c, l_suppkey AS s, l_partkey % 2 = 0 AS direct FROM lineitem WHERE l_partkey % 3 > 0)
SELECT x.o AS scenario_id, x.c AS change_id, y.s AS symbol_id, CASE WHEN z.direct THEN 'DIRECT' WHEN NOT z.direct THEN 'INDIRECT' END AS truth_type, CASE WHEN z.direct IS NULL THEN 0 ELSE 1 END AS label,
  'candidate-' || substr(sha256(x.o || chr(31) || x.c || chr(31) || y.s), 1, 24) AS row_id FROM x JOIN y ON x.o = y.o LEFT JOIN z ON z.o = x.o AND z.c = x.c AND z.s = y.s""")
def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: each order as a scenario: its lines as changes, its suppliers as symbols."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), F.col("l_linenumber").alias("change_id"), F.col("l_suppkey").alias("symbol_id"), "l_partkey")
    truth = rows.filter("l_partkey % 3 > 0").withColumn("truth_type", F.when(F.col("l_partkey") % 2 == 0, "DIRECT").otherwise("INDIRECT")).withColumn("truth_distance", F.lit(0))
    return dataset.candidates(rows.select("scenario_id", "change_id"), rows.select("scenario_id", "symbol_id").distinct(), truth).drop("truth_distance")


@query("""SELECT o_orderkey AS row_id, 'UNKNOWN_SCENARIO' AS code FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT o_orderkey, 'FINGERPRINT' FROM orders WHERE o_custkey % 10 <> 0 AND o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'PATH_START' FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, 'DUPLICATE_ID' FROM orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT o_orderkey, code FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_custkey % 10 = 0 THEN 'UNKNOWN_SCENARIO' END, CASE WHEN o_custkey % 10 <> 0 AND o_orderkey % 7 = 0 THEN 'FINGERPRINT' END, CASE WHEN o_orderkey % 6 = 0 THEN 'PATH_START' END], lambda x: x IS NOT NULL)) AS code FROM orders WHERE o_orderkey % 13 = 0)""")
def dataset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of their customers' scenarios; every thirteenth key stands twice."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("_copy", F.explode(F.when(k % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    path = F.when(k % 6 == 0, F.array(F.lit("other"))).when(k % 6 == 1, F.array(F.lit("s"), F.lit("t"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(k.alias("row_id"), F.col("o_custkey").alias("scenario_id"), F.when(k % 7 == 0, "stale").otherwise(F.md5(F.col("o_custkey").cast("string"))).alias("scenario_fingerprint"), path.alias("truth_path"), F.lit("s").alias("symbol"))
    scenarios = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scenario_id")).distinct().filter("scenario_id % 10 <> 0").withColumn("scenario_fingerprint", F.md5(F.col("scenario_id").cast("string")))
    return audit.dataset_violations(rows, scenarios)


@query(f"""WITH d AS (SELECT *, {_SPLIT} AS p FROM ({_DOCS})), v AS (SELECT field, value, p FROM d UNPIVOT (value FOR field IN (whole, first_line)))
SELECT field, value, string_agg(DISTINCT p, ',' ORDER BY p) AS partitions FROM v GROUP BY field, value HAVING count(DISTINCT p) > 1""")
def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11."""
    return audit.split_violations(_doc_prints(spark, sf_dir), ["whole", "first_line"]).withColumn("partitions", F.array_join("partitions", ","))


@query(f"""WITH v AS (SELECT field, value, bool_or(doc_id % 2 = 0) AS f, bool_or(doc_id % 2 = 1) AS o FROM ({_DOCS}) UNPIVOT (value FOR field IN (whole, first_line, bucket)) GROUP BY field, value)
SELECT field, count(*) FILTER (f) AS fresh, count(*) FILTER (o) AS old, count(*) FILTER (f AND o) AS overlap FROM v GROUP BY field""")
def historical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents as fresh rows, odd ones as two older sets."""
    prints = _doc_prints(spark, sf_dir)
    return audit.historical_overlap(prints.filter("doc_id % 2 = 0"), [prints.filter("doc_id % 4 = 1"), prints.filter("doc_id % 4 = 3")], ["whole", "first_line", "bucket"])


@query("""WITH m AS (SELECT p_brand AS b, bool_or(p_size % 25 = 0) AS held FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY sha256(b)) - 1 AS i FROM m)
SELECT p_partkey, p_brand AS component, CASE WHEN held THEN ['TRAIN', 'VALIDATION'][i % 2 + 1] ELSE ['TRAIN', 'VALIDATION', 'TEST'][i % 3 + 1] END AS split_partition FROM part JOIN r ON b = p_brand""")
def component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as components; brands with a part of some sizes may not go to the test."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("component"), "p_size")
    return dataset.component_split(part.drop("p_size"), "p_partkey", part.filter("p_size % 25 = 0").select("p_partkey"))


@query("""WITH e AS (SELECT p_brand AS a, p_type AS b FROM part) SELECT b AS symbol_id, count(DISTINCT a) AS direct_callers, count(DISTINCT a) AS upstream_callers FROM e GROUP BY b""")
def caller_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that call types; no type calls, so the closure ends after one step."""
    return reach.upstream_counts(table(spark, sf_dir, "part").select(F.col("p_brand").alias("caller_id"), F.col("p_type").alias("callee_id")))
