"""Registered queries from candidate rows to encoded features, fingerprints of scenarios, script facts and seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code_facts, dataset, graph, match, models, reach, risk
from .queries import _PAGES, _page_calls, _page_changes, _rounded, query, table



def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of pages as removals, fields and parameters in turn by the length of their path."""
    kind = F.length("path") % 3
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (kind + 1).cast("int"))
    rows = _page_changes(spark, sf_dir).withColumns({"category": pick("endpoint_removed", "request_property_removed", "required_parameter_added"), "location": pick("operation", "request.body[json].a", "parameter.query.q")})
    return rows.withColumns({"severity": F.when(kind == 0, "HIGH").otherwise("LOW"), "certainty": F.lit("EXACT"), "classification": F.lit("CLIENT_BREAKING"), "direction": F.lit("CLIENT")})


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("call_id").cast("long"), F.array().cast("array<string>")
    return _page_calls(spark, sf_dir).withColumns({"request_fields": F.when(k % 2 == 0, F.array(F.lit("a"))).otherwise(none), "query_parameters": F.when(k % 5 == 0, F.array(F.lit("q"))).otherwise(none), "request_state": F.when(k % 4 == 0, "PARTIAL").otherwise("EXACT")})


def _symbol_edges(spark: SparkSession) -> DataFrame:
    """Every symbol calls the one of half its number."""
    rows = [(f"s{i}", f"s{i // 2}", f"e{i}", "EXACT") for i in range(1, 50)]
    return spark.createDataFrame(rows, "caller_id string, callee_id string, edge_id string, state string")


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 and B2: every template with every symbol of the site; a third of the calls tell the truth."""
    changes, calls, edges = _changes(spark, sf_dir), _calls(spark, sf_dir), _symbol_edges(spark)
    direct = match.impacts(changes, calls)
    truth = direct.filter("call_id % 3 = 0").select(F.lit("site").alias("scenario_id"), "change_id", "symbol_id", F.lit("DIRECT").alias("truth_type"), F.lit(0).alias("truth_distance")).distinct()
    symbols = calls.select(F.lit("site").alias("scenario_id"), "symbol_id").distinct()
    rows = dataset.candidates(changes.select(F.lit("site").alias("scenario_id"), "change_id"), symbols, truth).drop("truth_distance")
    impacted = graph.distances(direct.filter("call_id % 10 = 0").select("symbol_id"), edges)
    coverage = calls.groupBy(F.col("repo_id").alias("scenario_id")).agg(F.count_if(F.col("url_state") == "PARTIAL").alias("calls_unresolved"), F.lit(0).alias("files_failed"))
    facts = {"severity": F.lit("LOW"), "score": F.lit(0.1), "incomplete": F.lit(True), "partial": F.lit(True), "scenario_id": F.lit("site")}
    return dataset.features(rows, changes, direct, impacted, calls, reach.upstream_counts(edges), coverage, risk.assess(graph.summary(impacted).withColumns(facts)))


_FEATURES = _PAGES.replace("WITH a AS", "WITH RECURSIVE a AS", 1) + """,
k AS (SELECT *, length(path) % 3 AS kind FROM c),
i AS (SELECT m.change_id, page_id, CAST(page_id AS VARCHAR) AS call_id, 's' || page_id % 50 AS symbol_id, kind, CASE WHEN kind = 0 THEN 5 ELSE 6 END AS evidence_size, 2 + CASE WHEN part THEN 0 ELSE 2 END + CASE WHEN kind = 2 OR kind = 1 AND page_id % 4 > 0 THEN 1 ELSE 0 END AS evidence_exact,
  ((CASE WHEN same THEN 0.3 WHEN part THEN 0.18 ELSE 0.24 END::DOUBLE + 0.25::DOUBLE + CASE WHEN part THEN 0.02 ELSE 0.05 END::DOUBLE + CASE WHEN kind = 0 THEN 0 ELSE 0.2 END::DOUBLE) / CASE WHEN kind = 0 THEN 0.8 ELSE 1 END::DOUBLE) AS score FROM m JOIN k USING (change_id) WHERE kind = 0 OR kind = 1 AND page_id % 2 = 0 OR kind = 2 AND page_id % 5 = 0),
b AS (SELECT change_id, symbol_id, arg_min(struct_pack(call_id := call_id, page_id := page_id, n := evidence_size, x := evidence_exact, score := score), (-round(score, 9), call_id)) AS d, bool_or(page_id % 3 = 0) AS truth FROM i GROUP BY ALL),
s AS (SELECT DISTINCT 's' || page_id % 50 AS symbol_id, page_id % 50 AS n FROM pages), f AS (SELECT 's' || page_id % 50 AS symbol_id, arg_min(page_id, CAST(page_id AS VARCHAR)) AS first_page FROM pages GROUP BY ALL),
g AS (SELECT i AS caller, i // 2 AS callee FROM range(1, 50) t(i)),
r(n, dist) AS (SELECT DISTINCT CAST(substr(symbol_id, 2) AS BIGINT), 0 FROM i WHERE page_id % 10 = 0 UNION SELECT caller, dist + 1 FROM r JOIN g ON callee = n),
dd AS (SELECT n, CAST(min(dist) AS INTEGER) AS dist FROM r GROUP BY n),
up(n, above) AS (SELECT callee, caller FROM g UNION SELECT up.n, caller FROM up JOIN g ON callee = above), cc AS (SELECT n, (SELECT count(*) FROM g WHERE callee = up.n) AS one, count(*) AS every FROM up GROUP BY n),
rk AS (SELECT least(100.0::DOUBLE, 10 + 2 + least(count(*) FILTER (dist = 0), 3) * 5 + least(count(*) FILTER (dist > 0), 5) * 5 + least(max(dist), 5) * 5 + 5 + 3) AS risk FROM dd),
o AS (SELECT k.change_id, s.symbol_id, k.kind, b.d, b.truth, coalesce(d.page_id, first_page) AS call_page, dd.dist, coalesce(one, 0) AS one, coalesce(every, 0) AS every, risk FROM k, s, rk LEFT JOIN b ON b.change_id = k.change_id AND b.symbol_id = s.symbol_id LEFT JOIN f ON f.symbol_id = s.symbol_id LEFT JOIN dd ON dd.n = s.n LEFT JOIN cc ON cc.n = s.n),
z AS (SELECT change_id, symbol_id, CASE WHEN truth THEN 1 ELSE 0 END AS label, ['endpoint_removed', 'request_property_removed', 'required_parameter_added'][kind + 1] AS change_category, CASE WHEN kind = 0 THEN 'HIGH' ELSE 'LOW' END AS change_severity,
  coalesce(d.n, 0) AS evidence_size, coalesce(d.x, 0) AS evidence_exact, CASE WHEN d IS NOT NULL THEN true END AS endpoint_path_match, CASE WHEN d IS NOT NULL AND kind = 1 THEN 1 ELSE 0 END AS request_field_overlap_size, CASE WHEN d IS NOT NULL AND kind = 2 THEN 1 ELSE 0 END AS parameter_overlap_size,
  d IS NOT NULL AS direct_reference, CASE WHEN call_page % 7 = 0 THEN 'PARTIAL' ELSE 'EXACT' END AS url_resolution_state, CASE WHEN call_page % 4 = 0 THEN 'PARTIAL' ELSE 'EXACT' END AS request_resolution_state, dist AS graph_distance, one AS direct_caller_count, every AS upstream_caller_count,
  (SELECT count(*) FROM pages WHERE page_id % 7 = 0) AS coverage_unresolved_calls, d.score AS m4_impact_score, risk AS m6_risk_score FROM o)"""
_SHOWN = (
    "change_id", "symbol_id", "label", "change_category", "change_severity", "evidence_size", "evidence_exact", "endpoint_path_match", "request_field_overlap_size", "parameter_overlap_size", "direct_reference", "url_resolution_state",
    "request_resolution_state", "graph_distance", "direct_caller_count", "upstream_caller_count", "coverage_unresolved_calls", "m4_impact_score", "m6_risk_score",
)


@query(f"""{_FEATURES} SELECT {", ".join(c for c in _SHOWN if c != "m4_impact_score")}, round(m4_impact_score, 6) AS m4_impact_score,
  array_to_string(list_filter([CASE WHEN label = 0 AND m6_risk_score >= 50 THEN 'HARD_NEGATIVE_HEURISTIC_SCORE' END, CASE WHEN url_resolution_state <> 'EXACT' THEN 'PARTIAL_OR_UNRESOLVED_URL' END, CASE WHEN coverage_unresolved_calls > 0 THEN 'UNRESOLVED_CALL_COVERAGE' END], lambda x: x IS NOT NULL), ',') AS flags FROM z""")
def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates with their features, lists as numbers, and what is odd about them."""
    rows = _feature_rows(spark, sf_dir).withColumn("flags", F.array_join(dataset.flags(), ","))
    return _rounded(models.flattened(rows).select(*_SHOWN, "flags"), "m4_impact_score")


@query(f"""{_FEATURES}, tt AS (SELECT * FROM z WHERE graph_distance IS NULL OR graph_distance <= 3),
n AS (SELECT avg(m4_impact_score) AS m, stddev_pop(m4_impact_score) AS s, avg(upstream_caller_count) AS um, stddev_pop(upstream_caller_count) AS us FROM tt)
SELECT change_id, symbol_id, round(CASE WHEN m4_impact_score IS NULL THEN 1 ELSE (m4_impact_score - m) / CASE WHEN s = 0 THEN 1 ELSE s END END + (upstream_caller_count - um) / CASE WHEN us = 0 THEN 1 ELSE us END + 2, 5) AS total FROM z, n""")
def encoded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: two numbers and two categories of all candidates, encoded by rows near a seed; the sum of each vector."""
    rows = models.flattened(_feature_rows(spark, sf_dir))
    numeric, categorical = ("m4_impact_score", "upstream_caller_count"), ("change_category", "url_resolution_state")
    models.allowed(rows, [*numeric, *categorical], dataset.FEATURES)
    train = rows.filter("graph_distance is null or graph_distance <= 3")
    coded = models.Encoder.fit(train, numeric, categorical).transform(rows)
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return coded.select("change_id", "symbol_id", F.round(total, 5).alias("total"))


_WORDS = " || chr(31) || ".join(f"CAST(sum(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT) AS BIGINT)" for k in range(4))


@query(f"""WITH r AS (SELECT l_orderkey, md5(l_partkey || chr(31) || l_linenumber) AS a, md5(CAST(l_suppkey AS VARCHAR)) AS b FROM lineitem)
SELECT x.l_orderkey AS scenario_id, x.p AS candidate_fp, y.p AS structural_fp FROM (SELECT l_orderkey, sha256(count(*) || chr(31) || {_WORDS.replace("(h,", "(a,")}) AS p FROM r GROUP BY ALL) x JOIN (SELECT l_orderkey, sha256(count(*) || chr(31) || {_WORDS.replace("(h,", "(b,")}) AS p FROM r GROUP BY ALL) y USING (l_orderkey)""")
def scenario_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scenarios, their lines as candidates, their suppliers as structure."""
    return dataset.scenario_fingerprints(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "scenario_id"), "scenario_id", {"candidate_fp": ("l_partkey", "l_linenumber"), "structural_fp": ("l_suppkey",)})


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of each page: a function that fetches the page, then two equal calls, the second a line further down."""
    k = F.col("page_id").cast("string")
    text = F.concat(F.lit("// page "), k, F.lit("\nfunction load"), k, F.lit("() {\n  return fetch(`"), F.col("url"), F.lit("?v=${x}`);\n}\naxios.post('/log', {page: 1, at: 2});\n"), F.when(k.cast("long") % 2 == 0, "\n").otherwise(""), F.lit("axios.post('/log', {page: 1, at: 2});\n"))
    return table(spark, sf_dir, "pages").select(F.lit("site").alias("repo_id"), F.concat(k, F.lit(".js")).alias("path"), text.alias("content"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, page_id % 2 = 0 AS gap FROM pages)
SELECT page_id || '.js' AS file, CAST(line AS INTEGER) AS line, library, method, symbol, fields, host FROM (SELECT page_id, 3 AS line, 'fetch' AS library, 'get' AS method, 'load' || page_id AS symbol, '' AS fields, lower(host) AS host FROM p
  UNION ALL SELECT page_id, 5, 'axios', 'post', 'load' || page_id, 'at,page', NULL FROM p UNION ALL SELECT page_id, CASE WHEN gap THEN 7 ELSE 6 END, 'axios', 'post', 'load' || page_id, 'at,page', NULL FROM p)""")
def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls of the scripts of all pages with their own lines and the function that owns them."""
    rows = code_facts.script_calls(_scripts(spark, sf_dir))
    return rows.select("file", "line", "library", "method", "symbol", F.array_join("request_fields", ",").alias("fields"), "host")


@query("SELECT page_id || '.js' AS file, 'load' || page_id AS qualified_name, CAST(2 AS INTEGER) AS line, 'FUNCTION' AS kind FROM pages")
def script_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2."""
    return code_facts.script_functions(_scripts(spark, sf_dir)).select("file", "qualified_name", "line", "kind")


@query("SELECT CAST(page_id AS VARCHAR) AS call_id, CASE WHEN page_id % 7 = 0 OR page_id % 2 = 0 AND page_id % 4 = 0 THEN 'PARTIAL' ELSE 'EXACT' END AS state FROM pages")
def call_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the worst state of each call."""
    return code_facts.overall_state(_calls(spark, sf_dir)).select("call_id", "state")


@query("""SELECT o_orderkey AS impact_id, CASE WHEN o_custkey % 3 = 0 THEN 'sym' || o_custkey WHEN o_custkey % 3 = 1 THEN 'sym' || (o_custkey + 1000000) END AS symbol_id FROM orders""")
def seed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as impacts of their customer's call; a third of the customers own a symbol, a third are found by file and name, the rest by nothing."""
    k = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    calls = customer.select(k.alias("call_id"), F.concat(F.lit("sym"), k).alias("symbol_id"), F.concat(F.lit("f"), k).alias("file"), F.concat(F.lit("n"), k).alias("symbol"), F.lit("r").alias("repo_id"))
    own = customer.filter(k % 3 == 0).select(F.concat(F.lit("sym"), k).alias("symbol_id"), F.lit("other").alias("file"), F.lit("other").alias("qualified_name"))
    named = customer.filter(k % 3 == 1).select(F.concat(F.lit("sym"), k + 1000000).alias("symbol_id"), F.concat(F.lit("f"), k).alias("file"), F.concat(F.lit("n"), k).alias("qualified_name"))
    symbols = reduce(DataFrame.unionByName, (own, named)).withColumn("repo_id", F.lit("r"))
    impacts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("impact_id"), F.col("o_custkey").alias("call_id"))
    return graph.seeds(impacts, calls, symbols).select("impact_id", "symbol_id")
