"""Registered queries: each derives an operator's input from the given tables by fixed arithmetic, over all of their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_partition, redacted, stable_id
from ..operators import audit, calibration, code_facts, dataset, diff, edits, evidence, graph, match, ranking, risk, routing, selection
from ..sources import tables as sources
from ..storage import shared_dir
from ..streaming import feedback as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task takes where texts are made of them.
EACH = 50_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over tasks by their number: what is made of them is far larger than the files that they come from."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, -(-rows.count() // EACH)), key)


def _nodes(part: DataFrame, fresh: bool) -> DataFrame:
    """part as schema nodes: an operation a brand and type, a property a part; the new version differs by arithmetic."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(F.lit("string"), F.lit("integer"), F.lit("number")), (size % 3 + 1).cast("int"))
    types = F.array(F.when(k % 13 == 0, "object").otherwise(kind)) if fresh else F.array(kind)
    enum = F.when(size % 5 == 0, F.array(F.lit('"a"'), F.lit('"b"'))).otherwise(F.array().cast("array<string>"))
    enum = F.when((k % 11 == 0) & (size % 5 == 0), F.array(F.lit('"a"'))).otherwise(enum) if fresh else enum
    rows = part.filter(k % 17 != 0) if fresh else part
    base = rows.select(
        F.col("p_brand").alias("path"), F.col("p_type").alias("method"), F.when(k % 2 == 0, "request").otherwise("response").alias("context"), F.when(k % 2 == 0, "").otherwise("200").alias("code"), F.lit("json").alias("media_type"),
        k.cast("string").alias("node_path"), F.lit("").alias("parent_path"), types.alias("types"), (size % (4 if fresh else 2) == 0).alias("nullable"), enum.alias("enum_json"), F.lit("SUPPORTED").alias("support_status"),
    )
    root = base.select("path", "method", "context", "code", "media_type", F.lit("").alias("node_path"), F.lit(None).cast("string").alias("parent_path"), F.array(F.lit("object")).alias("types"), F.lit(False).alias("nullable"), F.array().cast("array<string>").alias("enum_json"), F.lit("SUPPORTED").alias("support_status")).distinct()
    return base.unionByName(root)


@query("""
WITH p AS (SELECT p_brand AS path, p_type AS method, p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 2 = 0 THEN 'request' ELSE 'response' END AS context FROM part),
live AS (SELECT DISTINCT path, method, context FROM p WHERE k % 17 <> 0),
n AS (SELECT *, ['string', 'integer', 'number'][s % 3 + 1] AS ty, CASE WHEN context = 'request' THEN 'request.body[json].' ELSE 'response.200[json].' END || k AS location FROM p),
c AS (
  SELECT CASE WHEN context = 'request' THEN 'request_property_removed' ELSE 'response_property_removed' END AS category, path, method, location,
    CASE WHEN context = 'request' THEN 'POTENTIALLY_BREAKING' ELSE 'CLIENT_BREAKING' END AS classification FROM n JOIN live USING (path, method, context) WHERE k % 17 = 0
  UNION ALL SELECT CASE WHEN context = 'request' THEN 'request_type_changed' ELSE 'response_type_changed' END, path, method, location, 'CLIENT_BREAKING' FROM n WHERE k % 17 <> 0 AND k % 13 = 0
  UNION ALL SELECT 'nullable_removed', path, method, location, CASE WHEN context = 'request' THEN 'CLIENT_BREAKING' ELSE 'POTENTIALLY_BREAKING' END FROM n WHERE k % 17 <> 0 AND s % 2 = 0 AND s % 4 <> 0
  UNION ALL SELECT 'enum_restricted', path, method, location, 'POTENTIALLY_BREAKING' FROM n WHERE k % 17 <> 0 AND s % 5 = 0 AND k % 11 = 0)
SELECT 'api-change-' || substr(sha256(category || chr(31) || path || chr(31) || method || chr(31) || location), 1, 24) AS change_id, category, path, method, location, classification FROM c
""")
def contract_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old, new = _nodes(part, False), _nodes(part, True)
    rows = diff.removed_properties(old, new).unionByName(diff.changed_nodes(old, new), allowMissingColumns=True)
    return rows.select("change_id", "category", "path", "method", "location", "classification")


@query("""
WITH o AS (SELECT DISTINCT p_brand AS path, p_type AS method FROM part), n AS (SELECT DISTINCT p_brand AS path, p_type AS method FROM part WHERE p_partkey % 23 = 0)
SELECT CASE WHEN path IN (SELECT path FROM n) THEN 'http_method_removed' ELSE 'endpoint_removed' END AS category, path, method FROM o WHERE (path, method) NOT IN (SELECT (path, method) FROM n)
""")
def removed_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ops = lambda df: df.select(F.col("p_brand").alias("path"), F.col("p_type").alias("method")).distinct()
    return diff.removed_operations(ops(part), ops(part.filter("p_partkey % 23 = 0"))).select("category", "path", "method")


@query("""
WITH p AS (SELECT l_partkey AS path, l_suppkey AS name, bool_or(l_linenumber % 2 = 0) AS required, l_shipdate >= TIMESTAMP '1997-01-01' AS fresh FROM lineitem GROUP BY ALL)
SELECT CAST(n.path AS VARCHAR) AS path, 'parameter.query.' || n.name AS location FROM p n LEFT JOIN p o ON NOT o.fresh AND o.path = n.path AND o.name = n.name
WHERE n.fresh AND n.required AND NOT coalesce(o.required, false)
""")
def required_param_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("path"), F.col("l_suppkey").cast("string").alias("name"), (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")).alias("fresh")).agg(F.bool_or(F.col("l_linenumber") % 2 == 0).alias("required"))
    rows = rows.withColumn("method", F.lit("get")).withColumn("location", F.lit("query"))
    return diff.added_required_parameters(rows.filter("not fresh"), rows.filter("fresh")).select("path", "location")


@query("""
WITH o AS (SELECT n_nationkey AS path, n_regionkey % 2 AS a, n_nationkey % 3 AS b FROM nation)
SELECT CAST(path AS VARCHAR) AS path, CASE WHEN a = 0 THEN 'CLIENT_BREAKING' ELSE 'POTENTIALLY_BREAKING' END AS classification FROM o WHERE a <> b
""")
def changed_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    need = lambda c: F.when(c == 0, F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))
    side = lambda c: n.select(F.col("n_nationkey").cast("string").alias("path"), F.lit("get").alias("method"), need(c).alias("security"))
    return diff.changed_security(side(F.col("n_regionkey") % 2), side(F.col("n_nationkey") % 3)).select("path", "classification")


def _page_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("at", F.try_parse_url("url", F.lit("PATH")))
    none = F.array().cast("array<string>")
    return pages.select(
        F.col("page_id").cast("string").alias("call_id"), F.lit("site").alias("repo_id"), F.concat(F.lit("s"), F.col("page_id") % 50).alias("symbol_id"), F.lit("get").alias("method"), F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), F.col("at").alias("path"),
        F.when(F.col("page_id") % 7 == 0, "PARTIAL").otherwise("EXACT").alias("url_state"), none.alias("request_fields"), F.lit("EXACT").alias("request_state"), none.alias("query_parameters"), none.alias("headers"), none.alias("response_fields"), F.lit("EXACT").alias("response_state"),
    )


def _page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates from the pages themselves: each path once with its last part variable, and each first path of a host as it is."""
    at = table(spark, sf_dir, "pages").select(F.try_parse_url("url", F.lit("PATH")).alias("p"), F.try_parse_url("url", F.lit("HOST")).alias("h"))
    open_ = at.select(F.regexp_replace("p", "[^/]+$", "{id}").alias("path"))
    exact = at.groupBy("h").agg(F.min("p").alias("path")).select("path")
    gone = at.select(F.concat("p", F.lit("/gone")).alias("path"))
    rows = open_.unionByName(exact).unionByName(gone).distinct()
    return rows.select(stable_id("c-", "path").alias("change_id"), F.lit("endpoint_removed").alias("category"), "path", F.lit("get").alias("method"), F.lit("operation").alias("location"))


_PAGES = """
WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages),
t AS (SELECT regexp_replace(p, '[^/]+$', '{id}') AS path FROM a UNION SELECT min(p) FROM a GROUP BY h UNION SELECT p || '/gone' FROM a),
c AS (SELECT 'c-' || substr(sha256(path), 1, 24) AS change_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS x FROM t),
d AS (SELECT page_id, p, list_filter(string_split(p, '/'), lambda x: x <> '') AS y FROM a),
m AS (SELECT change_id, page_id, path = p AS same, page_id % 7 = 0 AS part FROM c JOIN d ON len(x) = len(y) AND len(list_filter(list_zip(x, y), lambda z: NOT (z[1] = z[2] OR regexp_matches(z[1], '^\\{[^{}]*\\}$')))) = 0)
"""


def template_match_sql() -> str:
    return _PAGES + """
SELECT change_id, CAST(page_id AS VARCHAR) AS call_id, (CASE WHEN same THEN 0.3 WHEN part THEN 0.18 ELSE 0.24 END::DOUBLE + 0.2::DOUBLE + 0.05::DOUBLE + CASE WHEN part THEN 0.02 ELSE 0.05 END::DOUBLE) / 0.8::DOUBLE AS score FROM m
"""


@query(template_match_sql())
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.impacts(_page_changes(spark, sf_dir), _page_calls(spark, sf_dir))
    return found.select("change_id", "call_id", "score")


@query(_PAGES + "SELECT change_id, path, 0::BIGINT AS looked_at FROM c WHERE change_id NOT IN (SELECT change_id FROM m)")
def unmatched_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, calls = _page_changes(spark, sf_dir), _page_calls(spark, sf_dir)
    return match.unmatched(changes, match.candidate_pairs(changes, calls), match.impacts(changes, calls)).select("change_id", "path", "looked_at")


@query(_PAGES + "SELECT 'f' || change_id AS change_id, count(*) AS looked_at, CAST(sum(page_id) AS BIGINT) AS calls FROM m GROUP BY change_id")
def unmatched_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: changes of a field that no call names: every call of their template was looked at."""
    changes, calls = _page_changes(spark, sf_dir), _page_calls(spark, sf_dir)
    changes = changes.withColumns({"change_id": F.concat(F.lit("f"), "change_id"), "category": F.lit("request_property_removed"), "location": F.lit("request.body[json].never")})
    pairs = match.candidate_pairs(changes, calls)
    found = match.impacts(changes, calls)
    calls_of = match.evaluated(pairs, found).groupBy("change_id").agg(F.sum(F.col("call_id").cast("long")).alias("calls"))
    return match.unmatched(changes, pairs, found).join(calls_of, "change_id").select("change_id", "looked_at", "calls")


@query("""
WITH x AS (SELECT page_id, html, regexp_extract_all(html, 'href="([^"]*)"', 1) AS g, regexp_extract_all(html, 'href="[^"]*"') AS w FROM pages),
e AS (SELECT page_id, html, unnest(range(len(g))) AS ordinal, g, w FROM x)
SELECT page_id, CAST(ordinal AS INTEGER) AS ordinal, g[ordinal + 1] AS "match", CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS INTEGER) AS line
FROM (SELECT *, array_to_string(list_slice(string_split_regex(html, 'href="[^"]*"'), 1, ordinal + 1), '') || array_to_string(list_slice(w, 1, ordinal), '') AS b FROM e)
""")
def link_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_facts.link_scan(table(spark, sf_dir, "pages"), "page_id", "html", 'href="([^"]*)"').select("page_id", "ordinal", "match", "line")


def _order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("caller_id"), F.lead("o_custkey").over(w).alias("callee_id"), F.col("o_orderkey").cast("string").alias("edge_id"))
    return rows.filter("callee_id is not null").withColumn("state", F.lit("EXACT"))


_EDGES = "SELECT o_custkey AS caller, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS callee FROM orders"


@query("""
WITH c AS (SELECT c_nationkey AS nation, CAST(c_custkey % 6 AS INTEGER) AS distance, c_acctbal FROM customer),
s AS (SELECT nation, count(*) FILTER (distance = 0) AS direct, count(*) FILTER (distance > 0) AS indirect, max(distance) AS max_distance FROM c GROUP BY nation),
x AS (SELECT *, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][nation % 4 + 1] AS severity, (nation % 10) / 10.0::DOUBLE AS score, nation % 3 = 0 AS incomplete, nation % 5 = 0 AS part FROM s),
y AS (SELECT nation, direct, indirect, max_distance, least(100.0::DOUBLE, CASE severity WHEN 'LOW' THEN 10 WHEN 'MEDIUM' THEN 25 WHEN 'HIGH' THEN 40 ELSE 50 END + score * 20 + least(direct, 3) * 5 + least(indirect, 5) * 5 + least(max_distance, 5) * 5 + CASE WHEN incomplete THEN 5 ELSE 0 END + CASE WHEN part THEN 3 ELSE 0 END) AS risk_score FROM x)
SELECT *, CASE WHEN risk_score <= 24 THEN 'LOW' WHEN risk_score <= 49 THEN 'MEDIUM' WHEN risk_score <= 74 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM y
""")
def blast_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 6).cast("int").alias("distance"))
    n = F.col("nation")
    levels = F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")])
    s = graph.summary(rows, "nation").withColumns({"severity": F.element_at(levels, (n % 4 + 1).cast("int")), "score": (n % 10) / 10.0, "incomplete": n % 3 == 0, "partial": n % 5 == 0})
    return risk.assess(s).select("nation", "direct", "indirect", "max_distance", "risk_score", "risk_level")


_SPLIT = "['TRAIN', 'VALIDATION', 'TEST'][CAST(list_sum(list_transform(range(1, 25), lambda i: position(substr(sha256('split' || chr(31) || '7' || chr(31) || g), i, 1) IN '0123456789abcdef') - 1)) AS BIGINT) % 3 + 1]"


@query(f"""
WITH d AS (SELECT source AS g, length(text) % 2 AS label FROM documents), p AS (SELECT *, {_SPLIT} AS split_partition FROM d)
SELECT split_partition, count(*) AS rows, count(DISTINCT g) AS groups, CASE WHEN split_partition <> 'TEST' THEN count(*) FILTER (label = 1) END AS positives, CASE WHEN split_partition <> 'TEST' THEN count(*) FILTER (label = 0) END AS negatives FROM p GROUP BY split_partition
""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("scenario_id"), (F.length("text") % 2).alias("label"))
    return dataset.partition_counts(dataset.split(rows, "scenario_id", 7))


_DOCS = "SELECT doc_id, sha256(text) AS whole, sha256(split_part(text, chr(10), 1)) AS first_line, CAST(length(text) // 100 AS VARCHAR) AS bucket, source AS g FROM documents"


def _doc_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("whole"), F.sha2(line, 256).alias("first_line"), F.floor(F.length("text") / 100).cast("string").alias("bucket"), hash_partition(F.col("source"), 7).alias("split_partition"))


@query(f"""
WITH d AS (SELECT *, {_SPLIT} AS p FROM ({_DOCS})), v AS (SELECT DISTINCT field, value, p FROM d UNPIVOT (value FOR field IN (whole, first_line, bucket)))
SELECT a.field, a.p AS a, b.p AS b, count(*) AS shared FROM v a JOIN v b ON a.field = b.field AND a.value = b.value AND a.p < b.p GROUP BY ALL
""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlap_matrix(_doc_prints(spark, sf_dir), ["whole", "first_line", "bucket"])


@query(f"""
WITH v AS (SELECT doc_id, field, value FROM ({_DOCS}) UNPIVOT (value FOR field IN (whole, first_line, bucket)))
SELECT field, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT field, value, count(*) AS n FROM v GROUP BY ALL) GROUP BY field
""")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_counts(_doc_prints(spark, sf_dir), ["whole", "first_line", "bucket"])


@query(f"""
WITH RECURSIVE d AS MATERIALIZED ({_DOCS}), v AS MATERIALIZED (SELECT doc_id, unnest([whole, first_line]) AS value, unnest([1, 2]) AS f FROM d), h AS MATERIALIZED (SELECT value, f, min(doc_id) AS head FROM v GROUP BY ALL),
l AS MATERIALIZED (SELECT DISTINCT doc_id AS a, head AS b FROM v JOIN h USING (value, f) WHERE doc_id <> head), e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS doc_id, min(b) AS component FROM r GROUP BY a
""")
def clone_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.clone_components(_doc_prints(spark, sf_dir).select("doc_id", "whole", "first_line"), "doc_id", ["whole", "first_line"])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = (F.col("n_chars") % 1000) / 1000.0
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("symbol_id"), F.col("source").alias("group_id"), "lang", F.col("quality").alias("label"), p.alias("score"), (F.col("doc_id") % 5).cast("int").alias("distance"))


_L = "l AS (SELECT doc_id, source AS group_id, lang, quality AS label, (n_chars % 1000) / 1000.0::DOUBLE AS score, doc_id % 5 AS distance FROM documents JOIN labels USING (doc_id))"
_G = """k AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_id) AS r FROM l),
g AS (SELECT {keys}, count(*) AS n, sum(label) AS pos, min(CASE WHEN label = 1 THEN r END) AS f, sum(CASE WHEN r <= 5 THEN label ELSE 0 END) AS h5, sum(CASE WHEN r <= 10 THEN label ELSE 0 END) AS h10,
  sum(CASE WHEN r <= 5 THEN label / log2(r + 1) ELSE 0 END) AS d5, sum(CASE WHEN r <= 10 THEN label / log2(r + 1) ELSE 0 END) AS d10 FROM k GROUP BY ALL),
m AS (SELECT *, h5 / least(5, n) AS p_at_5, CASE WHEN pos > 0 THEN h5 / pos ELSE 0 END AS r_at_5, h10 / least(10, n) AS p_at_10, CASE WHEN pos > 0 THEN h10 / pos ELSE 0 END AS r_at_10, CASE WHEN pos > 0 THEN 1.0::DOUBLE / f ELSE 0 END AS mrr,
  CASE WHEN pos > 0 THEN d5 / list_sum(list_transform(range(1, CAST(least(5, pos) AS BIGINT) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END AS ndcg_at_5,
  CASE WHEN pos > 0 THEN d10 / list_sum(list_transform(range(1, CAST(least(10, pos) AS BIGINT) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END AS ndcg_at_10 FROM g)"""
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ranking.METRICS)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(f"WITH {_L}, {_G.format(keys='group_id')} SELECT {_MEANS}, count(*) AS groups FROM m")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ranking.group_metrics(ranking.ranked(_labelled(spark, sf_dir)))
    return _rounded(ranking.mean_metrics(groups), *ranking.METRICS)


@query(f"WITH {_L}, {_G.format(keys='lang, group_id')} SELECT lang, {_MEANS}, count(*) AS groups, count(*) >= 2 AS supported FROM m GROUP BY lang")
def rank_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.slice_metrics(_labelled(spark, sf_dir), "lang"), *ranking.METRICS)


@query(f"WITH {_L}, {_G.format(keys='group_id')} SELECT group_id, n AS candidates, CAST(pos AS INTEGER) AS positives, round(r_at_5, 6) AS r_at_5, round(mrr, 6) AS mrr, round(ndcg_at_5, 6) AS ndcg_at_5, (SELECT string_agg(doc_id, ',' ORDER BY r) FROM k WHERE k.group_id = m.group_id AND r <= 5) AS top_5 FROM m")
def rank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.group_report(ranking.ranked(_labelled(spark, sf_dir)))
    return _rounded(out, "r_at_5", "mrr", "ndcg_at_5").withColumn("top_5", F.concat_ws(",", F.transform("top_5", lambda x: x.cast("string"))))


@query(f"WITH {_L}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, doc_id) AS r FROM l) SELECT CASE WHEN distance < 3 THEN CAST(distance AS VARCHAR) ELSE '3+' END AS distance_bucket, count(*) AS positives, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall FROM k WHERE label = 1 GROUP BY ALL")
def recall_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.recall_by_distance(ranking.ranked(_labelled(spark, sf_dir))), "recall")


_B = "b AS (SELECT least(CAST(floor(score * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(score) AS mean_prob, avg(label) AS rate FROM l GROUP BY ALL)"


@query(f"WITH {_L}, {_B} SELECT CAST(i AS INTEGER) AS bin, i / 10.0::DOUBLE AS low, (i + 1) / 10.0::DOUBLE AS high, coalesce(n, 0) AS n, round(mean_prob, 6) AS mean_prob, round(rate, 6) AS rate FROM range(10) t(i) LEFT JOIN b ON b.bin = i")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(calibration.reliability(_labelled(spark, sf_dir)), "mean_prob", "rate")


@query(f"WITH {_L}, {_B}, q AS (SELECT least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS q, * FROM l) SELECT (SELECT round(sum(n * abs(mean_prob - rate)) / sum(n), 6) FROM b) AS ece, round(avg((score - label) * (score - label)), 6) AS brier, round(avg(CASE WHEN label = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss FROM q")
def ece_brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return _rounded(calibration.expected_calibration_error(calibration.reliability(rows)).crossJoin(calibration.brier_log_loss(rows)), "ece", "brier", "log_loss")


@query(f"WITH {_L}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS k FROM l), s AS (SELECT sum(label) AS p, count(*) - sum(label) AS n, sum(CASE WHEN label = 1 THEN k ELSE 0 END) AS u FROM r) SELECT round((u - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM s")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(calibration.roc_auc(_labelled(spark, sf_dir)), "roc_auc")


@query(f"WITH {_L}, s AS (SELECT score, sum(label) AS p, count(*) AS n FROM l GROUP BY score), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM s) SELECT round(sum(p * cp / cn) / sum(p), 6) AS average_precision FROM c")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(calibration.average_precision(_labelled(spark, sf_dir)), "average_precision")


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_group_id"))
    rows = orders.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in routing.STRATEGIES]))).withColumn("i", routing.tie_rank(F.col("strategy")) - 1)
    k, i = F.col("decision_group_id"), F.col("i")
    outcomes = F.array(*[F.lit(x) for x in ("SUCCESS", "FAILURE", "UNKNOWN", "NOT_APPLICABLE")])
    return rows.select("decision_group_id", "strategy", F.element_at(outcomes, ((k * 7 + i * 3) % 4 + 1).cast("int")).alias("outcome"), ((k + i * 2) % 5).cast("double").alias("cost"), ((k + i) % 6).cast("double").alias("latency"), (60 + (k * 3 + i * 11) % 40).cast("double").alias("quality"))


_S = """s AS (SELECT o_orderkey AS g, i, ['NO_AI', 'DETERMINISTIC', 'SMALL', 'MEDIUM', 'STRONG'][i + 1] AS strategy, ['SUCCESS', 'FAILURE', 'UNKNOWN', 'NOT_APPLICABLE'][(o_orderkey * 7 + i * 3) % 4 + 1] AS outcome,
  CAST((o_orderkey + i * 2) % 5 AS DOUBLE) AS cost, CAST((o_orderkey + i) % 6 AS DOUBLE) AS latency, CAST(60 + (o_orderkey * 3 + i * 11) % 40 AS DOUBLE) AS quality FROM orders, range(5) t(i)),
f AS (SELECT *, outcome = 'SUCCESS' AND latency <= 4 AND quality >= 70 AS ok FROM s),
w AS (SELECT g, coalesce(arg_min(strategy, (cost, latency, -quality, i)) FILTER (ok), 'NO_FEASIBLE_STRATEGY') AS preferred, count(*) FILTER (ok) AS feasible FROM f GROUP BY g)"""


@query(f"WITH {_S} SELECT g AS decision_group_id, preferred, CAST(feasible AS INTEGER) AS feasible FROM w")
def preferred_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.preferred(_strategies(spark, sf_dir)).withColumn("feasible", F.size("feasible"))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("decision_group_id"), (k % 29 == 0).alias("no_repair_required"), F.when(k % 3 == 0, "UNSUPPORTED").otherwise("SUPPORTED").alias("m10_repairability"), (k % 4 != 1).alias("deterministic_rule_available"), (k % 5).alias("expected_edit_count"),
        (k % 7 == 0).cast("int").alias("repair_conflict_count"), (k % 11 == 0).cast("int").alias("coverage_unresolved_calls"), (k % 6).alias("ambiguity_flag_count"), (k % 8).alias("maximum_graph_distance"), (k % 2 == 0).alias("dynamic_payload"), (k % 9 == 0).alias("shared_payload_ambiguity"),
    )


_R = """c AS (SELECT o_orderkey AS k FROM orders),
d AS (SELECT k, CASE WHEN k % 29 = 0 THEN 1 WHEN k % 3 = 0 AND k % 4 = 1 THEN 2 WHEN k % 3 <> 0 AND k % 4 <> 1 AND k % 5 <= 1 AND k % 7 <> 0 AND k % 11 <> 0 THEN 3 WHEN k % 7 = 0 OR k % 6 >= 2 OR k % 8 >= 3 THEN 4 WHEN k % 2 = 0 OR k % 9 = 0 OR k % 11 = 0 THEN 5 ELSE 6 END AS rule FROM c),
e AS (SELECT k, rule, ['NO_AI', 'NO_FEASIBLE_STRATEGY', 'DETERMINISTIC', 'STRONG', 'MEDIUM', 'SMALL'][rule] AS chosen FROM d)"""


@query(f"WITH {_R} SELECT k AS decision_group_id, chosen, rule FROM e")
def rule_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("decision_group_id", routing.rules().alias("r")).select("decision_group_id", "r.chosen", "r.rule")


@query(f"""WITH {_S}, {_R}, p AS (SELECT 'rules' AS policy, k AS g, chosen FROM e UNION ALL SELECT 'small', k, CASE WHEN k % 29 = 0 THEN 'NO_AI' ELSE 'SMALL' END FROM c UNION ALL SELECT 'strong', k, CASE WHEN k % 29 = 0 THEN 'NO_AI' ELSE 'STRONG' END FROM c),
j AS (SELECT p.policy, p.chosen, w.preferred, f.outcome, f.cost, f.latency, o.cost AS best, CASE WHEN p.chosen = 'NO_FEASIBLE_STRATEGY' THEN w.preferred = p.chosen ELSE coalesce(f.ok, false) END AS ok FROM p JOIN w USING (g) LEFT JOIN f ON f.g = p.g AND f.strategy = p.chosen LEFT JOIN f o ON o.g = p.g AND o.strategy = w.preferred)
SELECT policy, count(*) AS groups, round(avg(CAST(ok AS INTEGER)), 6) AS satisfied, round(avg(cost), 6) AS mean_cost, round(avg(latency), 6) AS mean_latency, round(sum(coalesce(cost, 0)) / nullif(count(*) FILTER (ok), 0), 6) AS cost_per_success, round(avg(CASE WHEN chosen = 'STRONG' THEN 1.0 ELSE 0 END), 6) AS strong_share,
  round(count(*) FILTER (preferred = 'NO_FEASIBLE_STRATEGY' AND chosen = preferred) / nullif(count(*) FILTER (preferred = 'NO_FEASIBLE_STRATEGY'), 0), 6) AS no_feasible_handled,
  round(avg(CASE WHEN ok THEN CASE WHEN chosen = 'NO_FEASIBLE_STRATEGY' THEN 0 ELSE cost - best END END), 6) AS mean_regret, count(*) FILTER (outcome = 'UNKNOWN') AS unknown FROM j GROUP BY policy""")
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = routing.decisions(_contexts(spark, sf_dir), {"rules": routing.rules()["chosen"], "small": routing.always("SMALL")(), "strong": routing.always("STRONG")()})
    out = routing.policy_metrics(routing.evaluated(chosen, _strategies(spark, sf_dir)), "policy")
    names = ["satisfied", "mean_cost", "mean_latency", "cost_per_success", "strong_share", "no_feasible_handled", "mean_regret"]
    return _rounded(out, *names).select("policy", "groups", *names, "unknown")


_COEFFICIENTS = [("edits", None, 0.8), ("status", "F", -0.6), ("status", "O", 0.4), ("status", "P", 0.1), ("strategy", "DETERMINISTIC", -0.2), ("strategy", "SMALL", 0.3), ("strategy", "MEDIUM", 0.3), ("strategy", "STRONG", 0.1)]


@query("""
WITH x AS (SELECT o_orderkey AS context_id, s.strategy, s.w + CASE o_orderstatus WHEN 'F' THEN -0.6 WHEN 'O' THEN 0.4 WHEN 'P' THEN 0.1 ELSE 0 END::DOUBLE + 0.8::DOUBLE * ((o_orderkey % 5) - 2) / 2 + 0.05::DOUBLE AS score, s.o
  FROM orders, (VALUES ('DETERMINISTIC', -0.2::DOUBLE, 1), ('SMALL', 0.3::DOUBLE, 2), ('MEDIUM', 0.3::DOUBLE, 3), ('STRONG', 0.1::DOUBLE, 4)) s(strategy, w, o))
SELECT context_id, arg_min(strategy, (-round(score, 9), o)) AS chosen, round(max(score), 6) AS score FROM x GROUP BY context_id
""")
def score_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("context_id"), (F.col("o_orderkey") % 5).alias("edits"), F.col("o_orderstatus").alias("status"))
    weights = spark.createDataFrame(_COEFFICIENTS, "feature string, value string, coefficient double")
    scores = routing.linear_scores(contexts, weights, 0.05, {"edits": (2.0, 2.0)}, ["status"])
    return _rounded(routing.best_scores(scores.withColumn("score", F.round("score", 9))), "score")


@query(f"WITH {_S} SELECT strategy, count(*) FILTER (outcome = 'SUCCESS') AS SUCCESS, count(*) FILTER (outcome = 'FAILURE') AS FAILURE, count(*) FILTER (outcome = 'UNKNOWN') AS UNKNOWN, count(*) FILTER (outcome = 'NOT_APPLICABLE') AS NOT_APPLICABLE FROM s GROUP BY strategy")
def strategy_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.strategy_support(_strategies(spark, sf_dir))


@query("""
WITH RECURSIVE i AS MATERIALIZED (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
s(conv_id, r, used, picked) AS (SELECT conv_id, r, CASE WHEN n <= 800 THEN n ELSE 0 END, n <= 800 FROM i WHERE r = 1 UNION ALL SELECT i.conv_id, i.r, CASE WHEN s.used + i.n <= 800 THEN s.used + i.n ELSE s.used END, s.used + i.n <= 800 FROM s JOIN i ON i.conv_id = s.conv_id AND i.r = s.r + 1)
SELECT i.conv_id, i.turn, s.picked AS selected FROM i JOIN s USING (conv_id, r)
""")
def budget_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"), F.lit(None).cast("string").alias("file"))
    return selection.fill(items, "conv_id", ["turn"], required=None, budget=800).select("conv_id", "turn", "selected")


@query("""
WITH e AS (SELECT l_orderkey AS file, l_linenumber AS edit_id, CAST(l_partkey % 40 AS BIGINT) AS s, CAST(l_partkey % 40 + l_quantity % 9 + 1 AS BIGINT) AS t FROM lineitem),
w AS (SELECT *, lag(edit_id) OVER o AS previous_id, lag(s) OVER o AS ps, lag(t) OVER o AS pt, max(t) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e WINDOW o AS (PARTITION BY file ORDER BY s, t, edit_id))
SELECT file, edit_id, previous_id, CASE WHEN s = ps AND t = pt THEN 'DUPLICATE_EDIT' ELSE 'OVERLAPPING_EDIT' END AS code FROM w WHERE (s = ps AND t = pt) OR s < reach
""")
def edit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_partkey") % 40
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("edit_id"), at.alias("start_offset"), (at + F.col("l_quantity") % 9 + 1).cast("long").alias("end_offset"))
    return edits.edit_conflicts(rows)


@query("SELECT item_id AS file, substr(text, 1, 3) || '<a>' || substr(text, 7, 4) || '<b>' || substr(text, 15) AS new_text, CAST(2 AS BIGINT) AS applied, CAST(1 AS BIGINT) AS stale FROM benchmark")
def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file"), F.col("text").alias("source"))
    one = lambda a, b, new: F.struct(F.lit(a).alias("start_offset"), F.lit(b).alias("end_offset"), F.lit(new).alias("replacement"))
    rows = files.withColumn("e", F.explode(F.array(one(3, 6, "<a>"), one(10, 14, "<b>"), one(20, 24, "<c>")))).select("file", "e.*", "source")
    text = F.expr("substring(source, start_offset + 1, end_offset - start_offset)")
    rows = rows.withColumn("original_text", F.when(F.col("start_offset") == 20, F.lit("\x00")).otherwise(text)).withColumn("original_hash", F.sha2("original_text", 256)).drop("source")
    return edits.apply_edits(files, rows)


@query(r"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN contains(x, '=') AND regexp_matches(x, '(?i)(secret|token|password|passwd|api[_-]?key|credential|authorization)') THEN '[REDACTED]' ELSE substr(x, 1, 200) END) AS x FROM documents)
SELECT doc_id, sha256(array_to_string(list_slice(x, greatest(1, len(x) - 49), len(x)), chr(10))) AS tail FROM l
""")
def redact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(redacted(F.col("text")), 256).alias("tail"))


def _attempts(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = ()) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    status = F.when(F.col("event_type") == "error", "TESTS_FAILED").when(F.col("event_type") == "click", "SYNTAX_ERROR").when(F.col("event_type") == "purchase", "TESTS_PASSED").otherwise("TIMEOUT")
    strategy = F.element_at(F.array(F.lit("SMALL"), F.lit("MEDIUM"), F.lit("STRONG")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("patch_id"), F.row_number().over(w).alias("attempt_number"), status.alias("status"), strategy.alias("strategy"), F.lit(8000).alias("budget"), *more)


_A = """a AS (SELECT CAST(user_id AS VARCHAR) AS patch_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt_number, CASE event_type WHEN 'error' THEN 'TESTS_FAILED' WHEN 'click' THEN 'SYNTAX_ERROR' WHEN 'purchase' THEN 'TESTS_PASSED' ELSE 'TIMEOUT' END AS status, CAST(event_id % 3 AS INTEGER) AS s FROM events),
b AS (SELECT *, coalesce(sum(CASE WHEN status <> 'TESTS_PASSED' THEN 1 ELSE 0 END) OVER (PARTITION BY patch_id ORDER BY attempt_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
c AS (SELECT *, CASE WHEN status = 'TESTS_PASSED' THEN 'DONE' WHEN attempt_number > 3 THEN 'AI_REQUIRED' WHEN before = 0 THEN 'RETRY_WITH_MORE_CONTEXT' WHEN s < 2 THEN 'ESCALATE_TO_STRONGER_STRATEGY' ELSE 'AI_REQUIRED' END AS action FROM b)"""


@query(f"WITH {_A} SELECT patch_id, attempt_number, action, CASE WHEN action = 'RETRY_WITH_MORE_CONTEXT' THEN 16000 ELSE 8000 END AS next_budget FROM c")
def retry_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.next_actions(_attempts(spark, sf_dir)).select("patch_id", "attempt_number", "action", "next_budget")


@query(f"WITH {_A} SELECT patch_id, max(attempt_number) AS attempts, arg_max(status, attempt_number) AS final_status, CASE WHEN arg_max(status, attempt_number) = 'TESTS_PASSED' THEN 'RESOLVED' WHEN arg_max(action, attempt_number) IN ('RETRY_WITH_MORE_CONTEXT', 'ESCALATE_TO_STRONGER_STRATEGY') THEN 'OPEN' ELSE 'AI_REQUIRED' END AS result FROM c GROUP BY patch_id")
def terminal_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.terminal(evidence.next_actions(_attempts(spark, sf_dir)))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, sha256(user_id || '/' || event_id || '/' || event_type) AS h FROM events),
p AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY i) AS b FROM e)
SELECT CAST(user_id AS VARCHAR) AS log_id, CAST(i AS INTEGER) AS event_index, 'DIGEST' AS code FROM p WHERE event_id % 101 = 0
UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(i + 1 AS INTEGER), 'CHAIN' FROM p WHERE event_id % 101 = 0 AND EXISTS (SELECT 1 FROM p q WHERE q.user_id = p.user_id AND q.i = p.i + 1)
""")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    own = F.sha2(F.concat_ws("/", "user_id", "event_id", "event_type"), 256)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.row_number().over(w) - 1).alias("event_index"), own.alias("own"))
    rows = rows.withColumn("previous_event_hash", F.lag("own", 1, audit.ZERO).over(w)).withColumn("event_hash", F.when(F.col("event_id") % 101 == 0, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("own")))
    return audit.chain_violations(rows.withColumn("log_id", F.col("user_id").cast("string")), F.col("own"))


@query("SELECT field, value, count(*) AS rows FROM (SELECT lang, source, CAST(quality AS VARCHAR) AS quality FROM documents JOIN labels USING (doc_id)) UNPIVOT (value FOR field IN (lang, source, quality)) GROUP BY ALL")
def label_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return dataset.slice_counts(rows, ["lang", "source", "quality"])


@query("SELECT status, count(*) AS runs FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'TIMEOUT' WHEN l_returnflag = 'A' THEN 'PATCH_FAILED' WHEN l_linestatus = 'F' THEN 'SYNTAX_ERROR' WHEN l_partkey % 3 <> 0 AND l_suppkey % 2 = 0 AND l_orderkey % 3 = 0 THEN 'RUNNER_ERROR' WHEN l_suppkey % 2 + l_orderkey % 3 = 0 THEN 'NO_TESTS_COLLECTED' WHEN l_orderkey % 3 > 0 THEN 'TESTS_FAILED' ELSE 'TESTS_PASSED' END AS status FROM lineitem) GROUP BY status")
def validation_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_linenumber") == 7).alias("timeout"), (c("l_returnflag") != "A").alias("patch_applied"), (c("l_linestatus") != "F").alias("syntax_ok"), (c("l_partkey") % 3).alias("exit_code"), (c("l_suppkey") % 2).alias("tests_passed"), (c("l_orderkey") % 3).alias("tests_failed"), F.lit(0).alias("tests_errors"))
    return rows.groupBy(evidence.validation_status().alias("status")).agg(F.count("*").alias("runs"))


@query("SELECT user_action AS strategy, date_trunc('day', ts) AS start, count(*) AS records, count(*) FILTER (event_type = 'purchase') AS accepted FROM (SELECT *, event_type AS user_action FROM events) GROUP BY ALL")
def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 over the events as a stream with availableNow, in complete mode; its batch twin is the SQL."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("strategy"), F.when(F.col("event_type") == "purchase", "ACCEPTED").otherwise("REJECTED").alias("user_action"))
    name, at = f"feedback_{uuid.uuid4().hex[:8]}", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    counted = streams.acceptance(rows).select("start", "strategy", "records", "accepted")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{name}")

    counted.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{at}/{name}").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT field, value, count(*) AS rows, count(*) FILTER (quality = 1) AS positives, count(DISTINCT doc_id) AS distinct_keys FROM (SELECT doc_id, quality, unnest(['*', 'lang', 'source']) AS field, unnest(['*', lang, source]) AS value FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return sources.manifest(rows, ["lang", "source"], "doc_id", "quality")


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol_id of every customer with an order of a part that the version diff changes."""
    part = table(spark, sf_dir, "part")
    old, new = _nodes(part, False), _nodes(part, True)
    changes = diff.removed_properties(old, new).unionByName(diff.changed_nodes(old, new), allowMissingColumns=True)
    touched = changes.select(F.regexp_extract("location", r"\.(\d+)$", 1).cast("bigint").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(touched, "l_partkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("symbol_id")), "l_orderkey").select("symbol_id").distinct()


@query()
def callers_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of all touched customers to the fixpoint (callers_closure shows paths from some seeds over two rounds)."""
    return graph.distances(_touched(spark, sf_dir), _order_edges(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version diff of part, matched through lineitem to orders, propagated to customers, and scored by risk."""
    reach = graph.distances(_touched(spark, sf_dir), _order_edges(spark, sf_dir))
    hit = reach.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol_id"), "c_nationkey"), "symbol_id")
    s = graph.summary(hit, "c_nationkey").withColumns({"severity": F.lit("HIGH"), "score": F.lit(1.0), "incomplete": F.lit(False), "partial": F.lit(False)})
    return risk.assess(s).select("c_nationkey", "direct", "indirect", "max_distance", "risk_score", "risk_level")


from . import contract_queries, edit_queries, evidence_queries, feature_queries, graph_queries, model_queries, policy_queries, stream_queries  # noqa: E402, F401  they register their queries
