"""Registered queries on merged candidates, evidence gates, screened edits, seals and the order of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import numbered
from ..operators import audit, edits, selection
from ..sources import verified
from .queries import SQL, contract_diff, query, table


@query("""
WITH i AS (SELECT l_orderkey AS c, ['API_CHANGE', 'CALL_SITE', 'CALLER'][l_linenumber % 3 + 1] AS role, [1, 2, 6][l_linenumber % 3 + 1] AS pr, 'f' || l_suppkey % 2 AS file, l_partkey % 3 AS s, md5(CAST(l_partkey % 4 AS VARCHAR)) AS h, l_linenumber % 2 = 0 AS req, CAST(l_linenumber AS VARCHAR) AS p, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 4 END AS gd FROM lineitem),
a AS (SELECT c, file, s, h, arg_min(struct_pack(role := role, pr := pr), (pr, coalesce(gd, 1048576), role)) AS b, bool_or(req) AS req, list(p) AS p, min(gd) AS gd FROM i GROUP BY ALL),
d AS (SELECT c, b.role AS role, h, arg_min(struct_pack(file := file, s := s), (b.pr, coalesce(gd, 1048576), file, s)) AS b, bool_or(req) AS required, flatten(list(p)) AS p, min(gd) AS graph_distance FROM a GROUP BY ALL)
SELECT c AS context_id, role, h AS content_hash, b.file AS file, b.s AS start_line, required, array_to_string(list_sort(list_distinct(p)), ',') AS provenance, graph_distance FROM d
""")
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as candidates of a context with few files, spans and contents."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (n % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("context_id"), pick("API_CHANGE", "CALL_SITE", "CALLER").alias("role"), pick(1, 2, 6).alias("priority"), F.concat(F.lit("f"), F.col("l_suppkey") % 2).alias("file"), (k % 3).alias("start_line"), (k % 3 + 1).alias("end_line"),
        F.md5((k % 4).cast("string")).alias("content_hash"), (n % 2 == 0).alias("required"), F.array(n.cast("string")).alias("provenance_ids"), F.when(k % 5 > 0, k % 4).alias("graph_distance"),
    )
    out, _ = selection.merge(rows)
    return out.select("context_id", "role", "content_hash", "file", "start_line", "required", F.array_join("provenance_ids", ",").alias("provenance"), "graph_distance")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 > 0 AS field, o_orderkey % 13 > 0 AS known FROM orders)
SELECT k, array_to_string(list_filter([CASE WHEN k % 4 = 0 THEN 'CHANGE_CERTAINTY' END, CASE WHEN k % 7 = 0 THEN 'URL_STATE' END, CASE WHEN k % 11 = 0 THEN 'REQUEST_STATE' END, CASE WHEN k % 17 = 0 THEN 'IMPACT_CERTAINTY' END, CASE WHEN k % 19 = 0 THEN 'PATH' END, CASE WHEN k % 23 = 0 THEN 'HOST' END,
  CASE WHEN NOT field THEN 'REQUEST_LOCATION' END, CASE WHEN NOT field OR k % 3 = 0 THEN 'FIELD_USED' END, CASE WHEN NOT known THEN 'SUPPORTED' END], lambda x: x IS NOT NULL), ',') AS failed,
  CASE WHEN NOT known THEN 'UNSUPPORTED' WHEN k % 4 > 0 AND k % 7 > 0 AND k % 11 > 0 AND k % 17 > 0 AND k % 19 > 0 AND k % 23 > 0 AND field AND k % 3 > 0 THEN 'DETERMINISTIC_CANDIDATE' ELSE 'AI_REQUIRED' END AS outcome FROM o""")
def exact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes with their impact and call; each condition fails for some of them."""
    k = F.col("o_orderkey")
    text = lambda c, yes, no: F.when(c, yes).otherwise(no)
    change = F.struct(text(k % 4 == 0, "PARTIAL", "EXACT").alias("certainty"), F.lit("get").alias("method"), F.lit("/v").alias("path"), text(k % 5 > 0, "request.body[json].a", "response.200[json].a").alias("location"), text(k % 13 > 0, edits.SUPPORTED[0], "none").alias("category"))
    call = F.struct(text(k % 7 == 0, "PARTIAL", "EXACT").alias("url_state"), text(k % 11 == 0, "PARTIAL", "EXACT").alias("request_state"), F.lit(None).cast("string").alias("response_state"), F.lit("GET").alias("method"), text(k % 19 == 0, "/w", "/v").alias("path"), F.when(k % 23 > 0, "h").alias("host"), F.array(text(k % 3 == 0, "b", "a")).alias("request_fields"))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), change.alias("change"), F.struct(text(k % 17 == 0, "PARTIAL", "EXACT").alias("certainty")).alias("impact"), call.alias("call"))
    return edits.exact_evidence(rows).select("k", F.array_join("failed", ",").alias("failed"), "outcome")


@query("""WITH i AS (SELECT conv_id, turn, 'f' || turn % 3 AS file, coalesce(text, '') AS content FROM conversations),
e AS (SELECT *, substr(content, CAST(turn % 5 + 1 AS BIGINT), 6) AS part, CASE WHEN turn % 7 = 6 THEN 'x' ELSE file END AS named, turn % 5 = 4 AS stale, turn % 4 = 3 AS gone FROM i),
o AS (SELECT *, CASE WHEN gone THEN chr(1) || 'no such text' ELSE part END AS original FROM e),
t AS (SELECT *, CASE WHEN length(original) = 0 THEN 0 ELSE len(list_filter(range(1, greatest(1, length(content) - length(original) + 1) + 1), lambda p: substr(content, p, length(original)) = original)) END AS times FROM o)
SELECT conv_id AS patch_id, turn AS edit_id, CASE WHEN named = 'x' THEN 'FILE_NOT_ALLOWED' WHEN stale THEN 'STALE_ITEM' WHEN times = 0 THEN 'TEXT_NOT_FOUND' WHEN times > 1 THEN 'TEXT_AMBIGUOUS' END AS code,
  CASE WHEN named <> 'x' AND NOT stale AND times = 1 THEN CAST(instr(content, original) - 1 AS INTEGER) END AS start_offset FROM t""")
def screened_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposed edit of every turn of a conversation, by some characters of it."""
    t = F.col("turn")
    base = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("f"), t % 3).alias("file"), F.coalesce("text", F.lit("")).alias("content"))
    items = base.select(F.col("conv_id").alias("context_id"), "file", F.sha2(F.concat_ws("/", "turn", "content"), 256).alias("content_hash"), "content")
    part = F.substr("content", (t % 5 + 1).cast("int"), F.lit(6))
    proposed = base.select(
        F.col("conv_id").alias("patch_id"), t.alias("edit_id"), F.col("conv_id").alias("context_id"), F.when(t % 7 == 6, "x").otherwise(F.col("file")).alias("file"), F.when(t % 5 == 4, "old").otherwise(F.sha2(F.concat_ws("/", "turn", "content"), 256)).alias("item_hash"),
        F.when(t % 4 == 3, "\x01no such text").otherwise(part).alias("original_text"), F.lit("y").alias("replacement"),
    )
    return edits.screen(proposed, items).select("patch_id", "edit_id", "code", "start_offset")


@query("SELECT 'equal' AS frozen, n_nationkey FROM nation")
def seal_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations under a seal of their own digest, and under one of another table, which stays shut."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    current = verified.root(verified.merkle(nation, "n_nationkey")).select("content_sha256")
    other = verified.root(verified.merkle(region, "r_regionkey")).select("content_sha256")
    rows = lambda frozen, name: audit.opened(nation, current, frozen).select(F.lit(name).alias("frozen"), "n_nationkey")
    return rows(current, "equal").unionByName(rows(other, "other"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY path, method, category, location, change_id) - 1 AS BIGINT) AS place, change_id FROM ({SQL['contract_diff']})")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each change in the report."""
    order = [F.col(c) for c in ("path", "method", "category", "location", "change_id")]
    return numbered(contract_diff(spark, sf_dir), order).select("place", "change_id")
