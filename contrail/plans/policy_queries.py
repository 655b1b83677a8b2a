"""More registered queries: policies and abstention, thresholds and ranks, neighbours in graphs, gates on evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, calibration, evidence, graph, ranking, routing
from .queries import _EDGES, _G, _L, _R, _S, _contexts, _labelled, _order_edges, _rounded, _strategies, query, table

_CHOSEN = f"""{_S}, c AS (SELECT o_orderkey AS k, o_orderkey % 29 = 0 AS none, CASE WHEN o_orderkey % 3 = 0 THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS rep, o_orderkey % 4 <> 1 AS has FROM orders),
o AS (SELECT k, none, CASE WHEN none THEN ['NO_AI'] WHEN has AND rep <> 'UNSUPPORTED' THEN ['DETERMINISTIC', 'SMALL', 'MEDIUM', 'STRONG'] ELSE ['SMALL', 'MEDIUM', 'STRONG'] END AS options FROM c),
z AS (SELECT g AS k, strategy, CAST((g * 13 + i * 7) % 23 - 15 AS DOUBLE) AS score FROM s WHERE i > 0),
b AS (SELECT o.k, any_value(none) AS none, any_value(len(options)) AS n, arg_max(strategy, (score, strategy)) FILTER (list_contains(options, strategy) AND score >= 0) AS best FROM o LEFT JOIN z USING (k) GROUP BY o.k),
a AS (SELECT k, CASE WHEN none THEN 'NO_AI' ELSE coalesce(best, 'NO_FEASIBLE_STRATEGY') END AS chosen, CASE WHEN none OR best IS NOT NULL THEN NULL WHEN n = 0 THEN 'STRUCTURAL_NO_FEASIBLE' ELSE 'LEARNED_ABSTENTION' END AS code FROM b)"""


@query(f"""WITH {_S}, t AS (SELECT g, strategy, CASE WHEN g % 31 = 0 AND i = 4 THEN 'TEST' ELSE 'TRAIN' END AS part, CASE WHEN g % 37 = 0 THEN strategy ELSE 'SMALL' END AS pref FROM s WHERE NOT (g % 41 = 0 AND i = 2)),
u AS (SELECT g, count(*) AS n, count(DISTINCT strategy) AS d, count(DISTINCT part) AS p, count(DISTINCT pref) AS q FROM t GROUP BY g)
SELECT g AS decision_group_id, 'STRATEGIES' AS code FROM u WHERE n <> 5 OR d <> 5 UNION ALL SELECT g, 'PARTITIONS' FROM u WHERE p <> 1 UNION ALL SELECT g, 'PREFERENCES' FROM u WHERE q > 1""")
def incomplete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 over the strategies of all orders, with gaps by arithmetic."""
    k, i = F.col("decision_group_id"), routing.tie_rank(F.col("strategy")) - 1
    rows = _strategies(spark, sf_dir).filter(~((k % 41 == 0) & (i == 2)))
    rows = rows.withColumn("partition", F.when((k % 31 == 0) & (i == 4), "TEST").otherwise("TRAIN")).withColumn("preferred_strategy", F.when(k % 37 == 0, F.col("strategy")).otherwise("SMALL"))
    return routing.incomplete_groups(rows)


@query(f"WITH {_S} SELECT strategy, outcome, count(*) AS n FROM s WHERE i > 0 AND outcome IN ('SUCCESS', 'FAILURE') GROUP BY ALL")
def known_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    return routing.training_rows(_strategies(spark, sf_dir)).groupBy("strategy", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_CHOSEN} SELECT k AS decision_group_id, array_to_string(options, ',') AS options FROM o")
def applicable_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    return _contexts(spark, sf_dir).select("decision_group_id", F.array_join(routing.applicable(), ",").alias("options"))


@query("""SELECT o_orderkey AS decision_group_id, CASE WHEN o_orderkey % 29 = 0 THEN 'NO_AI'
  ELSE ['DETERMINISTIC', 'SMALL', 'MEDIUM', 'STRONG'][CAST(('0x' || substr(md5('7:' || o_orderkey), 1, 8)) AS BIGINT) % 4 + 1] END AS chosen FROM orders""")
def random_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    return _contexts(spark, sf_dir).select("decision_group_id", routing.random_choice(7)().alias("chosen"))


def _abstained(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = _contexts(spark, sf_dir).withColumn("context_id", F.col("decision_group_id"))
    k, i = F.col("decision_group_id"), routing.tie_rank(F.col("strategy")) - 1
    scores = _strategies(spark, sf_dir).filter(i > 0).select(k.alias("context_id"), "strategy", ((k * 13 + i * 7) % 23 - 15).cast("double").alias("score"))
    return routing.abstaining(contexts, scores).withColumnRenamed("context_id", "decision_group_id")


@query(f"WITH {_CHOSEN} SELECT k AS decision_group_id, chosen, code FROM a")
def learned_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    return _abstained(spark, sf_dir)


@query(f"""WITH {_CHOSEN}, j AS (SELECT chosen = 'NO_FEASIBLE_STRATEGY' AS said, preferred = 'NO_FEASIBLE_STRATEGY' AS no, coalesce(code = 'LEARNED_ABSTENTION', false) AS learned, coalesce(code = 'STRUCTURAL_NO_FEASIBLE', false) AS st FROM a JOIN w ON a.k = w.g)
SELECT round(count(*) FILTER (said AND no) / nullif(count(*) FILTER (said), 0), 6) AS precision, round(count(*) FILTER (said AND no) / nullif(count(*) FILTER (no), 0), 6) AS recall,
  count(*) FILTER (learned AND no) AS right_abstentions, count(*) FILTER (learned AND NOT no) AS false_abstentions, count(*) FILTER (st) AS structural FROM j""")
def abstention_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16 over the decisions of P11."""
    judged = routing.evaluated(_abstained(spark, sf_dir), _strategies(spark, sf_dir))
    return _rounded(routing.abstention_metrics(judged), "precision", "recall")


@query(f"WITH {_R} SELECT 'rules' AS policy, chosen, count(*) AS n, count(DISTINCT k) AS contexts FROM e GROUP BY ALL UNION ALL SELECT 'always', CASE WHEN k % 29 = 0 THEN 'NO_AI' ELSE 'MEDIUM' END, count(*), count(*) FROM c GROUP BY ALL")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision table of two policies, by choice."""
    rows = routing.decisions(_contexts(spark, sf_dir), {"rules": routing.rules()["chosen"], "always": routing.always("MEDIUM")()})
    return rows.groupBy("policy", "chosen").agg(F.count("*").alias("n"), F.count_distinct("decision_id").alias("contexts"))


@query(f"""WITH {_L}, c AS (SELECT count(*) FILTER (score >= 0.4 AND label = 1) AS tp, count(*) FILTER (score >= 0.4 AND label <> 1) AS fp, count(*) FILTER (score < 0.4 AND label = 1) AS fn FROM l)
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L11."""
    return _rounded(calibration.threshold_metrics(_labelled(spark, sf_dir), 0.4), "precision", "recall", "f1")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_quantity AS DOUBLE) / 49 - l_discount > 1 OR CAST(l_quantity AS DOUBLE) / 49 - l_discount < 0")
def bad_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L17."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") / 49 - F.col("l_discount")).alias("score"))
    return calibration.bad_probabilities(rows).select("l_orderkey", "l_linenumber")


_K = f"{_L}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, doc_id) AS r FROM l)"


@query(f"""WITH {_K}, x AS (SELECT r, unnest(list_filter([CASE WHEN label = 1 AND distance = 0 THEN 'DIRECT' END, CASE WHEN label = 1 AND distance > 0 THEN 'INDIRECT' END, CASE WHEN label = 1 AND doc_id % 7 = 0 THEN 'HARD_POSITIVE' END, CASE WHEN label = 0 AND score >= 0.5 THEN 'HARD_NEGATIVE' END], lambda v: v IS NOT NULL)) AS truth_class FROM k)
SELECT truth_class, count(*) AS rows, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS top_5_rate, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS top_10_rate, round(avg(r), 6) AS mean_rank FROM x GROUP BY ALL""")
def rank_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L23."""
    y = F.col("label") == 1
    rows = ranking.ranked(_labelled(spark, sf_dir)).withColumn("truth_type", F.when(y & (F.col("distance") == 0), "DIRECT").when(y, "INDIRECT"))
    rows = rows.withColumn("hard_positive", y & (F.col("row_id") % 7 == 0)).withColumn("hard_negative", ~y & (F.col("score") >= 0.5))
    return _rounded(ranking.rank_diagnostics(rows, ranking.truth_classes()), "top_5_rate", "top_10_rate", "mean_rank")


_HALVES = f"WITH {_L.replace('AS distance FROM', 'AS distance, doc_id % 2 AS half FROM')}, {_G.format(keys='half, group_id')}, h AS (SELECT half, avg(mrr) AS mrr, avg(r_at_5) AS r_at_5 FROM m GROUP BY half)"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("half", F.col("row_id") % 2)
    groups = ranking.group_metrics(ranking.ranked(rows, ["half", "group_id"]), ["half", "group_id"])
    return ranking.mean_metrics(groups, "half").withColumn("experiment_id", F.lit("by_length"))


@query(f"{_HALVES} SELECT 'by_length' AS experiment_id, n AS metric, round(v[1], 6) AS validation, round(v[2], 6) AS test, round(v[2] - v[1], 6) AS gap FROM (SELECT unnest(['mrr', 'r_at_5']) AS n, unnest([[a.mrr, b.mrr], [a.r_at_5, b.r_at_5]]) AS v FROM h a, h b WHERE a.half = 0 AND b.half = 1)")
def metric_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L25."""
    h = _halves(spark, sf_dir)
    return _rounded(ranking.gap(h.filter("half = 0"), h.filter("half = 1"), ["experiment_id"], ["mrr", "r_at_5"]), "validation", "test", "gap")


@query("WITH f AS (SELECT p_partkey, p_type || '/' || p_size AS family FROM part) SELECT family FROM f WHERE p_partkey % 5 = 0 EXCEPT SELECT family FROM f WHERE p_partkey % 5 > 1")
def unseen_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L26."""
    part = F.when(F.col("p_partkey") % 5 == 0, "TEST").when(F.col("p_partkey") % 5 > 1, "TRAIN").otherwise("VALIDATION")
    rows = table(spark, sf_dir, "part").withColumns({"split_partition": part, "family": F.concat_ws("/", "p_type", "p_size")})
    return ranking.unseen(rows, "family")


@query(f"{_HALVES} SELECT CAST(half AS VARCHAR) AS experiment_id, round(mrr, 6) AS mrr, round(r_at_5, 6) AS r_at_5 FROM h")
def experiment_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L27."""
    h = _halves(spark, sf_dir).withColumn("experiment_id", F.col("half").cast("string"))
    return _rounded(ranking.comparison(ranking.long_metrics(h, ["experiment_id"], ["mrr", "r_at_5"]), ["mrr", "r_at_5"]), "mrr", "r_at_5")


@query(f"WITH e AS (SELECT * FROM ({_EDGES}) WHERE callee IS NOT NULL), s AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 7) SELECT 'callers' AS side, caller AS symbol_id FROM e JOIN s ON callee = k UNION SELECT 'callees', callee FROM e JOIN s ON caller = k")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: callers and callees of the customers of a nation."""
    customer = table(spark, sf_dir, "customer")
    symbols, of, edges = customer.select(F.col("c_custkey").alias("symbol_id")), customer.filter("c_nationkey = 7").select(F.col("c_custkey").alias("symbol_id")), _order_edges(spark, sf_dir)
    up, down = graph.callers(edges, symbols, of), graph.callees(edges, symbols, of)
    return up.select(F.lit("callers").alias("side"), "symbol_id").unionByName(down.select(F.lit("callees").alias("side"), "symbol_id"))


@query("SELECT c_custkey AS symbol_id, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 4 > 0, c_custkey % 4, c_custkey) AS INTEGER) AS priority FROM customer QUALIFY priority <= 20")
def impact_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 first symbols of each nation, a report."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol_id"), "c_nationkey", (F.col("c_custkey") % 4).alias("distance"))
    return graph.in_priority(rows, "c_nationkey", k=20).select("symbol_id", "c_nationkey", "priority")


@query("""WITH v AS (SELECT o_orderkey AS k, o_orderkey % 3 > 0 AS told, o_orderkey % 5 AS c, o_orderkey % 4 AS p, o_orderkey % 2 AS f FROM orders)
SELECT CAST(k AS VARCHAR) AS patch_id, told AND c > 0 AND p > 0 AND f = 0 AND c = p + f AS may_apply, array_to_string(list_filter(CASE WHEN NOT told THEN ['EVIDENCE', 'CHECKSUM_PRESENT', 'CHECKSUM', 'STATUS', 'APPLIED', 'SYNTAX', 'COLLECTED', 'PASSED', 'FAILED', 'ERRORS', 'COUNTS', 'EXIT', 'TIMEOUT', 'WORKSPACE']
  ELSE [CASE WHEN c = 0 THEN 'COLLECTED' END, CASE WHEN p = 0 THEN 'PASSED' END, CASE WHEN f > 0 THEN 'FAILED' END, CASE WHEN c <> p + f THEN 'COUNTS' END] END, lambda x: x IS NOT NULL), ',') AS failed FROM v""")
def apply_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 over the orders as patches."""
    k, yes = F.col("o_orderkey"), F.lit(True)
    plans = table(spark, sf_dir, "orders").select(k.cast("string").alias("patch_id"), F.md5(k.cast("string")).alias("patch_checksum"), k.alias("k"))
    found = plans.filter("k % 3 > 0").select(
        "patch_id", "patch_checksum", F.lit("TESTS_PASSED").alias("status"), yes.alias("patch_applied"), yes.alias("syntax_ok"), (F.col("k") % 5).alias("tests_collected"), (F.col("k") % 4).alias("tests_passed"), (F.col("k") % 2).alias("tests_failed"),
        F.lit(0).alias("tests_errors"), F.lit(0).alias("exit_code"), F.lit(False).alias("timeout"), yes.alias("workspace_created"), yes.alias("workspace_cleaned"),
    )
    return evidence.apply_gate(plans.drop("k"), found).withColumn("failed", F.array_join("failed", ","))


_THRESHOLDS = ", ".join(f"{x!r}::DOUBLE" for x in bootstrap.POISSON)


@query(f"""WITH {_L}, {_G.format(keys='group_id')}, d AS (SELECT m.*, t.r AS resample, ((('0x' || substr(md5('11:' || t.r || ':' || group_id), 1, 13))::BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM m, range(1, 1001) t(r)),
w AS (SELECT *, CAST(len(list_filter([{_THRESHOLDS}], lambda x: u > x)) AS DOUBLE) AS w FROM d),
x AS (SELECT resample, metric, CASE WHEN sum(w) > 0 THEN sum(w * value) / sum(w) END AS v FROM (UNPIVOT (SELECT resample, w, {", ".join(ranking.METRICS)} FROM w) ON {", ".join(ranking.METRICS)} INTO NAME metric VALUE value) GROUP BY ALL),
p AS (SELECT metric, avg(value) AS point FROM (UNPIVOT (SELECT {", ".join(ranking.METRICS)} FROM m) ON {", ".join(ranking.METRICS)} INTO NAME metric VALUE value) GROUP BY ALL)
SELECT metric, round(any_value(point), 6) AS point, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM x JOIN p USING (metric) GROUP BY metric""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 resamples of the groups."""
    groups = ranking.group_metrics(ranking.ranked(_labelled(spark, sf_dir)))
    return _rounded(bootstrap.intervals(groups, "group_id", {m: bootstrap.weighted_mean(m) for m in ranking.METRICS}, resamples=1000, seed=11), "point", "low", "high")


@query(f"""WITH {_S}, {_R}, p AS (SELECT 'rules' AS policy, k AS g, chosen FROM e UNION ALL SELECT 'strong', k, CASE WHEN k % 29 = 0 THEN 'NO_AI' ELSE 'STRONG' END FROM c),
j AS (SELECT p.policy, p.g, f.cost, CASE WHEN CASE WHEN p.chosen = 'NO_FEASIBLE_STRATEGY' THEN w.preferred = p.chosen ELSE coalesce(f.ok, false) END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM p JOIN w USING (g) LEFT JOIN f ON f.g = p.g AND f.strategy = p.chosen),
n AS (SELECT j.*, t.r AS resample, ((('0x' || substr(md5('5:' || t.r || ':' || g), 1, 13))::BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM j, range(1, 101) t(r)),
x AS (SELECT policy, resample, sum(w * ok) / sum(w) AS satisfied, sum(w * coalesce(cost, 0)) / nullif(sum(w * ok), 0) AS cost_per_success FROM (SELECT *, CAST(len(list_filter([{_THRESHOLDS}], lambda x: u > x)) AS DOUBLE) AS w FROM n) GROUP BY ALL),
y AS (SELECT policy, sum(ok) / count(*) AS satisfied, sum(coalesce(cost, 0)) / sum(ok) AS cost_per_success FROM j GROUP BY ALL),
l AS (SELECT policy, unnest(['satisfied', 'cost_per_success']) AS metric, unnest([satisfied, cost_per_success]) AS v FROM x), q AS (SELECT policy, unnest(['satisfied', 'cost_per_success']) AS metric, unnest([satisfied, cost_per_success]) AS point FROM y)
SELECT policy, metric, round(any_value(point), 6) AS point, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM l JOIN q USING (policy, metric) GROUP BY ALL""")
def policy_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 resamples of the decision groups under each policy, ratios of sums among the metrics."""
    chosen = routing.decisions(_contexts(spark, sf_dir), {"rules": routing.rules()["chosen"], "strong": routing.always("STRONG")()})
    rows = routing.evaluated(chosen, _strategies(spark, sf_dir)).select("policy", "decision_group_id", F.coalesce("objective_satisfied", F.lit(False)).cast("double").alias("ok"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    w = F.col("w")
    metrics = {"satisfied": bootstrap.weighted_mean("ok"), "cost_per_success": F.try_divide(F.sum(w * F.col("cost")), F.sum(w * F.col("ok")))}
    return _rounded(bootstrap.intervals(rows, "decision_group_id", metrics, ["policy"], resamples=100, seed=5), "point", "low", "high")
