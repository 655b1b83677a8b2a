"""Choosing a repair strategy and judging policies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stable_id
from ..schemas import STRATEGIES

#: Fixed order for equal strategies; limits of the objective.
TIE_ORDER, MAX_LATENCY, MIN_QUALITY = STRATEGIES, 4.0, 70.0
REPAIR = ("DETERMINISTIC", "SMALL", "MEDIUM", "STRONG")
NO_FEASIBLE = "NO_FEASIBLE_STRATEGY"


def tie_rank(strategy: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in TIE_ORDER]), strategy)


def incomplete_groups(rows: DataFrame) -> DataFrame:
    """(decision_group_id, code) of groups without exactly the five strategies, or with several partitions or preferences."""
    g = rows.groupBy("decision_group_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("strategy")).alias("s"), F.count_distinct("partition").alias("p"), F.count_distinct("preferred_strategy").alias("q"))
    codes = [((F.col("n") != len(STRATEGIES)) | (F.col("s") != F.array_sort(F.array(*[F.lit(x) for x in STRATEGIES]))), "STRATEGIES"), (F.col("p") != 1, "PARTITIONS"), (F.col("q") > 1, "PREFERENCES")]
    return g.select("decision_group_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in codes]))).alias("code"))


def feasible() -> Column:
    return F.coalesce((F.col("outcome") == "SUCCESS") & F.col("cost").isNotNull() & (F.col("latency") <= MAX_LATENCY) & (F.col("quality") >= MIN_QUALITY), F.lit(False))


def preferred(rows: DataFrame, no_repair: str | None = None) -> DataFrame:
    """(decision_group_id, preferred, feasible[]): the cheapest feasible strategy, then latency, quality, fixed order.

    A group without one prefers NO_FEASIBLE_STRATEGY; where the column no_repair holds, NO_AI.
    """
    best = F.min(F.when(feasible(), F.struct("cost", "latency", (-F.col("quality")).alias("q"), tie_rank(F.col("strategy")).alias("o"), "strategy")))
    g = rows.groupBy("decision_group_id").agg(best.alias("b"), F.array_sort(F.collect_set(F.when(feasible(), F.col("strategy")))).alias("feasible"), (F.bool_or(no_repair) if no_repair else F.lit(False)).alias("none"))
    return g.select("decision_group_id", F.when(F.col("none"), "NO_AI").otherwise(F.coalesce("b.strategy", F.lit(NO_FEASIBLE))).alias("preferred"), "feasible")


def training_rows(rows: DataFrame) -> DataFrame:
    """Rows with a known outcome; UNKNOWN and NOT_APPLICABLE are no failures."""
    return rows.filter((F.col("strategy") != "NO_AI") & F.col("outcome").isin("SUCCESS", "FAILURE"))


def linear_scores(contexts: DataFrame, coefficients: DataFrame, intercept: float, numeric: dict[str, tuple[float, float]], categorical: Sequence[str], strategies: Sequence[str] = REPAIR) -> DataFrame:
    """P5: (context_id, strategy, score): scaled features and one-hot values times stored coefficients, plus intercept.

    coefficients (feature, value, coefficient): value is null for numeric features; the feature strategy has one a strategy.
    """
    long = [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("string").alias("value"), ((F.col(c).cast("double") - m) / (s or 1.0)).alias("x")) for c, (m, s) in numeric.items()]
    long += [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"), F.lit(1.0).alias("x")) for c in categorical]
    rows = contexts.select("context_id", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"), F.array(*long).alias("f"))
    rows = rows.select("context_id", "strategy", F.explode(F.array_append("f", F.struct(F.lit("strategy").alias("feature"), F.col("strategy").alias("value"), F.lit(1.0).alias("x")))).alias("e"))
    weights = F.broadcast(coefficients)  # one row a feature value: the size of a model, not of the data
    hit = rows.join(weights, (F.col("e.feature") == weights["feature"]) & F.col("e.value").eqNullSafe(weights["value"]), "left")
    return hit.groupBy("context_id", "strategy").agg((F.sum(F.coalesce(F.col("e.x") * F.col("coefficient"), F.lit(0.0))) + intercept).alias("score"))


def applicable() -> Column:
    """Array of the strategies that apply to a context."""
    has, no = F.col("deterministic_rule_available"), F.col("no_repair_required")
    return F.array_compact(F.array(F.when(no, F.lit("NO_AI")), F.when(~no & has & (F.col("m10_repairability") != "UNSUPPORTED"), F.lit("DETERMINISTIC")), *[F.when(~no, F.lit(s)) for s in REPAIR[1:]]))


def always(strategy: str) -> Callable[[], Column]:
    """P7."""
    return lambda: F.when(F.col("no_repair_required"), "NO_AI").otherwise(strategy)


def random_choice(seed: int, of: Callable[[], Column] | None = None) -> Callable[[], Column]:
    """A seeded uniform choice among four, or among an array column."""

    def choose() -> Column:
        options = of() if of else F.array(*[F.lit(s) for s in REPAIR])
        told = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("decision_group_id").cast("string"))), 1, 8), 16, 10).cast("bigint")
        pick = F.element_at(options, (told % F.size(options) + 1).cast("int"))
        return F.when(F.col("no_repair_required"), "NO_AI").otherwise(pick)

    return choose


def rules() -> Column:
    """struct(chosen, rule) of the ordered rules."""
    c = F.col
    ladder = [
        (c("no_repair_required"), "NO_AI", 1),
        ((c("m10_repairability") == "UNSUPPORTED") & ~c("deterministic_rule_available"), NO_FEASIBLE, 2),
        ((c("m10_repairability") == "SUPPORTED") & c("deterministic_rule_available") & (c("expected_edit_count") <= 1) & (c("repair_conflict_count") == 0) & (c("coverage_unresolved_calls") == 0), "DETERMINISTIC", 3),
        ((c("repair_conflict_count") > 0) | (c("ambiguity_flag_count") >= 2) | (c("maximum_graph_distance") >= 3), "STRONG", 4),
        (c("dynamic_payload") | c("shared_payload_ambiguity") | (c("coverage_unresolved_calls") > 0), "MEDIUM", 5),
    ]
    out = None
    for condition, choice, n in ladder:
        said = F.struct(F.lit(choice).alias("chosen"), F.lit(n).alias("rule"))
        out = F.when(condition, said) if out is None else out.when(condition, said)
    return out.otherwise(F.struct(F.lit("SMALL").alias("chosen"), F.lit(6).alias("rule")))


def best_scores(scores: DataFrame, ties: str = "order") -> DataFrame:
    """P10: (context_id, chosen, score): the highest finite score; ties by the fixed order, or the greatest name."""
    finite = scores.filter(~F.isnan("score") & (F.abs("score") < float("inf")))
    tie = -tie_rank(F.col("strategy")) if ties == "order" else F.col("strategy")
    return finite.groupBy("context_id").agg(F.max_by(F.struct("strategy", "score"), F.struct("score", tie.alias("t"))).alias("b")).select("context_id", F.col("b.strategy").alias("chosen"), F.col("b.score").alias("score"))


def abstaining(contexts: DataFrame, scores: DataFrame) -> DataFrame:
    """(context_id, chosen, code): nothing applies, nothing scores 0 or more, or the best that does."""
    open_ = contexts.select("context_id", "no_repair_required", applicable().alias("options"))
    hit = open_.join(scores.hint("merge"), "context_id", "left").withColumn("ok", F.coalesce(F.array_contains("options", F.col("strategy")) & ~F.isnan("score"), F.lit(False)))
    g = hit.groupBy("context_id").agg(F.first("options").alias("options"), F.bool_or("no_repair_required").alias("none"), F.max_by("strategy", F.when(F.col("ok") & (F.col("score") >= 0), F.struct("score", "strategy"))).alias("best"), F.count_if(F.col("ok") & (F.col("score") >= 0)).alias("n"))
    chosen = F.when(F.col("none"), "NO_AI").when(F.col("n") > 0, F.col("best")).otherwise(NO_FEASIBLE)
    code = F.when(F.col("none") | (F.col("n") > 0), None).when(F.size("options") == 0, "STRUCTURAL_NO_FEASIBLE").otherwise("LEARNED_ABSTENTION")
    return g.select("context_id", chosen.alias("chosen"), code.alias("code"))


def decisions(contexts: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """One row a policy and context, with a stable id and the context's fingerprint."""
    listed = F.array(*[F.struct(F.lit(k).alias("policy"), c.alias("chosen")) for k, c in policies.items()])
    rows = contexts.withColumn("_p", F.explode(listed)).withColumn("context_fingerprint", F.sha2(F.to_json(F.struct(*sorted(contexts.columns))), 256))
    return rows.select(stable_id("decision-", "_p.policy", "decision_group_id", "context_fingerprint").alias("decision_id"), "_p.policy", "decision_group_id", "_p.chosen", "context_fingerprint")


def evaluated(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """Decisions with outcome, cost, latency, objective_satisfied and regret.

    Abstaining is right only where nothing is feasible; regret is the cost over the preferred strategy's, if satisfied.
    Every side has rows for each group, so all joins are merge joins: by the size of the files that groups are derived from,
    Spark would take them for small and send them whole through the driver.
    """
    oracle = preferred(rows).drop("feasible")
    own = rows.select("decision_group_id", F.col("strategy").alias("chosen"), "outcome", "cost", "latency", "quality")
    cheapest = rows.select("decision_group_id", F.col("strategy").alias("preferred"), F.col("cost").alias("oracle_cost"))
    out = chosen.join(oracle.hint("merge"), "decision_group_id", "left").join(own.hint("merge"), ["decision_group_id", "chosen"], "left").join(cheapest.hint("merge"), ["decision_group_id", "preferred"], "left")
    met = F.when(F.col("chosen") == NO_FEASIBLE, F.col("preferred") == NO_FEASIBLE).otherwise(feasible())
    out = out.withColumn("objective_satisfied", met)
    return out.withColumn("regret", F.when(F.col("objective_satisfied"), F.when(F.col("chosen") == NO_FEASIBLE, 0.0).otherwise(F.col("cost") - F.col("oracle_cost"))))


def policy_metrics(judged: DataFrame, *by: str) -> DataFrame:
    """One row a policy."""
    ok, none = F.col("objective_satisfied"), F.col("preferred") == NO_FEASIBLE
    share = lambda c: F.avg(c.cast("double"))
    return judged.groupBy(*by).agg(
        F.count("*").alias("groups"), share(ok).alias("satisfied"), share(~ok).alias("violated"), F.avg("cost").alias("mean_cost"), F.avg("latency").alias("mean_latency"),
        F.try_divide(F.sum(F.coalesce("cost", F.lit(0.0))), F.count_if(ok)).alias("cost_per_success"), share(F.col("chosen") == "STRONG").alias("strong_share"),
        F.try_divide(F.count_if(none & (F.col("chosen") == NO_FEASIBLE)).cast("double"), F.count_if(none)).alias("no_feasible_handled"), F.avg("regret").alias("mean_regret"),
        F.count_if(F.col("outcome") == "UNKNOWN").alias("unknown"), F.count_if(F.col("outcome") == "NOT_APPLICABLE").alias("not_applicable"),
    )


def abstention_metrics(judged: DataFrame, *by: str) -> DataFrame:
    """P16 (judged with code)."""
    said, none, learned = F.col("chosen") == NO_FEASIBLE, F.col("preferred") == NO_FEASIBLE, F.coalesce(F.col("code") == "LEARNED_ABSTENTION", F.lit(False))
    return judged.groupBy(*by).agg(
        F.try_divide(F.count_if(said & none).cast("double"), F.count_if(said)).alias("precision"), F.try_divide(F.count_if(said & none).cast("double"), F.count_if(none)).alias("recall"),
        F.count_if(learned & none).alias("right_abstentions"), F.count_if(learned & ~none).alias("false_abstentions"), F.count_if(F.col("code") == "STRUCTURAL_NO_FEASIBLE").alias("structural"),
    )


def strategy_support(rows: DataFrame, outcomes: Sequence[str] = ("SUCCESS", "FAILURE", "UNKNOWN", "NOT_APPLICABLE")) -> DataFrame:
    """Strategies by outcomes."""
    return rows.groupBy("strategy").pivot("outcome", list(outcomes)).count().na.fill(0)
