"""Validation evidence, retries, feedback, overview."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import last_count, redacted

RETRYABLE = ("TESTS_FAILED", "SYNTAX_ERROR", "PATCH_FAILED", "TIMEOUT")
LADDER = ("SMALL", "MEDIUM", "STRONG")


def validation_status() -> Column:
    """From raw run facts."""
    c = lambda k: F.coalesce(F.col(k), F.lit(0))
    return (
        F.when(F.col("timeout"), "TIMEOUT").when(~F.coalesce("patch_applied", F.lit(False)), "PATCH_FAILED").when(~F.coalesce("syntax_ok", F.lit(False)), "SYNTAX_ERROR")
        .when((c("exit_code") != 0) & (c("tests_passed") == 0) & (c("tests_failed") == 0), "RUNNER_ERROR").when(c("tests_passed") + c("tests_failed") + c("tests_errors") == 0, "NO_TESTS_COLLECTED")
        .when((c("tests_failed") > 0) | (c("tests_errors") > 0), "TESTS_FAILED").otherwise("TESTS_PASSED")
    )


def inconsistent(runs: DataFrame) -> DataFrame:
    """Runs whose counts do not add up."""
    total = sum(F.coalesce(c, F.lit(0)) for c in ("tests_passed", "tests_failed", "tests_errors"))
    return runs.filter(F.col("tests_collected").isNotNull() & (F.col("tests_collected") != total))


def test_counts(logs: DataFrame, log: str = "log") -> DataFrame:
    """Logs with the last counts they tell and a redacted tail."""
    return logs.withColumns({"tests_passed": last_count(F.col(log), "passed"), "tests_failed": last_count(F.col(log), "failed"), "tests_errors": last_count(F.col(log), "errors?"), "tail": redacted(F.col(log))})


def apply_gate(plans: DataFrame, validations: DataFrame) -> DataFrame:
    """(patch_id, may_apply, failed[]): a patch needs complete passing evidence of its own checksum."""
    v = validations.select("patch_id", F.struct(*[c for c in validations.columns if c != "patch_id"]).alias("v"))
    rows = plans.join(v, "patch_id", "left")
    x = lambda k: F.col(f"v.{k}")
    checks = {
        "EVIDENCE": F.col("v").isNotNull(), "CHECKSUM_PRESENT": x("patch_checksum").isNotNull(), "CHECKSUM": x("patch_checksum") == F.col("patch_checksum"), "STATUS": x("status") == "TESTS_PASSED",
        "APPLIED": x("patch_applied"), "SYNTAX": x("syntax_ok"), "COLLECTED": x("tests_collected") > 0, "PASSED": x("tests_passed") > 0, "FAILED": x("tests_failed") == 0, "ERRORS": x("tests_errors") == 0,
        "COUNTS": x("tests_collected") == x("tests_passed") + x("tests_failed") + x("tests_errors"), "EXIT": x("exit_code") == 0, "TIMEOUT": ~x("timeout"), "WORKSPACE": x("workspace_created") & x("workspace_cleaned"),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in checks.items()]))
    return rows.select("patch_id", (F.size(failed) == 0).alias("may_apply"), failed.alias("failed"))


def run_outcomes(plans: DataFrame, validations: DataFrame) -> DataFrame:
    """E5: (patch_id, outcome) in nine ways. plans: patch_id, run_id, generation_status; validations: run_id, patch_id, status."""
    v = validations.select("run_id", F.col("patch_id").alias("_patch"), F.col("status").alias("_status"))
    rows = plans.join(v, "run_id", "left")
    g, s = F.col("generation_status"), F.col("_status")
    out = (
        F.when(g == "NOT_REQUIRED", "NO_REPAIR_NEEDED").when(g == "REFUSED", "REFUSED").when(g == "PROVIDER_ERROR", "PROVIDER_ERROR").when(g == "REJECTED", "REJECTED_OUTPUT")
        .when(s.isNull(), "NOT_VALIDATED").when(~F.col("_patch").eqNullSafe(F.col("patch_id")), "INVALID_EVIDENCE").when(s == "TESTS_PASSED", "SUCCESS")
        .when(s.isin("TESTS_FAILED", "SYNTAX_ERROR", "PATCH_FAILED", "NO_TESTS_COLLECTED"), "FAILURE").otherwise("INFRASTRUCTURE_ERROR")
    )
    return rows.select("run_id", "patch_id", out.alias("outcome"))


@dataclass(frozen=True)
class RetryPolicy:
    max_retries: int = 3
    expand_context: bool = True
    escalate: bool = True
    factor: float = 2.0
    budget: int = 16_000


RETRY = RetryPolicy()


def next_strategy(strategy: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(s) for s in LADDER]), strategy)
    return F.when((at > 0) & (at < len(LADDER)), F.element_at(F.array(*[F.lit(s) for s in LADDER]), (at + 1).cast("int")))


def next_actions(attempts: DataFrame, policy: RetryPolicy = RETRY, key: str = "patch_id") -> DataFrame:
    """What follows each attempt: the first retryable failure gets more context, later ones a stronger strategy."""
    w = Window.partitionBy(key).orderBy("attempt_number")
    failing = F.col("status").isin(*RETRYABLE)
    before = F.coalesce(F.sum(failing.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = next_strategy(F.col("strategy"))
    action = (
        F.when(F.col("status") == "TESTS_PASSED", "DONE").when(~failing, "AI_REQUIRED").when(F.col("attempt_number") > policy.max_retries, "AI_REQUIRED")
        .when(F.lit(policy.expand_context) & (before == 0), "RETRY_WITH_MORE_CONTEXT").when(F.lit(policy.escalate) & more.isNotNull(), "ESCALATE_TO_STRONGER_STRATEGY").otherwise("AI_REQUIRED")
    )
    rows = attempts.withColumn("action", action)
    return rows.withColumn("next_budget", F.when(F.col("action") == "RETRY_WITH_MORE_CONTEXT", (F.coalesce("budget", F.lit(policy.budget)) * policy.factor).cast("int")).otherwise(F.col("budget"))).withColumn("next_strategy", F.when(F.col("action") == "ESCALATE_TO_STRONGER_STRATEGY", more).when(F.col("action") == "RETRY_WITH_MORE_CONTEXT", F.col("strategy")))


def terminal(actions: DataFrame, key: str = "patch_id") -> DataFrame:
    """(key, attempts, final_status, result) of each patch."""
    last = actions.groupBy(key).agg(F.max("attempt_number").alias("attempts"), F.max_by(F.struct("status", "strategy", "action"), "attempt_number").alias("l"))
    result = F.when(F.col("l.status") == "TESTS_PASSED", "RESOLVED").when(~F.coalesce(F.col("l.strategy").isin(*LADDER), F.lit(False)), "DETERMINISTIC_FALLBACK").otherwise(F.when(F.col("l.action").isin("RETRY_WITH_MORE_CONTEXT", "ESCALATE_TO_STRONGER_STRATEGY"), "OPEN").otherwise("AI_REQUIRED"))
    return last.select(key, "attempts", F.col("l.status").alias("final_status"), result.alias("result"))


def feedback(patches: DataFrame, contexts: DataFrame, routes: DataFrame, validations: DataFrame, actions: DataFrame) -> DataFrame:
    """One provenance row a user action."""
    out = actions
    for df in (patches, contexts, routes, validations):
        out = out.join(df, "patch_id", "left")
    return out


def impact_overview(impacted: DataFrame, by: str = "repo_id", direct: int = 8, indirect: int = 12) -> DataFrame:
    """Per repository counts and the first direct and indirect symbols."""
    w = Window.partitionBy(by, "impact_type").orderBy("distance", "symbol_id")
    rows = impacted.withColumn("_n", F.row_number().over(w))
    listed = lambda kind, k: F.array_sort(F.collect_list(F.when((F.col("impact_type") == kind) & (F.col("_n") <= k), F.struct("_n", "symbol_id"))))
    g = rows.groupBy(by).agg(F.count_if(F.expr("impact_type = 'DIRECT'")).alias("direct_count"), F.count_if(F.expr("impact_type = 'INDIRECT'")).alias("indirect_count"), listed("DIRECT", direct).alias("d"), listed("INDIRECT", indirect).alias("i"))
    names = lambda c: F.transform(c, lambda x: x["symbol_id"])
    return g.select(by, "direct_count", "indirect_count", names("d").alias("direct"), names("i").alias("indirect"))
