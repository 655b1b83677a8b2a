"""Streams of feedback, retries, logs and calls (T1-T6). Each has a batch twin in contrail.operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.evidence import LADDER, RETRY, RETRYABLE, RetryPolicy
from ..operators.match import impacts
from ..schemas import FEEDBACK


def keep_state_on_disk(spark: SparkSession) -> None:
    """The state store that processors of T4 and T5 need; set for the session before their queries start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def per_batch(at: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's rows under its own number. A batch that runs again replaces what it wrote before."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")

    return keep


def read_feedback(spark: SparkSession, path: str, schema: str = FEEDBACK, max_files: int = 100) -> DataFrame:
    """A stream of JSON lines; malformed lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", max_files).json(path)


def read_lines(spark: SparkSession, path: str, schema: str = FEEDBACK, max_files: int = 100) -> DataFrame:
    """A stream of JSON lines as (value, row); row is null where the line is not a JSON object of the schema."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = lines.select("value", parsed.alias("row"))
    bad = F.col("row").isNull() | F.col("row._corrupt_record").isNotNull()
    return lines.select("value", F.when(~bad, F.col("row").dropFields("_corrupt_record")).alias("row"))


def split_malformed(good: str, bad: str) -> Callable[[DataFrame, int], None]:
    """T1, for foreachBatch over read_lines: rows to one table, malformed lines to another, each batch once."""
    rows, lines = per_batch(good), per_batch(bad)

    def keep(batch: DataFrame, number: int) -> None:
        rows(batch.filter("row is not null").select("row.*"), number)
        lines(batch.filter("row is null").select("value"), number)

    return keep


def acceptance(stream: DataFrame, window: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """(start, strategy, records, accepted, rate) in event-time windows; rows later than the watermark are dropped."""
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = stream.withWatermark("ts", lateness).groupBy(frame.alias("w"), "strategy").agg(F.count("*").alias("records"), F.count_if(F.expr("user_action = 'ACCEPTED'")).alias("accepted"))
    return counted.select(F.col("w.start").alias("start"), "strategy", "records", "accepted", (F.col("accepted") / F.col("records")).alias("rate"))


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour", key: str = "patch_id") -> DataFrame:
    """Records of a key without a gap."""
    counted = stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("records"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "records")


def once(stream: DataFrame, key: str = "record_id", lateness: str = "1 hour") -> DataFrame:
    """The first record of each id within the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


RETRY_OUT = "patch_id string, attempt_number int, action string, next_budget int, next_strategy string"


class RetryState(StatefulProcessor):
    """T4: what each patch has been through: its last attempt, budget and strategy, and whether its context was expanded.

    Rows of a trigger are taken in attempt order. A patch without an attempt for idle_ms of event time is given up: its
    timer emits ABANDONED and its state goes, so the state is that of the patches in work.
    """

    def __init__(self, policy: RetryPolicy = RETRY, idle_ms: int | None = None) -> None:
        self.policy, self.idle = policy, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "attempt int, budget int, strategy string, expanded boolean, timer bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        attempt, budget, strategy, expanded, timer = self.seen.get() if self.seen.exists() else (0, None, None, False, 0)
        latest = timer
        for r in sorted(rows, key=lambda r: r["attempt_number"]):
            attempt, budget, strategy = r["attempt_number"], r["budget"], r["strategy"]
            action, more, then = self.decide(r, expanded)
            expanded = expanded or r["status"] in RETRYABLE
            if self.idle is not None:
                latest = max(latest, int(r["ts"].timestamp() * 1000) + self.idle)
            yield Row(patch_id=key[0], attempt_number=attempt, action=action, next_budget=more, next_strategy=then)
        if latest != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest)
        self.seen.update((attempt, budget, strategy, expanded, latest))

    def decide(self, r: Row, expanded: bool) -> tuple[str, int | None, str | None]:
        """(action, next budget, next strategy) after an attempt."""
        if r["status"] == "TESTS_PASSED":
            return "DONE", r["budget"], None
        if r["status"] in RETRYABLE and r["attempt_number"] <= self.policy.max_retries:
            if self.policy.expand_context and not expanded:
                return "RETRY_WITH_MORE_CONTEXT", int((self.policy.budget if r["budget"] is None else r["budget"]) * self.policy.factor), r["strategy"]
            at = LADDER.index(r["strategy"]) if r["strategy"] in LADDER else len(LADDER)
            if self.policy.escalate and at + 1 < len(LADDER):
                return "ESCALATE_TO_STRONGER_STRATEGY", r["budget"], LADDER[at + 1]
        return "AI_REQUIRED", r["budget"], None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        attempt, budget, strategy, _, _ = self.seen.get()
        self.seen.clear()
        yield Row(patch_id=key[0], attempt_number=attempt, action="ABANDONED", next_budget=budget, next_strategy=strategy)

    def close(self) -> None:
        pass


def retry_actions(stream: DataFrame, policy: RetryPolicy = RETRY, idle: timedelta | None = None, lateness: str = "1 hour") -> DataFrame:
    """T4: the next action after each attempt; patches that rest for idle in event time are given up."""
    if idle is None:
        return stream.groupBy("patch_id").transformWithState(RetryState(policy), RETRY_OUT, "Append", "None")
    state = RetryState(policy, int(idle.total_seconds() * 1000))
    return stream.withWatermark("ts", lateness).groupBy("patch_id").transformWithState(state, RETRY_OUT, "Append", "EventTime")


CHAIN_OUT = "log_id string, event_index int, code string"


class ChainState(StatefulProcessor):
    """T5: per log the index and hash of the last event; emits what does not follow. Rows carry their own digest.

    A log that rests for rest_ms of processing time is closed: its state goes, and what comes later starts a chain anew.
    """

    def __init__(self, rest_ms: int | None = None) -> None:
        self.rest = rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n int, hash string", self.rest) if self.rest else handle.getValueState("last", "n int, hash string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, before = self.last.get() if self.last.exists() else (0, "0" * 64)
        for r in sorted(rows, key=lambda r: r["event_index"]):
            for wrong, code in ((r["event_index"] != n, "INDEX"), (r["previous_event_hash"] != before, "CHAIN"), (r["event_hash"] != r["digest"], "DIGEST")):
                if wrong:
                    yield Row(log_id=key[0], event_index=r["event_index"], code=code)
            n, before = n + 1, r["event_hash"]
        self.last.update((n, before))

    def close(self) -> None:
        pass


def chain_violations(stream: DataFrame, digest: Column, rest_ms: int | None = None) -> DataFrame:
    """T5: violations of hash chains as events arrive."""
    rows = stream.select("log_id", "event_index", "previous_event_hash", "event_hash", digest.alias("digest"))
    return rows.groupBy("log_id").transformWithState(ChainState(rest_ms), CHAIN_OUT, "Append", "ProcessingTime" if rest_ms else "None")


def new_impacts(calls: DataFrame, changes: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Impacts of the current changes (a static table) on call sites as they arrive; the stream keeps no state."""
    return impacts(changes, calls, hosts)
