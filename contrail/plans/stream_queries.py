"""Registered queries over streams: every one is fed in three slices, with its query stopped and started between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..storage import shared_dir, written
from ..streaming import feedback as streams
from .queries import _A, _attempts, _page_calls, _page_changes, query, table, template_match_sql

SLICES = 3


def in_slices(rows: DataFrame, slice_of: Column, make: Callable[[DataFrame], DataFrame], sink: Callable | None = None, read: Callable | None = None) -> DataFrame | str:
    """What make(stream of rows) appends when rows come slice by slice; each slice is a run of its own on one checkpoint.

    sink(folder) gives the function for foreachBatch, read(spark, folder) the stream, where the plain ones do not do.
    """
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    numbered = rows.withColumn("_slice", slice_of.cast("int"))
    out = None
    for k in range(SLICES):
        fresh = numbered.filter(F.col("_slice") == k).drop("_slice")
        (fresh.select("value").write.mode("append").text if read else fresh.write.mode("append").parquet)(f"{at}/in")
        stream = read(spark, f"{at}/in") if read else spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        out = make(stream)
        run = out.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        run.foreachBatch((sink or (lambda a: streams.per_batch(f"{a}/out")))(at)).start().awaitTermination()
    return at if sink else spark.read.schema(out.schema).parquet(f"{at}/out").select(out.columns)


def _late_third(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Events by thirds of the month; every seventh event comes one slice late."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("strategy"), F.when(F.col("event_type") == "purchase", "ACCEPTED").otherwise("REJECTED").alias("user_action"))
    third = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))
    return rows, F.least(F.lit(2), third + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))


_LATE = """e AS (SELECT event_id, ts, event_type, CAST(least(2, least(2, (day(ts) - 1) // 10) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS slice FROM events),
k AS (SELECT s AS slice, (SELECT max(ts) FROM e WHERE e.slice < s) - INTERVAL 6 HOUR AS mark FROM range(4) t(s))"""


@query(f"""WITH {_LATE},
w AS (SELECT e.*, date_trunc('hour', ts) - to_hours(hour(ts) % 12) - to_hours(12 * i) AS start FROM e, range(2) t(i)),
g AS (SELECT w.* FROM w JOIN k USING (slice) WHERE mark IS NULL OR start + INTERVAL 24 HOUR > date_trunc('millisecond', mark))
SELECT start, event_type AS strategy, count(*) AS records, count(*) FILTER (event_type = 'purchase') AS accepted FROM g
WHERE start + INTERVAL 24 HOUR <= (SELECT date_trunc('millisecond', mark) FROM k WHERE slice = 3) GROUP BY ALL""")
def acceptance_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that begin every twelve hours, in append mode: rows of windows behind the watermark are dropped, windows ahead of it wait."""
    rows, slices = _late_third(spark, sf_dir)
    out = in_slices(rows, slices, lambda s: streams.acceptance(s, "24 hours", "12 hours", "6 hours"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "strategy", "records", "accepted")


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT CAST(user_id AS VARCHAR) AS user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS "end", count(*) AS records FROM n GROUP BY user_id, session
HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT date_trunc('millisecond', max(ts) - INTERVAL 1 HOUR) FROM events)""")
def feedback_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with pauses of eight hours, in append mode; the last ones are still open."""
    rows, _ = _late_third(spark, sf_dir)
    out = in_slices(rows, F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10)), lambda s: streams.sessions(s, "8 hours", "1 hour", "user_id"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "records")


@query("SELECT event_id, event_type AS strategy FROM events")
def feedback_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, a third of them in another slice than before."""
    rows, slices = _late_third(spark, sf_dir)
    rows = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return in_slices(rows, F.least(F.lit(2), slices + F.when(F.col("event_id") % 3 == 0, F.col("copy")).otherwise(0)), lambda s: streams.once(s, "event_id", "60 days")).select("event_id", "strategy")


@query("""SELECT CASE WHEN event_id % 50 = 0 THEN 'malformed' ELSE 'row' END AS kind, CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 50 > 0 THEN event_type END AS user_action FROM events""")
def feedback_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, every fiftieth cut short; rows and malformed lines each to a table, batch by batch."""
    schema = "record_id string, user_action string, ts timestamp"
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("record_id"), F.col("event_type").alias("user_action"), "ts"))
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.when(k % 50 == 0, F.concat(F.lit("{cut "), k)).otherwise(line).alias("value"), k)
    sink = lambda at: streams.split_malformed(f"{at}/good", f"{at}/bad")
    at = in_slices(rows, k % 3, lambda s: s, sink, lambda spark, path: streams.read_lines(spark, path, schema))
    good = spark.read.schema(schema).parquet(f"{at}/good").select(F.lit("row").alias("kind"), "record_id", "user_action")
    bad = spark.read.schema("value string").parquet(f"{at}/bad").select(F.lit("malformed").alias("kind"), F.substring("value", 6, 20).alias("record_id"), F.lit(None).cast("string").alias("user_action"))
    return good.unionByName(bad)


@query(f"WITH {_A} SELECT patch_id, attempt_number, action, CASE WHEN action = 'RETRY_WITH_MORE_CONTEXT' THEN 16000 ELSE 8000 END AS next_budget FROM c")
def retry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: attempts as they come; E6's SQL."""
    streams.keep_state_on_disk(spark)
    rows = _attempts(spark, sf_dir, more=("ts",))
    third = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))
    out = in_slices(rows.withColumn("ts", F.col("ts").cast("timestamp")), third, lambda s: streams.retry_actions(s, idle=timedelta(days=60)))
    return out.select("patch_id", "attempt_number", "action", "next_budget")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
p AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT CAST(user_id AS VARCHAR) AS log_id, CAST(i AS INTEGER) AS event_index, 'DIGEST' AS code FROM p WHERE event_id % 101 = 0
UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(i + 1 AS INTEGER), 'CHAIN' FROM p WHERE event_id % 101 = 0 AND i + 1 < n
""")
def chain_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the events of every user as a log; some hashes are wrong."""
    from pyspark.sql import Window

    streams.keep_state_on_disk(spark)
    w = Window.partitionBy("user_id").orderBy("event_id")
    own = F.sha2(F.concat_ws("/", "user_id", "event_id", "event_type"), 256)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", (F.row_number().over(w) - 1).alias("event_index"), own.alias("own"))
    rows = rows.withColumn("previous_event_hash", F.lag("own", 1, audit.ZERO).over(w)).withColumn("event_hash", F.when(F.col("event_id") % 101 == 0, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("own")))
    rows = written(rows.withColumn("log_id", F.col("user_id").cast("string")), "logs")  # logs are sorted once, not for each slice
    return in_slices(rows, F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10)), lambda s: streams.chain_violations(s, F.col("own")))


@query(template_match_sql())
def new_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as calls that arrive, against all current templates."""
    changes = _page_changes(spark, sf_dir)
    out = in_slices(_page_calls(spark, sf_dir), F.col("call_id").cast("long") % 3, lambda s: streams.new_impacts(s, changes))
    return out.select("change_id", "call_id", "score")
