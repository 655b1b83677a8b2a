"""Ranked predictions and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("p_at_5", "r_at_5", "p_at_10", "r_at_10", "mrr", "ndcg_at_5", "ndcg_at_10")


def ranked(scored: DataFrame, group: Sequence[str] = ("group_id",), ties: Sequence[str] = ("symbol_id", "row_id")) -> DataFrame:
    """Rank within the group by falling score, then ties."""
    w = Window.partitionBy(*group).orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(w))


def group_metrics(rows: DataFrame, group: Sequence[str] = ("group_id",), cuts: Sequence[int] = (5, 10)) -> DataFrame:
    """Precision, recall, reciprocal rank and NDCG of each group; groups without positives have 0 but for size."""
    y, rank = F.col("label").cast("double"), F.col("rank")
    gain = lambda k: F.sum(F.when(rank <= k, y / F.log2(rank + 1)).otherwise(0.0))
    sums = [F.count("*").alias("n"), F.sum(y).cast("int").alias("positives"), F.min(F.when(y == 1, rank)).alias("first")]
    sums += [F.sum(F.when(rank <= k, y).otherwise(0.0)).alias(f"hits_{k}") for k in cuts] + [gain(k).alias(f"dcg_{k}") for k in cuts]
    g = rows.groupBy(*group).agg(*sums)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("positives")))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    some = F.col("positives") > 0
    out = []
    for k in cuts:
        out += [(F.col(f"hits_{k}") / F.least(F.lit(k), F.col("n"))).alias(f"p_at_{k}"), F.when(some, F.col(f"hits_{k}") / F.col("positives")).otherwise(0.0).alias(f"r_at_{k}"), F.when(some, F.col(f"dcg_{k}") / ideal(k)).otherwise(0.0).alias(f"ndcg_at_{k}")]
    return g.select(*group, "n", "positives", *out, F.when(some, 1.0 / F.col("first")).otherwise(0.0).alias("mrr"))


def mean_metrics(groups: DataFrame, *by: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Plain means over groups, and their number."""
    return groups.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("groups"))


def group_report(rows: DataFrame, group: Sequence[str] = ("group_id",), item: str = "symbol_id") -> DataFrame:
    """Per group its metrics and the five first items."""
    top = rows.filter("rank <= 5").groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("top_5"))
    return group_metrics(rows, group).select(*group, F.col("n").alias("candidates"), "positives", "r_at_5", "mrr", "ndcg_at_5").join(top, [*group])


def slice_metrics(scored: DataFrame, field: str, group: str = "group_id", least_groups: int = 2, ties: Sequence[str] = ("symbol_id", "row_id")) -> DataFrame:
    """Metrics per value of a field, ranked anew within it; supported says whether enough groups stand behind them."""
    g = group_metrics(ranked(scored, [field, group], ties), [field, group])
    return mean_metrics(g, field).withColumn("supported", F.col("groups") >= least_groups)


def rank_diagnostics(rows: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """(truth_class, rows, top_5_rate, top_10_rate, mean_rank) of rows of each class; classes may overlap."""
    long = rows.select("rank", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in classes.items()]))).alias("truth_class"))
    rate = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return long.groupBy("truth_class").agg(F.count("*").alias("rows"), rate(5).alias("top_5_rate"), rate(10).alias("top_10_rate"), F.avg("rank").alias("mean_rank"))



def truth_classes() -> dict[str, Column]:
    return {"DIRECT": F.col("truth_type") == "DIRECT", "INDIRECT": F.col("truth_type") == "INDIRECT", "HARD_POSITIVE": F.col("hard_positive"), "HARD_NEGATIVE": F.col("hard_negative")}


def recall_by_distance(rows: DataFrame, k: int = 5) -> DataFrame:
    """Recall of positives in buckets of graph distance 0, 1, 2 and 3+."""
    bucket = F.when(F.col("distance") < 3, F.col("distance").cast("string")).otherwise("3+")
    return rows.filter("label = 1").groupBy(bucket.alias("distance_bucket")).agg(F.count("*").alias("positives"), F.avg((F.col("rank") <= k).cast("double")).alias("recall"))


def long_metrics(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select(*keys, "x.metric", "x.value")


def gap(validation: DataFrame, test: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Test minus validation for each metric."""
    a, b = long_metrics(validation, keys, names), long_metrics(test, keys, names).withColumnRenamed("value", "test")
    return a.join(b, [*keys, "metric"]).select(*keys, "metric", F.col("value").alias("validation"), "test", (F.col("test") - F.col("value")).alias("gap"))


def unseen(rows: DataFrame, field: str, partition: str = "split_partition", seen: str = "TRAIN", fresh: str = "TEST") -> DataFrame:
    """Values of field in one partition that another lacks."""
    return rows.filter(F.col(partition) == fresh).select(field).subtract(rows.filter(F.col(partition) == seen).select(field))


def comparison(long: DataFrame, names: Sequence[str], experiment: str = "experiment_id") -> DataFrame:
    """One row an experiment, one column a metric."""
    return long.groupBy(experiment).pivot("metric", list(names)).agg(F.first("value"))
