"""Encoders and scorers on MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType, StructType

from ..schemas import STATES

#: The features of the router that may be used.
ROUTER_NUMERIC = ("direct_impact_count", "indirect_exposure_count", "maximum_graph_distance", "direct_caller_count", "upstream_caller_count", "coverage_unresolved_calls", "coverage_failed_files", "supported_rule_count", "expected_edit_count", "target_file_count", "repair_conflict_count", "ambiguity_flag_count")
ROUTER_BOOLEAN = ("direct_reference", "deterministic_rule_available", "shared_payload_ambiguity", "dynamic_payload", "nested_literal")
ROUTER_CATEGORICAL = ("change_category", "change_severity", "change_certainty", "breaking_classification", "compatibility_direction", "url_resolution_state", "request_resolution_state", "response_resolution_state", "m10_outcome", "m10_repairability", "source_shape")


def allowed(rows: DataFrame, columns: Sequence[str], allow: Sequence[str]) -> DataFrame:
    """L1: exactly the columns asked for; one that is not on the allow-list, or missing, is an error."""
    wrong = sorted(set(columns) - set(allow)) + sorted(set(columns) - set(rows.columns))
    if wrong:
        raise ValueError(f"features not allowed or missing: {', '.join(wrong)}")
    return rows.select(*columns)


def usable(rows: DataFrame, withheld: Sequence[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """L1: (numeric, categorical) columns of feature rows by their types, without the withheld ones (ids, labels, truth)."""
    kept = [f for f in rows.schema.fields if f.name not in withheld]
    return tuple(f.name for f in kept if isinstance(f.dataType, NumericType)), tuple(f.name for f in kept if isinstance(f.dataType, StringType | BooleanType))


def flattened(rows: DataFrame) -> DataFrame:
    """L1: rows with a number in place of each list: its length, and for lists of entries with a state one more for each state."""
    out = []
    for f in rows.schema.fields:
        if not isinstance(f.dataType, ArrayType):
            out.append(F.col(f.name))
            continue
        out.append(F.greatest(F.size(f.name), F.lit(0)).alias(f"{f.name}_size"))
        if isinstance(f.dataType.elementType, StructType) and "state" in f.dataType.elementType.names:
            states = F.transform(f.name, lambda x: x["state"])
            out += [F.greatest(F.size(states) - F.size(F.array_remove(states, s)), F.lit(0)).alias(f"{f.name}_{s.lower()}") for s in STATES]
    return rows.select(*out)


@dataclass
class Encoder:
    """Means and population deviations of the training rows, missing flags, one-hot values; fitted once."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    scale: bool
    stats: dict[str, tuple[float, float]]
    pipeline: Model

    @staticmethod
    def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool = True, vocabulary: dict[str, Sequence[str]] | None = None) -> Encoder:
        found = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(None))).alias(f"s_{c}") for c in numeric]).first()
        stats = {c: (found[f"m_{c}"] or 0.0, found[f"s_{c}"] or 0.0) for c in numeric}
        prepared = _prepared(train, numeric, categorical, stats, scale)
        stages = []
        for c in categorical:
            stages += [StringIndexer(inputCol=f"c_{c}", outputCol=f"i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol=f"i_{c}", outputCol=f"o_{c}", dropLast=True)]
        inputs = [x for c in numeric for x in (f"n_{c}", f"q_{c}")] + [f"o_{c}" for c in categorical]
        pipeline = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")]).fit(prepared)
        return Encoder(tuple(numeric), tuple(categorical), scale, stats, pipeline)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with features; values that training lacked encode as no value at all."""
        return self.pipeline.transform(_prepared(rows, self.numeric, self.categorical, self.stats, self.scale)).select(*rows.columns, "features")


def _prepared(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], stats: dict[str, tuple[float, float]], scale: bool) -> DataFrame:
    out = {}
    for c in numeric:
        mean, deviation = stats[c]
        x = F.coalesce(F.col(c).cast("double"), F.lit(mean))
        out[f"n_{c}"] = (x - mean) / (deviation or 1.0) if scale else x
        out[f"q_{c}"] = F.col(c).isNull().cast("double")
    for c in categorical:
        out[f"c_{c}"] = F.coalesce(F.col(c).cast("string"), F.lit("<missing>"))
    return rows.withColumns(out)


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with label as double and weight n / (2 n_class)."""
    n = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    total = sum(n.values())
    weight = F.lit(1.0)
    for y, k in n.items():
        weight = F.when(F.col(label) == y, total / (2.0 * k)).otherwise(weight)
    return rows.withColumn("label", F.col(label).cast("double")).withColumn("weight", weight)


def logistic(train: DataFrame, label: str = "label", c: float = 1.0) -> Model:
    """L3: L2 with strength 1 / C and balanced classes."""
    rows = balanced(train, label)
    total = rows.agg(F.sum("weight")).first()[0]
    return LogisticRegression(weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-9).fit(rows)


def forest(train: DataFrame, label: str = "label", trees: int = 64, depth: int = 4, seed: int = 42) -> Model:
    """L4."""
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(balanced(train, label))


def boosted(train: DataFrame, label: str = "label", rounds: int = 32, depth: int = 3, rate: float = 0.1, seed: int = 42) -> Model:
    """32 rounds of depth 3; the router's variant is rounds=8, depth=2, rate=0.2."""
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(train.withColumn("label", F.col(label).cast("double")))


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """rows with score, the probability of label 1."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).select(*[c for c in rows.columns if c != "score"], "score")


def heuristic(column: str = "impact_score") -> Column:
    """L6."""
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def shuffled_labels(rows: DataFrame, key: str = "row_id", label: str = "label", seed: int = 0) -> DataFrame:
    """The same labels, dealt to rows by a hash order. Both orders are ranked within ranges of equal numbers of rows.

    Rows are numbered by key and, apart, by hash, by a sort over partitions; equal numbers are joined.
    """
    def number(df: DataFrame, *order: Column | str) -> DataFrame:
        parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
        from ..storage import written

        parts = written(parts, "shuffle")
        first = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_k").alias("_f"))
        starts = first.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return parts.join(F.broadcast(starts), "_p").withColumn("_place", F.col("_s") + F.col("_k") - F.col("_f")).drop("_p", "_k", "_n", "_f", "_s")

    a = number(rows.drop(label), key)
    b = number(rows.select(label, F.xxhash64(F.lit(seed), key).alias("_h"), key), "_h", key).select("_place", label)
    return a.join(b, "_place").drop("_place")


def top_coefficients(model: Model, names: Sequence[str], rows: DataFrame, k: int = 10) -> DataFrame:
    """(feature, value, rank) of the k largest by absolute value, ties by name."""
    values = list(model.coefficients) if hasattr(model, "coefficients") else list(model.featureImportances)
    table = rows.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=False)], "feature string, value double")
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("value")), "feature"))).filter(F.col("rank") <= k)
