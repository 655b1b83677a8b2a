"""FIXTURES.md, sections 5 to 7."""

import hashlib

import pytest
from pyspark.sql import functions as F

from contrail.functions.columns import hash_partition
from contrail.operators import audit, bootstrap, calibration, dataset, models, ranking, routing

SCORED = "group_id string, row_id string, symbol_id string, label int, score double"


def test_ranking_by_hand(spark):
    rows = spark.createDataFrame([("g", f"r{i}", f"s{i}", y, s) for i, (y, s) in enumerate([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)])], SCORED)
    r = ranking.mean_metrics(ranking.group_metrics(ranking.ranked(rows))).first()
    assert (r["p_at_5"], r["r_at_5"], r["p_at_10"], r["r_at_10"], r["mrr"]) == (0.5, 1, 0.5, 1, 1) and r["ndcg_at_5"] == pytest.approx(0.9197207891)
    ties = spark.createDataFrame([("g", f"r{i}", f"toy-{i}", 1, 0.5) for i in range(4)], SCORED)
    assert [r["symbol_id"] for r in ranking.ranked(ties).orderBy("rank").collect()] == ["toy-0", "toy-1", "toy-2", "toy-3"]
    none = spark.createDataFrame([("g", "r", "s", 0, 0.5)], SCORED)
    assert ranking.group_metrics(ranking.ranked(none)).first()["mrr"] == 0


def test_calibration(spark):
    rows = spark.createDataFrame([("g", str(i), "s", y, p) for i, (y, p) in enumerate([(0, 0.05), (0, 0.15), (1, 0.85), (1, 0.95)])], SCORED)
    bins = calibration.reliability(rows, 2).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [2, 2] and bins[0]["mean_prob"] == pytest.approx(0.1) and bins[0]["rate"] == 0
    assert calibration.expected_calibration_error(calibration.reliability(rows, 2)).first()["ece"] == pytest.approx(0.1)
    assert calibration.roc_auc(rows).first()["roc_auc"] == 1 and calibration.average_precision(rows).first()["average_precision"] == 1
    assert calibration.bad_probabilities(spark.createDataFrame([(1.2,), (0.5,), (float("nan"),)], "score double")).count() == 2
    m = calibration.threshold_metrics(rows).first()
    assert (m["precision"], m["recall"], m["f1"]) == (1, 1, 1)


def test_bootstrap_holds_the_point(spark):
    groups = spark.createDataFrame([(f"g{i}", float(i % 5)) for i in range(60)], "group_id string, m double")
    r = bootstrap.intervals(groups, "group_id", {"m": bootstrap.weighted_mean("m")}, resamples=200).first()
    assert r["low"] < r["point"] == 2.0 < r["high"] and r["high"] - r["low"] < 1.5


def test_hash_partition_is_the_big_number(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("g"))
    for r in rows.select("g", hash_partition(F.col("g"), 42).alias("p")).collect():
        digest = hashlib.sha256(f"split\x1f42\x1f{r['g']}".encode()).hexdigest()[:24]
        assert r["p"] == ("TRAIN", "VALIDATION", "TEST")[int(digest, 16) % 3]


def test_components_split_and_guards(spark):
    rows = spark.createDataFrame([(i, f"a{i // 2}", f"b{i % 7}" if i > 9 else None) for i in range(20)], "row_id int, x string, y string")
    found = dataset.clone_components(rows, "row_id", ["x", "y"])
    split = dataset.component_split(found, "row_id", rows.filter("row_id < 4"))
    assert split.count() == 20 and split.filter("row_id < 4 and split_partition = 'TEST'").count() == 0
    assert audit.split_violations(rows.join(split, "row_id"), ["x", "y"]).count() == 0
    assert audit.split_violations(rows.withColumn("split_partition", F.when(F.col("row_id") % 2 == 0, "TRAIN").otherwise("TEST")), ["x"]).count() == 10
    assert audit.historical_overlap(rows, [rows.filter("row_id < 4")], ["x"]).first().asDict() == {"field": "x", "fresh": 10, "old": 2, "overlap": 2}


def strategies(spark, *rows):
    return spark.createDataFrame([("g", *r) for r in rows], "decision_group_id string, strategy string, outcome string, cost double, latency double, quality double")


def test_preferences(spark):
    rows = [("NO_AI", "NOT_APPLICABLE", 0.0, 0.0, 0.0), ("DETERMINISTIC", "FAILURE", 0.0, 0.0, 90.0), ("SMALL", "SUCCESS", 1.0, 1.0, 80.0), ("MEDIUM", "SUCCESS", 1.0, 1.0, 80.0), ("STRONG", "SUCCESS", 4.0, 4.0, 95.0)]
    r = routing.preferred(strategies(spark, *rows)).first()
    assert r["preferred"] == "SMALL" and r["feasible"] == ["MEDIUM", "SMALL", "STRONG"]
    assert routing.preferred(strategies(spark, ("SMALL", "SUCCESS", 1.0, 5.0, 80.0))).first()["preferred"] == "NO_FEASIBLE_STRATEGY"
    chosen = spark.createDataFrame([("p", "g", "STRONG"), ("q", "g", "NO_FEASIBLE_STRATEGY")], "policy string, decision_group_id string, chosen string")
    out = {r["policy"]: r for r in routing.evaluated(chosen, strategies(spark, *rows)).collect()}
    assert out["p"]["objective_satisfied"] and out["p"]["regret"] == 3 and not out["q"]["objective_satisfied"] and out["q"]["regret"] is None


def test_abstaining_and_ties(spark):
    contexts = spark.createDataFrame([("a", False, False, "SUPPORTED"), ("b", False, False, "SUPPORTED"), ("c", True, True, "SUPPORTED")], "context_id string, no_repair_required boolean, deterministic_rule_available boolean, m10_repairability string")
    scores = spark.createDataFrame([("a", "SMALL", 0.5), ("a", "DETERMINISTIC", 0.9), ("a", "MEDIUM", 0.5), ("b", "SMALL", -1.0)], "context_id string, strategy string, score double")
    out = {r["context_id"]: (r["chosen"], r["code"]) for r in routing.abstaining(contexts, scores).collect()}
    assert out == {"a": ("SMALL", None), "b": ("NO_FEASIBLE_STRATEGY", "LEARNED_ABSTENTION"), "c": ("NO_AI", None)}
    tied = scores.filter("context_id = 'a' and strategy <> 'DETERMINISTIC'")
    assert routing.best_scores(tied).first()["chosen"] == "SMALL" and routing.best_scores(tied, "name").first()["chosen"] == "SMALL"


def test_models(spark):
    rows = spark.createDataFrame([(str(i), i % 2, float(i % 2) + (i % 5) * 0.01, "x" if i % 3 else None) for i in range(60)], "row_id string, label int, n double, c string")
    encoder = models.Encoder.fit(rows, ["n"], ["c"])
    encoded = encoder.transform(rows)
    for fit in (models.logistic, lambda t: models.forest(t, trees=4), lambda t: models.boosted(t, rounds=2, depth=2)):
        scored = models.predict(fit(encoded), encoded)
        assert calibration.roc_auc(scored).first()["roc_auc"] > 0.95
    shuffled = models.shuffled_labels(rows, "row_id")
    assert shuffled.agg(F.sum("label")).first()[0] == 30 and shuffled.count() == 60
    with pytest.raises(ValueError):
        models.allowed(rows, ["label"], ["n"])
