"""Digest trees, bad lines, appends, inversions, large contexts and sealed partitions."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.operators import chain, dataset, inversions, models, newton, selection
from contrail.operators.audit import ZERO
from contrail.sources import verified


def test_a_changed_row_is_found(spark, tmp_path):
    rows = spark.range(2500).withColumn("x", F.col("id") % 7)
    verified.write_verified(rows, str(tmp_path / "t"), "id", leaf=10)
    assert verified.read_verified(spark, str(tmp_path / "t")).count() == 2500
    tree = verified.merkle(rows.orderBy(F.rand(3)).repartition(5), "id", leaf=10)
    assert sorted(r["rows"] for r in tree.groupBy("level").agg(F.sum("rows").alias("rows")).collect()) == [2500] * 4
    assert verified.root(tree).first() == verified.root(spark.read.parquet(str(tmp_path / "t" / "tree"))).first()
    other = rows.withColumn("x", F.when(F.col("id") == 1234, 99).otherwise(F.col("x")))
    other.write.mode("overwrite").parquet(str(tmp_path / "t" / "rows"))
    with pytest.raises(ValueError, match="rows 1230 to 1239 by id"):
        verified.read_verified(spark, str(tmp_path / "t"))
    assert verified.merkle(rows.limit(0), "id").count() == 0


def test_the_first_bad_line_is_named(spark, tmp_path):
    good = '{"id": 1, "t": "' + "x" * 80 + '"}'
    lines = [good] * 5000
    lines[10] = ""
    lines[3333], lines[4000] = '{"id": 1', "[]"
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text(good)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        found = verified.bad_lines(spark, str(tmp_path), "id int, t string").collect()
        assert [(r["file"].rsplit("/", 1)[1], r["line"]) for r in found] == [("a.jsonl", 3334)]
        with pytest.raises(ValueError, match="a.jsonl:3334"):
            verified.read_jsonl_checked(spark, str(tmp_path), "id int, t string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert verified.read_jsonl_checked(spark, str(tmp_path / "b.jsonl"), "id int, t string").count() == 1


def _event(log, index, before, name):
    return (log, index, chain.CHRONOLOGY[min(index, 7)], before, f"{log}/{index}/{name}")


def test_one_of_two_writers_wins(spark, tmp_path):
    digest = F.col("event_hash")
    rows = lambda *r: spark.createDataFrame(list(r), chain.EVENT)
    logs = chain.Chains(spark, str(tmp_path / "logs"))
    said = logs.append(rows(_event("a", 0, ZERO, "x"), _event("b", 0, ZERO, "x"), _event("b", 0, ZERO, "y")), digest)
    assert sorted((r["event_hash"], r["code"]) for r in said.collect()) == [("a/0/x", "ACCEPTED"), ("b/0/x", "ACCEPTED"), ("b/0/y", "LOST")]
    seen = logs.commits()
    first = logs.append(rows(_event("a", 1, "a/0/x", "p")), digest, seen=seen)
    second = chain.Chains(spark, str(tmp_path / "logs")).append(rows(_event("a", 1, "a/0/x", "q"), _event("b", 1, "b/0/x", "q")), digest, seen=seen)
    assert first.first()["code"] == "ACCEPTED" and {r["log_id"]: r["code"] for r in second.collect()} == {"a": "STALE", "b": "ACCEPTED"}
    codes = []
    race = [threading.Thread(target=lambda n=n: codes.append(logs.append(rows(_event("a", 2, "a/1/p", n)), digest).first()["code"])) for n in ("r", "s")]
    for t in race:
        t.start()
    for t in race:
        t.join()
    assert sorted(codes) == ["ACCEPTED", "STALE"]
    wrong = rows(("a", 3, "TEST_ACCESSED", logs.events().filter("log_id = 'a' and event_index = 2").first()["event_hash"], "h"))
    assert logs.append(wrong, digest).first()["code"] == "STATE" and logs.events().count() == 5


@pytest.mark.parametrize("parts", [1, 7])
def test_inversions_are_all_pairs(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([rng.random(), rng.randrange(5) / 4]), rng.choice([rng.random(), rng.randrange(5) / 4])) for _ in range(400)] + [("lone", 0.5, 0.5), ("b", None, 1.0), ("tie", 0.1, 0.2), ("tie", 0.1 + 1e-13, 0.1)]
    want = {}
    for g in {r[0] for r in rows}:
        points = [r[1:] for r in rows if r[0] == g and r[1] is not None]
        want[g] = sum(b2 < b1 - 1e-12 and c2 > c1 + 1e-12 for b1, c1 in points for b2, c2 in points)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = inversions.rank_inversions(spark.createDataFrame(rows, "group_id string, before double, after double").repartition(3), "before", "after").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert {r["group_id"]: r["inversions"] for r in found} == want


def test_merge_counts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 37, 64):
        key, holds = rng.integers(0, 9, n), rng.random(n) < 0.6
        assert inversions.earlier_less(key, holds).tolist() == [int((holds[:i] & (key[:i] < key[i])).sum()) for i in range(n)]


def test_fill_across_files_and_contexts(spark):
    rows = [("a", i, s, f) for i, (s, f) in enumerate([(50, "x"), (60, "y"), (None, "x"), (40, "z"), (10, None), (5, "w"), (0, "y")])] + [("b", 0, 101, "x"), ("b", 1, 100, "x"), (None, 0, 1, "x")]
    table = spark.createDataFrame(rows, "context_id string, k int, size int, file string")
    found = selection.fill(table, order=["k"], required=None, budget=100, files=2).collect()
    assert {(r["context_id"], r["k"]) for r in found if r["selected"]} == {("a", 0), ("a", 3), ("a", 4), ("b", 1), (None, 0)} and len(found) == len(rows)


def test_newton_equals_the_gradient(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -0.7] + 0.3)))).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, label int")
    w = np.array(newton.fit(rows, ["a", "b"], c=2.0))
    design = np.c_[x, np.ones(300)]
    slope = design.T @ (1 / (1 + np.exp(-design @ w)) - y) + np.array([w[0], w[1], 0]) / 2.0
    assert np.abs(slope).max() < 1e-6


def test_a_sealed_partition_refuses(spark):
    rows = spark.createDataFrame([("TRAIN", 1), ("TEST", 0)], "split_partition string, label int")
    with pytest.raises(dataset.SealedError):
        dataset.partition(rows, "TEST")
    assert dataset.partition(rows, "TEST", opened=True).count() == dataset.partition(rows, "TRAIN").count() == 1
    with pytest.raises(Exception, match="row of the sealed partition TEST"):
        dataset.unsealed(rows).collect()
    assert dataset.unsealed(rows.filter("label = 1")).count() == 1 and dataset.sealed_view(rows).columns == ["split_partition"]


def test_lists_become_numbers(spark):
    rows = spark.createDataFrame([(["a", "b"], [("x", "EXACT"), ("y", "PARTIAL"), ("z", "EXACT")], 1), (None, [], 2)], "used array<string>, evidence array<struct<feature:string,state:string>>, n int")
    found = sorted(map(tuple, models.flattened(rows).collect()), key=lambda r: r[-1])
    assert models.flattened(rows).columns == ["used_size", "evidence_size", "evidence_exact", "evidence_partial", "evidence_unresolved", "n"] and found == [(2, 3, 2, 1, 0, 1), (0, 0, 0, 0, 0, 2)]
