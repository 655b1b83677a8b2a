"""Propagation from all seeds to the fixpoint against a plain search."""

from pyspark.sql import functions as F

from contrail.operators import graph
from contrail.plans import queries as plans


def search(seeds, edges):
    found, front, level = dict.fromkeys(seeds, 0), set(seeds), 0
    while front:
        level += 1
        front = {a for a, b in edges if b in front} - set(found)
        found |= dict.fromkeys(front, level)
    return found


def test_distances_pass_chains_and_cycles(spark):
    links = [(k + 1, k) for k in range(6)] + [(0, 6), (20, 3), (21, 20), (31, 30), (30, 31)]
    edges = spark.createDataFrame(links, "caller_id long, callee_id long")
    rows = graph.distances(spark.createDataFrame([(0,), (21,)], "symbol_id long"), edges).collect()
    assert len(rows) == len(search({0, 21}, links)) and {r[0]: r[1] for r in rows} == search({0, 21}, links)


def test_flagship_covers_all_touched_customers(spark, sf):
    seeds = {r[0] for r in plans._touched(spark, sf).collect()}
    links = {(r["caller_id"], r["callee_id"]) for r in plans._order_edges(spark, sf).collect()}
    found = search(seeds, links)
    assert {r[0]: r[1] for r in plans.QUERIES["callers_distance"](spark, sf).collect()} == found
    rows = plans.flagship(spark, sf).collect()
    assert sum(r["direct"] for r in rows) == len(seeds) and sum(r["direct"] + r["indirect"] for r in rows) == len(found)


def test_paths_pass_more_levels_than_tables_of_pairs(spark):
    n = 3 * graph.MERGED
    links = [(k + 1, k) for k in range(n)] + [(k + 2, k) for k in range(0, n - 1, 5)] + [(0, n)]
    edges = spark.createDataFrame([(a, b, f"e{a}-{b}") for a, b in links], "caller_id long, callee_id long, edge_id string").withColumn("state", F.lit("EXACT"))
    rows = graph.propagate(spark.createDataFrame([(0,), (7,)], "symbol_id long"), edges).collect()
    assert {(r["symbol_id"], r["seed_id"]): r["distance"] for r in rows} == {(k, s): d for s in (0, 7) for k, d in search({s}, links).items()}
    for r in rows:
        steps = list(zip(map(int, r["path"][1:]), map(int, r["path"]), strict=False))
        assert len(steps) == r["distance"] and set(steps) <= set(links) and r["edge_ids"] == [f"e{a}-{b}" for a, b in steps]
        assert (int(r["path"][0]), int(r["path"][-1])) == (r["seed_id"], r["symbol_id"])


def test_areas_are_walked_as_levels_are(spark, monkeypatch):
    monkeypatch.setattr(graph, "AREA", 12)
    links = [(10 * g + a, 10 * g + b, f"e{(a * 7 + n) % 5}", g) for g in range(5) for n, (a, b) in enumerate([(1, 0), (2, 0), (3, 1), (3, 2), (0, 3), (3, 1), (5, 3)] + [(k + 1, k) for k in range(9)] * (g == 4))]
    links += [(31, 30, None, 3), (None, 20, "e", 2)]
    edges = spark.createDataFrame(links, "caller_id long, callee_id long, edge_id string, repo int").withColumn("state", F.when(F.col("caller_id") % 3 == 0, "PARTIAL"))
    seeds = spark.createDataFrame([(10 * g + k, g if g else None) for g in range(5) for k in (0, 1, 9)], "symbol_id long, repo int")
    edges = edges.withColumn("repo", F.when(F.col("repo") > 0, F.col("repo")))
    symbols = spark.createDataFrame([(10 * g + k, "ab"[k % 2]) for g in range(4) for k in range(4)] + [(11, "c")], "symbol_id long, qualified_name string")
    rows = lambda **more: sorted(map(repr, graph.propagate(seeds, edges, symbols, **more).collect()))
    assert rows(area="repo") == rows() and rows(area="repo", rounds=2) == rows(rounds=2)


def test_no_path_of_a_small_area_is_shuffled(spark, sf):
    text = plans.QUERIES["callers_closure"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "Aggregate" not in text and "MapInArrow" in text
