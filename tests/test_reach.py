"""Sets and counts of call graphs against plain searches."""

import random

from contrail.operators import reach


def test_components_and_counts(spark):
    rng = random.Random(5)
    for n, m in ((14, 16), (50, 62)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(1, 1)}
        above = {v: set() for v in range(n)}
        for v in range(n):
            stack = [a for a, b in edges if b == v]
            while stack:
                x = stack.pop()
                if x not in above[v]:
                    above[v].add(x)
                    stack += [a for a, b in edges if b == x]
        pairs = spark.createDataFrame([*edges, (None, 3)], "caller_id long, callee_id long")
        found = {r["node"]: r["component"] for r in reach.strong_components(pairs.toDF("a", "b")).collect()}
        seen = {v for e in edges for v in e}
        assert set(found) == seen
        assert all((found[v] == found[w]) == (v == w or (v in above[w] and w in above[v])) for v in seen for w in seen)
        counts = {r["symbol_id"]: (r["direct_callers"], r["upstream_callers"]) for r in reach.upstream_counts(pairs).collect()}
        assert counts == {v: (len({a for a, b in edges if b == v}), len(above[v])) for v in range(n) if above[v]}
    assert reach.upstream_counts(pairs.limit(0)).count() == 0


def test_sets_of_a_small_graph(spark):
    edges = [("b", "a", "e1", "EXACT"), ("c", "b", "e2", "PARTIAL"), ("c", "a", "e3", "UNRESOLVED"), ("a", "c", "e4", "EXACT"), ("d", "c", "e5", None), ("d", "x", "e6", "EXACT"), ("c", "a", "e0", "EXACT")]
    impacts = [("i1", "a", "c1", 0.5, "EXACT"), ("i2", "a", "c2", 0.7, "PARTIAL"), ("i3", "x", "c1", 0.1, "EXACT"), ("i3", "x", "c1", 0.1, "EXACT"), ("i4", None, "c9", 0.1, "EXACT")]
    found, ids = reach.spread(spark.createDataFrame(impacts, "impact_id string, symbol_id string, change_id string, score double, certainty string"), spark.createDataFrame(edges, "caller_id string, callee_id string, edge_id string, state string"))
    rows = {r["symbol_id"]: (r["distance"], r["impact_type"], r["state"], r["score"], r["seeds"], r["changes"]) for r in reach.impacted(found).collect()}
    assert rows == {
        "a": (0, "DIRECT", "PARTIAL", 0.7, 2, 2), "b": (1, "INDIRECT", "PARTIAL", None, 2, 2), "c": (1, "INDIRECT", "PARTIAL", None, 2, 2),
        "d": (1, "INDIRECT", "PARTIAL", None, 3, 2), "x": (0, "DIRECT", "EXACT", 0.1, 1, 1),
    }
    held = reach.sets(found)
    sets = {}
    for r in held.join(reach.listed(held, ids), ["kind", "block", "bits"]).collect():
        sets.setdefault((r["symbol_id"], r["kind"]), set()).add(r["id"])
    assert sets["d", "seed"] == {"i1", "i2", "i3"} and sets["b", "change"] == {"c1", "c2"} and sets["x", "seed"] == {"i3"}


def _searched(edges, starts):
    """All that each node is reached from, itself included, among starts."""
    out = {}
    for s in starts:
        stack, seen = [s], {s}
        while stack:
            x = stack.pop()
            stack += [b for a, b in edges if a == x and b not in seen]
            seen |= {b for a, b in edges if a == x}
        for v in seen:
            out.setdefault(v, set()).add(s)
    return out


def test_what_flows_through_hubs_is_counted_once(spark, monkeypatch):
    monkeypatch.setattr(reach, "LEAST", 1)
    monkeypatch.setattr(reach, "WORD", 2)
    rng = random.Random(8)
    # six cycles of five nodes, one way between them, and loose nodes before, between and behind them
    edges = {(5 * c + i, 5 * c + (i + 1) % 5) for c in range(6) for i in range(5)} | {(5 * c + 1, 5 * c + 7) for c in (0, 1, 3)}
    edges |= {(min(x), max(x)) for x in ((rng.randrange(30, 60), rng.randrange(30, 60)) for _ in range(30)) if x[0] != x[1]}
    edges |= {(rng.randrange(30, 45), rng.randrange(30)) for _ in range(6)} | {(rng.randrange(30), rng.randrange(45, 60)) for _ in range(6)}
    nodes = {v for e in edges for v in e}
    flow = spark.createDataFrame([*edges], "a long, b long")
    ids = {v: f"{v % 23}" for v in nodes if v % 3}
    items = spark.createDataFrame([(v, "x", k, int(k)) for v, k in ids.items()], "node long, kind string, id string, value long")
    of = reach.strong_components(flow)
    found = {r["node"]: (r["n"], r["total"]) for r in of.join(reach.gathered(of, flow, items), "component").collect()}
    plain = {v: {ids[s] for s in from_} for v, from_ in _searched(edges, ids).items()}
    assert found == {v: (len(x), sum(map(int, x))) for v, x in plain.items()}


def test_states_past_unresolved_seeds_are_walked(spark):
    impacts = [(1, 1, 9, 0.5, "UNRESOLVED"), (2, 4, 9, 0.25, "EXACT"), (3, 5, 8, 1.0, "PARTIAL"), (4, 20, 8, 1.0, None)]
    edges = [(2, 1, "a", "EXACT"), (3, 2, "b", "EXACT"), (3, 4, "c", "EXACT"), (6, 4, "d", "UNRESOLVED"), (6, 4, "e", "EXACT"), (7, 6, "f", "EXACT"), (8, 5, "g", "EXACT"), (9, 4, "h", "PARTIAL"), (9, None, "i", "EXACT")]
    a, b = spark.createDataFrame(impacts, "impact_id long, symbol_id long, change_id long, score double, certainty string"), spark.createDataFrame(edges, "caller_id long, callee_id long, edge_id string, state string")
    plain = {r["symbol_id"]: r for r in reach.impacted(reach.spread(a, b)[0]).collect()}
    found = {r["symbol_id"]: r for r in reach.impacts_of(a, b).collect()}
    assert {k: tuple(r)[:7] for k, r in found.items()} == {k: tuple(r) for k, r in plain.items()}
    assert (found[3]["state"], found[7]["state"], found[9]["state"], found[3]["seeds_sum"], found[3]["changes_sum"]) == ("UNRESOLVED", "UNRESOLVED", "PARTIAL", 3, 9)
