"""Calls and changes by masks of variable segments, against all pairs compared segment by segment."""

import itertools

from contrail.operators import match


def test_masks_equal_all_pairs(spark):
    parts = ("a", "b", "{x}", "*")
    templates = ["/", "/a/", *("/" + "/".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n))]
    calls = ["/", "/a", "/b/a", "/a/{dynamic}", "/{dynamic}/b/a", "/*/a/b", "/c/c/c", "//a//b"]
    changes = spark.createDataFrame([(str(i), "GET", p) for i, p in enumerate(templates)], "change_id string, method string, path string")
    sites = spark.createDataFrame([(str(i), "get", p, "EXACT") for i, p in enumerate(calls)] + [("no", "get", "/a", "UNRESOLVED"), ("other", "put", "/a", "EXACT"), ("none", "get", None, "EXACT")], "call_id string, method string, path string, url_state string")
    cut = lambda p: [x for x in p.split("/") if x]
    open_ = lambda x: x.startswith("{") and x.endswith("}")
    same = lambda p, q: len(cut(p)) == len(cut(q)) and all(x == y or open_(x) or open_(y) for x, y in zip(cut(p), cut(q), strict=True))
    want = sorted((str(i), str(j)) for i, p in enumerate(templates) for j, q in enumerate(calls) if same(p, q))
    got = sorted((r["change"]["change_id"], r["call"]["call_id"]) for r in match.candidate_pairs(changes, sites).collect())
    assert got == want


def test_nothing_matches_nothing(spark):
    changes = spark.createDataFrame([], "change_id string, method string, path string")
    sites = spark.createDataFrame([("1", "get", "/a", "EXACT")], "call_id string, method string, path string, url_state string")
    assert match.candidate_pairs(changes, sites).count() == 0
