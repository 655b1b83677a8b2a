"""Null, empty, very long, repeated and clashing rows, and empty tables, through every query and stage."""

import pytest

from contrail.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, target double, kept boolean, n long, node string, label int, position double, chunk long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    good = "the quick brown fox jumps over the lazy dog while some other words of a longer text follow it and end here today maybe never again"
    long = " ".join(f"word{k % 977}x{k}" for k in range(60_000))
    rows = [(1, good, "a"), (1, good, "a"), (2, None, None), (3, "", "b"), (4, " \n\t ", "b"), (5, long, "b"), (6, good + " Mail bob@x.org now", "c"), (None, good, "a"), (None, None, None), (7, "é" * 50, None), (8, "a", "a"), (9, "trash idiot " + good, "c"), (10, "x " * 500, "a"), (11, "line\nline\n\nline", "d")]
    rows += [(20 + k, f"{good} number {k} differs", "a") for k in range(8)]
    full = [(i, t, None, s, None if t is None else len(t), 0.5, 7, 1.0, True, 3, "n", 1, 0.0, 1) for i, t, s in rows]
    out = {}
    for name, data in (("odd", full), ("empty", [])):
        at = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(data, DOCS).write.parquet(f"{at}/documents.parquet")
        labels = [(1, 1, 0), (6, 0, 1), (9, 0, 1), (11, None, None), (None, 1, 1), (20, 1, 0), (21, 1, 0), (99, 1, 1), (1, 1, 0)] if data else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        vectors = [(0, [0.5, -0.25]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.5, -0.25]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (10, [0.0, 0.0])] if data else []
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
        spark.createDataFrame([("1", good), ("2", None)] if data else [], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
        out[name] = at, len(full) if data else 0
    return out


@pytest.mark.parametrize("kind", ["odd", "empty"])
@pytest.mark.parametrize("name", [n for n in Q.queries() if n.startswith("op") and n not in ("op6_topk", "op13_divergence")])
def test_queries(spark, tables, kind, name):
    at, n = tables[kind]
    rows = Q.queries()[name](spark, at).collect()
    if name == "op3_packing":
        assert sum(r["start"] == 0 for r in rows) == n
    else:
        assert len(rows) == n
    if name in ("op1_quality", "op5_toxicity"):
        assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    if name == "op4_near_duplicates" and n:
        assert {r["component_id"] for r in rows if r["doc_id"] == 1} == {1} and all(r["n_shingles"] == 0 and r["kept"] for r in rows if r["doc_id"] in (2, 3, 4))
    if name == "op10_suffix_dedup" and n:
        assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] == 1) and next(r["n_removed"] for r in rows if r["doc_id"] == 20) > 50


def test_topk(spark, tables):
    rows = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in Q.op6_topk(spark, tables["odd"][0]).collect()}
    assert rows[(0, 1)] == (7, 128 * 128 + 64 * 64) and rows[(50, 1)] == (0, 256 * 128 - 256 * 64)
    assert {q for q, _ in rows} == {0, 50} and not {v for v, _ in rows.values()} & {3, 4, 5, 6, 8, 9}
    assert Q.op6_topk(spark, tables["empty"][0]).collect() == []


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline(spark, tables, kind):
    import corpus_pipeline

    at, _ = tables[kind]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert name == "packing" or docs.columns == columns
        if name == "near-duplicates" and kind == "odd":
            assert sum(r["text"] is not None and "quick brown" in r["text"] and "differs" not in r["text"] and "@" not in r["text"] and "trash" not in r["text"] for r in rows) <= 1
        if name == "personal data" and kind == "odd":
            assert all("bob@x.org" not in (r["text"] or "") for r in rows)


def test_entry_without_the_subpackage(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['contrail.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'rank_metrics' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
